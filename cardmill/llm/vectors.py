"""The most similar notes of every note, by graphs over shards of the vectors.

Identical vectors are one entry. Entries go to the shards of their ``copies`` nearest centroids, so that close
vectors share a shard although a border may lie between them; every shard builds a navigable small-world graph in
flat neighbour arrays and searches it for each of its entries; the answers of the shards are merged per entry. A search
for an entry of the graph starts at the entry itself, on the lowest layer; the upper layers serve building, and
searches for entries of another part. Centroids, on two levels, come from bounded samples; everything else covers
every row.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardmill import storage
from cardmill.llm.hnsw import Hnsw

MODEL = "tilo-embed:64"


def _unit_bytes(vectors: Iterable, dim: int) -> list[bytes | None]:
    """float32 bytes of the unit vectors; b"" for all-zero ones, None for what is no list of ``dim`` finite numbers."""
    good: list[int] = []
    out: list[bytes | None] = [None] * len(vectors)
    kept = []
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim:
            good.append(i)
            kept.append(v)
    if kept:
        x = np.array(kept, float)
        norm = np.linalg.norm(x, axis=1)
        unit = (x / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)
        for k, i in enumerate(good):
            if np.isfinite(norm[k]):
                out[i] = unit[k].tobytes() if norm[k] > 0 else b""
    return out


def _parsed(text: str | None) -> list | None:
    """A JSON list of numbers, else None; true and false are no numbers."""
    if not text or text[0] not in "[ ":
        return None
    try:
        v = json.loads(text)
    except ValueError:
        return None
    return v if isinstance(v, list) and all(type(x) is float or type(x) is int for x in v) else None


def note_vectors(notes: DataFrame, cache: DataFrame, model: str = MODEL, dim: int = 64) -> DataFrame:
    """``note_id, u``: the unit vector (float32 bytes) of every note that has one: its own, else the cached one of its fingerprint.

    Broken JSON, other lengths, values that are no finite numbers are not usable; an all-zero vector of its own leaves
    the note out. Of repeated rows of a note or key the last written counts.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _unit_bytes([_parsed(t) for t in b.column(3).to_pylist()], dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(vectors, pa.binary())], names=["note_id", "at", "fingerprint", "u"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [None if v is None or any(x is None for x in v) else v for v in b.column(2).to_pylist()]
            vectors = _unit_bytes(rows, dim)
            keep = pa.array([v is not None for v in vectors])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vectors, pa.binary())], names=["fingerprint", "at", "u"]).filter(keep)

    rows = notes.filter("note_id IS NOT NULL").select("note_id", F.coalesce("indexed_at", F.lit("")).alias("at"), "fingerprint", "embedding_vector")
    rows = rows.mapInArrow(own, "note_id bigint, at string, fingerprint string, u binary")
    rows = rows.groupBy("note_id").agg(F.max(F.struct("at", "fingerprint", "u")).alias("r")).select("note_id", "r.fingerprint", "r.u")
    cached = cache.filter((F.col("model") == model) & F.col("fingerprint").isNotNull()).select("fingerprint", F.coalesce("created_at", F.lit("")).alias("at"), "vector")
    cached = cached.mapInArrow(held, "fingerprint string, at string, u binary").groupBy("fingerprint").agg(F.max(F.struct("at", "u")).alias("c")).select("fingerprint", F.col("c.u").alias("cached"))
    return rows.join(cached, "fingerprint", "left").select("note_id", F.coalesce("u", "cached").alias("u")).filter(F.length("u") > 0)


def _centroids(sample: np.ndarray, shards: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of a bounded sample."""
    rng = np.random.default_rng(5)
    c = sample[rng.choice(len(sample), min(shards, len(sample)), replace=False)]
    for _ in range(rounds):
        home = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c.astype(np.float32)


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), -1)


class Cells:
    """Centroids on two levels: ``coarse`` cells, each with ``fine`` centroids of its own, all of them numbered in a row."""

    def __init__(self, coarse: np.ndarray, fine: list[np.ndarray]):
        self.coarse, self.fine = coarse, fine
        self.first = np.r_[0, np.cumsum([len(f) for f in fine])]

    def nearest(self, x: np.ndarray, copies: int, probes: int = 3) -> np.ndarray:
        """The numbers of the ``copies`` nearest fine centroids in the ``probes`` nearest coarse cells, -1 if there are fewer."""
        probes, width = min(probes, len(self.coarse)), max(len(f) for f in self.fine)
        cells = np.argpartition(-(x @ self.coarse.T), probes - 1, axis=1)[:, :probes]
        sims = np.full((len(x), probes, width), -np.inf, np.float32)
        for c in np.unique(cells):
            row, at = np.nonzero(cells == c)
            sims[row, at, : len(self.fine[c])] = x[row] @ self.fine[c].T
        sims = sims.reshape(len(x), -1)
        take = min(copies, sims.shape[1])
        best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        numbers = self.first[np.take_along_axis(cells, best // width, 1)] + best % width
        return np.where(np.take_along_axis(sims, best, 1) > -np.inf, numbers, -1).astype(np.int32)


def _cells(entries: DataFrame, n: int, wanted: int, sample_rows: int) -> Cells:
    """About ``wanted`` fine centroids, as many coarse cells as each then has fine ones.

    The coarse ones are fitted here on at most ``sample_rows`` rows; each cell's fine ones in a task of its own, on at
    most about as many again. So the samples grow with no more than the number of cells.
    """
    place = lambda salt: F.pmod(F.xxhash64("vid", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    # pseudo-random samples by hash: the same rows on any cluster
    rows = entries.withColumn("at", place(3)).filter(F.col("at") < min(1.0, 1.2 * sample_rows / n)).select("at", "u").orderBy("at", "u").limit(sample_rows).collect()
    sample = _matrix([r.u for r in rows])
    coarse = _centroids(sample, max(1, round(wanted**0.5)))
    share = np.bincount(np.argmax(sample @ coarse.T, axis=1), minlength=len(coarse)) / len(sample)
    number = np.maximum(1, np.round(wanted * share)).astype(int)
    rate = np.minimum(min(1.0, 64 * wanted / n), sample_rows / np.maximum(1, share * n))
    held = entries.sparkSession.sparkContext.broadcast((coarse, number, rate))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _, limit = held.value
        for batch in batches:
            if batch.num_rows:
                home = np.argmax(_matrix(batch.column(1).to_pylist()) @ c.T, axis=1)
                keep = batch.column(0).to_numpy() < limit[home]
                yield pa.RecordBatch.from_arrays([pa.array(home[keep].astype(np.int32)), batch.column(1).filter(pa.array(keep))], names=["home", "u"])

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        c = _centroids(_matrix(sorted(frame.u.tolist())), int(held.value[1][key[0]]))
        return pd.DataFrame({"home": key[0], "u": [x.tobytes() for x in c]})

    some = entries.withColumn("at", place(4)).filter(F.col("at") < float(rate.max())).select("at", "u").mapInArrow(homes, "home int, u binary")
    found: dict[int, list[bytes]] = {}
    for r in some.groupBy("home").applyInPandas(fit, "home int, u binary").collect():  # one row per shard
        found.setdefault(r.home, []).append(r.u)
    return Cells(coarse, [_matrix(sorted(found[k])) if k in found else coarse[k : k + 1] for k in range(len(coarse))])


def nearest(entries: DataFrame, scratch: storage.Scratch, k: int = 5, least: float = 0.90, shard_rows: int = 6000, copies: int = 3, sample_rows: int = 20_000, degree: int = 12, beam: int = 24) -> DataFrame:
    """``vid, other, sim``: for each entry (``vid, u`` with u the float32 bytes of a unit vector) up to ``k`` others of at least ``least``.

    The number of shards follows from the number of entries; what is held of them by every task are their centroids,
    1/2000 of the vectors. A shard with more than twice ``shard_rows`` entries is cut into parts by hash: an entry is
    indexed in one part and searched for in all of them, in chunks of bounded size.
    """
    spark = entries.sparkSession
    n = entries.count()
    wanted = round(n * copies / shard_rows) if n > shard_rows else 1
    held = spark.sparkContext.broadcast(_cells(entries, n, wanted, sample_rows) if wanted > 1 else None)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.zeros((batch.num_rows, 1), np.int32) if cells is None else cells.nearest(_matrix(batch.column(1).to_pylist()), copies)
            row, at = np.nonzero(near >= 0)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(near[row, at]), batch.column(0).take(take), batch.column(1).take(take)], names=["shard", "vid", "u"])

    placed = entries.select("vid", "u").mapInArrow(assign, "shard int, vid bigint, u binary")
    placed = scratch.cut(placed, "placed")
    large = placed.groupBy("shard").count().filter(F.col("count") > 2 * shard_rows).select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))
    parts = placed.join(F.broadcast(large), "shard", "left")  # fewer rows than shards
    mine = F.pmod(F.xxhash64("vid", F.lit(1)), F.col("parts")).cast("int")
    parts = parts.withColumn("mine", F.coalesce(mine, F.lit(0)))
    # where a shard is cut, cell (part, chunk) indexes the part and searches it for the chunk
    cells = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("chunk"), F.lit(3).alias("role")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda c: F.struct(F.col("mine").alias("part"), c.alias("chunk"), F.when(c == F.col("mine"), 3).otherwise(1).alias("role"))),
            F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("mine")), lambda p: F.struct(p.alias("part"), F.col("mine").alias("chunk"), F.lit(2).alias("role"))),
        )
    )
    cells = parts.select("shard", "vid", "u", F.explode(cells).alias("cell")).select("shard", "cell.part", "cell.chunk", "cell.role", "vid", "u")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vid", kind="stable")  # the graph doesn't depend on the order of arrival
        x = _matrix(frame.u.tolist())
        vid, role = frame.vid.to_numpy(), frame.role.to_numpy()
        index = np.flatnonzero(role & 1)
        graph = Hnsw(x[index], degree, beam)
        if (role == 3).all():
            ids, sims = graph.neighbours(k)
            asked = index
        else:
            asked = np.flatnonzero(role & 2)
            ids, sims = graph.search(x[asked], k + 1)
        target = np.where(ids >= 0, vid[index][ids], -1)
        sims = np.where((ids < 0) | (target == vid[asked][:, None]), -np.inf, sims)
        i, j = np.nonzero(sims >= least - 1e-6)
        out = {"vid": vid[asked][i], "other": target[i, j]}
        # float32 rounding must not settle the limit: the products of what is kept are taken again
        a, b = x[asked[i]].astype(np.float64), x[index][ids[i, j]].astype(np.float64)
        return pd.DataFrame(out | {"sim": np.einsum("ij,ij->i", a, b)})

    found = cells.groupBy("shard", "part", "chunk").applyInPandas(search, "vid bigint, other bigint, sim double")
    # a neighbour seen from one side holds for the other as well: it may have missed it
    both = scratch.cut(found, "found")
    both = both.unionByName(both.select(F.col("other").alias("vid"), F.col("vid").alias("other"), "sim")).groupBy("vid", "other").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("sim"), "other"))
    return both.filter(F.col("sim") >= least - 1e-7).withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def similar_notes(notes: DataFrame, cache: DataFrame, k: int = 5, least: float = 0.90) -> DataFrame:
    """``note_id_a, note_id_b``: pairs of at least ``least`` of which one is among the ``k`` most similar of the other.

    Among equally similar notes the smaller ids come first. Notes with the same vector are each other's nearest: the
    first ``k + 1`` of them stand for all, so a hot vector costs no more than k pairs a note.
    """
    scratch = storage.Scratch(notes.sparkSession, "vectors")

    rows = scratch.cut(note_vectors(notes, cache), "rows")
    distinct = rows.groupBy(F.unhex(F.md5("u")).alias("h")).agg(F.min("u").alias("u"), F.count("*").alias("n"))
    entries = scratch.cut(distinct.select(F.monotonically_increasing_id().alias("vid"), "h", "u", "n"), "entries")
    hashed = rows.select("note_id", F.unhex(F.md5("u")).alias("h"))
    members = scratch.cut(storage.join_by_size(hashed, entries.select("h", "vid", "n"), "h", "n", F.lit(rows.count())).select("note_id", "vid", "n"), "members")
    # the first k + 1 notes of every entry, in two steps, so that no entry's notes meet in one task
    several = members.withColumn("salt", F.pmod(F.xxhash64("note_id"), F.lit(64)))
    for keys in (["vid", "salt"], ["vid"]):
        several = several.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("note_id"))).filter(F.col("rank") <= k + 1)
    first = scratch.cut(several.select("vid", "note_id", "rank", "n"), "first")
    own = F.broadcast(first.filter(F.col("n") * storage.HOT_SHARE > rows.count()).select("vid"))
    hot, cold = members.join(own, "vid"), members.join(own, "vid", "left_anti").filter("n > 1")
    heads = first.filter("n > 1").select("vid", F.col("note_id").alias("other"), "rank")
    copies = hot.join(F.broadcast(heads.join(own, "vid", "left_semi")), "vid").unionByName(cold.join(heads, "vid"))
    # a note's k nearest copies: the first k, or the first k + 1 without itself
    copies = copies.filter("note_id <> other").withColumn("place", F.col("rank") - (F.col("note_id") < F.col("other")).cast("int"))
    copies = copies.filter(F.col("place") <= k).select(F.col("note_id").alias("p"), F.col("other").alias("q"))
    near = nearest(entries, scratch, k, least)
    # other entries fill what the copies leave: only entries of up to k notes look further
    reach = near.join(first.select(F.col("vid").alias("other"), F.col("note_id").alias("q"), F.col("rank").alias("place")), "other").filter(F.col("place") <= k)
    rank = F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("sim"), "q"))
    reach = reach.withColumn("rank", rank)
    asking = first.filter(F.col("n") <= k).select("vid", F.col("note_id").alias("p"), "n")
    further = reach.join(asking, "vid").filter(F.col("rank") <= k - (F.col("n") - 1)).select("p", "q")
    pairs = copies.unionByName(further)
    return pairs.select(F.least("p", "q").alias("note_id_a"), F.greatest("p", "q").alias("note_id_b")).distinct()

