"""Pairs of texts with similar sets of 3-character substrings, compared in tiles of bit sketches.

Comparing every tile of a large collection with every other grows as its square. So tiles are formed within blocks:
texts that share one of ``bands`` keys, each the hash of ``rows`` minimum hashes of their sets. The rows of a block,
whatever its size, are sorted by population count (set size) and cut into tiles; of each pair of tiles the sketches
(the parity of the set in 64-bit words) are compared by exclusive-or and bit count, and pairs of tiles whose population
counts differ beyond the radius that the similarity allows are skipped. What is left is checked on the texts.

A sketch has at least as many bits as 5/8 of its set's elements (up to 4096 bits); of two widths the wider is folded to
the narrower, which gives the sketch that the narrower width would have given. The sketch test loses nothing: two
parity sketches never differ in more bits than their sets in elements, and sets of a and b elements with a Jaccard
similarity of 0.8 or more differ in at most (a + b) / 9. Blocking loses a pair of similarity j with probability
(1 - j**rows)**bands: 5e-6 at 0.80 and 6e-9 at 0.85 for 6 rows and 40 bands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill import storage

#: Blocks of more rows are split into cells, so that no task holds more than two parts of this many.
BLOCK_ROWS = 20_000
MOST_HOT = 10_000
#: Edge of a tile, by the size of its block: small blocks would be mostly padding in large tiles.
TILES = ((2, 2), (64, 4), (1 << 62, 64))
_CELLS = 1 << 21  # comparisons held at once
_MOST_WORDS = 64


@dataclass(frozen=True)
class Plan:
    """``rows`` minimum hashes a band, ``bands`` bands."""

    rows: int = 6
    bands: int = 40
    seed: int = 20_11


def trigrams(text: str) -> np.ndarray:
    """The distinct 3-character substrings, each as one number (21 bits a character): an exact form of the set."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else np.empty(0, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of a sketch for sets of ``n`` elements: a power of two, so that sketches fold into each other."""
    need = np.maximum(1, -(-5 * n.astype(np.int64) // (8 * 64)))
    return np.minimum(_MOST_WORDS, 1 << np.ceil(np.log2(need)).astype(np.int64))


def sketches(sets: list[np.ndarray], mixed: np.ndarray | None = None) -> list[bytes]:
    """The parity sketch of every set: bit h mod width is set if an odd number of elements have it."""
    n = np.array([len(s) for s in sets])
    width = sketch_words(n) * 64
    mixed = _mix(np.concatenate(sets)) if mixed is None else mixed
    base = np.r_[0, np.cumsum(width)]
    place = np.repeat(base[:-1], n) + ((mixed >> np.uint64(32)).astype(np.int64) & np.repeat(width - 1, n))
    data = np.packbits((np.bincount(place, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [data[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def signatures(sets: list[np.ndarray], plan: Plan) -> tuple[np.ndarray, list[bytes]]:
    """Band keys (one row per set) and sketches of non-empty sets."""
    rng = np.random.default_rng(plan.seed)
    k = plan.rows * plan.bands
    mult, add = rng.integers(0, 1 << 32, k, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, np.uint64).astype(np.uint32)
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]].astype(np.int64)
    mixed = _mix(np.concatenate(sets))
    low, least = mixed.astype(np.uint32), np.empty((k, len(sets)), np.uint32)
    for i in range(k):
        least[i] = np.minimum.reduceat(low * mult[i] + add[i], starts)
    keys = np.empty((len(sets), plan.bands), np.uint64)
    for b in range(plan.bands):
        acc = np.full(len(sets), b + 1, np.uint64)
        for i in range(b * plan.rows, (b + 1) * plan.rows):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + least[i])
        keys[:, b] = acc
    return keys.view(np.int64), sketches(sets, mixed)


def with_signatures(texts: DataFrame, plan: Plan) -> DataFrame:
    """``tid, n, sketch, bands`` of ``tid, text``. Texts of under three characters have no substrings and no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sets = [trigrams(t) for t in part.column(1).to_pylist()]
                keep = [i for i, s in enumerate(sets) if len(s)]
                if not keep:
                    continue
                keys, sketch = signatures([sets[i] for i in keep], plan)
                offsets = pa.array(np.arange(0, (len(keep) + 1) * plan.bands, plan.bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep)), pa.array([len(sets[i]) for i in keep], pa.int32()), pa.array(sketch, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                    names=["tid", "n", "sketch", "bands"],
                )

    return texts.select("tid", "text").mapInArrow(run, "tid bigint, n int, sketch binary, bands array<bigint>")


class Sketches:
    """Sketches of different widths as one matrix per width; a row has its own width and all narrower ones, folded."""

    def __init__(self, words: np.ndarray, flat: np.ndarray):
        self.words = words
        starts = np.r_[0, np.cumsum(words)][:-1]
        self.at: dict[int, np.ndarray] = {}
        width = int(words.max(initial=1))
        while width:
            level = np.zeros((len(words), width), np.uint64)
            own = np.flatnonzero(words == width)
            if len(own):
                level[own] = flat[starts[own][:, None] + np.arange(width)]
            if 2 * width in self.at:
                wider = self.at[2 * width]
                level ^= wider[:, :width] ^ wider[:, width:]
            self.at[width] = level
            width //= 2


def _tile_pairs(first: np.ndarray, last: np.ndarray, run: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of tiles of one block, by their distance. Rows being sorted by population count, a pair is skipped if the
    smallest count of the later tile is beyond the radius of the largest of the earlier one."""
    least, most = n[first], n[last - 1]
    for k in range(len(first)):
        a = np.flatnonzero((run[k:] == run[: len(run) - k]) & (4 * least[k:] <= 5 * most[: len(most) - k]))
        if not len(a):
            return  # later tiles of a block have larger counts still
        yield a, a + k


def block_pairs(key: np.ndarray, part: np.ndarray, n: np.ndarray, words: np.ndarray, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within the runs of equal keys of rows sorted by (key, n) that pass the sketch test.

    ``part``: 0 compare with all, 1 and 2 only with each other. ``words``, ``flat``: the sketches' widths and words.
    """
    if len(key) < 2:
        return
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[starts, len(key)])
    several = np.flatnonzero(lengths > 1)
    if not len(several):
        return
    starts, lengths = starts[several], lengths[several]
    inside = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.r_[0, np.cumsum(words)]
    flat = flat[np.repeat(at[inside], words[inside]) + np.arange(words[inside].sum()) - np.repeat(np.cumsum(words[inside]) - words[inside], words[inside])]
    part, n, sk = part[inside], n[inside].astype(np.int64), Sketches(words[inside], flat)
    starts = np.cumsum(lengths) - lengths
    above = 1
    for most, edge in TILES:
        mine = np.flatnonzero((lengths > above) & (lengths <= most))
        above = most
        if not len(mine):
            continue
        tiles = -(-lengths[mine] // edge)
        run = np.repeat(np.arange(len(mine)), tiles)
        first = starts[mine][run] + edge * (np.arange(len(run)) - np.repeat(np.cumsum(tiles) - tiles, tiles))
        last = np.minimum(first + edge, (starts + lengths)[mine][run])
        for a, b in _tile_pairs(first, last, run, n):
            width = sk.words[first[a]]  # of the narrowest row of both tiles
            for w in np.unique(width):
                of = np.flatnonzero(width == w)
                step = max(1, _CELLS // (edge * edge * int(w)))
                for c in range(0, len(of), step):
                    yield from _compare(a[of[c : c + step]], b[of[c : c + step]], first, last, edge, sk.at[int(w)], n, part, inside)


def _compare(a, b, first, last, edge, sketch, n, part, inside) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One stack of tile pairs: exclusive-or and bit count of every row of the one with every row of the other."""
    i, j = first[a][:, None] + np.arange(edge), first[b][:, None] + np.arange(edge)
    ok = (i < last[a][:, None])[:, :, None] & (j < last[b][:, None])[:, None, :]
    i, j = np.minimum(i, len(n) - 1), np.minimum(j, len(n) - 1)
    differ = np.zeros(ok.shape, np.int64)
    for w in range(sketch.shape[1]):
        s = sketch[:, w]
        differ += np.bitwise_count(s[i][:, :, None] ^ s[j][:, None, :])
    ni, nj = n[i][:, :, None], n[j][:, None, :]
    ok &= (9 * differ <= ni + nj) & (5 * ni >= 4 * nj) & (i[:, :, None] < j[:, None, :])
    ok &= (part[i][:, :, None] != part[j][:, None, :]) | (part[i] == 0)[:, :, None]
    t, p, q = np.nonzero(ok)
    yield inside[i[t, p]], inside[j[t, q]]


def block_rows(signed: DataFrame) -> DataFrame:
    """One row per text and band: ``key, tid, n, sketch``."""
    return signed.select(F.explode("bands").alias("key"), "tid", "n", "sketch")


def _sketch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(widths in words, all words) of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return np.diff(offsets) // 8, np.frombuffer(data.tobytes(), np.uint64)


def candidates(rows: DataFrame, scratch: storage.Scratch, name: str = "hot", across: bool = False) -> DataFrame:
    """``x, y`` (x < y): text ids that share a block and pass the sketch test. No block is cut short.

    ``across``: rows have a column ``fresh``; pairs of two rows that are both not fresh are known already and left out.
    Blocks above BLOCK_ROWS are spread over cells of two parts each; their keys, under rows / BLOCK_ROWS in number, are
    counted first: none costs no join, up to MOST_HOT are broadcast, more are joined by a shuffle.
    """
    hot = rows.groupBy("key").count().filter(F.col("count") > BLOCK_ROWS).select("key", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("parts"))
    hot = scratch.cut(hot, name)
    found = hot.count()
    spread = rows.join(F.broadcast(hot) if found <= MOST_HOT else hot, "key", "left") if found else rows.withColumn("parts", F.lit(None).cast("int"))
    mine = F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.withColumn("mine", mine).withColumn("other", other)
    cell = F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    part = F.when((F.col("other") < 0) | (F.col("mine") == F.col("other")), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    extra = ["fresh"] if across else []
    cells = spread.select(cell.alias("cell"), part.cast("byte").alias("part"), "tid", "n", "sketch", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(cols: list[np.ndarray], words: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
            key, part, tid, n = cols[:4]
            xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, j in block_pairs(key, part, n, words, flat):
                if across:
                    ok = cols[-1][i] | cols[-1][j]
                    i, j = i[ok], j[ok]
                xs.append(np.minimum(tid[i], tid[j]))
                ys.append(np.maximum(tid[i], tid[j]))
            both = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], 1), axis=0)
            both = both[both[:, 0] < both[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["x", "y"])

        kept: list[tuple] = []
        held = 0
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns) if i != 4]
            kept.append((cols, *_sketch_words(batch.column(4))))
            held += batch.num_rows
            if held < 50_000:
                continue
            cols, words, flat = [np.concatenate(c) for c in zip(*(k[0] for k in kept), strict=True)], np.concatenate([k[1] for k in kept]), np.concatenate([k[2] for k in kept])
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last run may go on in the next batch
            of = int(words[:cut].sum())
            if cut:
                yield pairs([c[:cut] for c in cols], words[:cut], flat[:of])
            kept, held = [([c[cut:] for c in cols], words[cut:], flat[of:])], len(words) - cut
        if kept:
            yield pairs([np.concatenate(c) for c in zip(*(k[0] for k in kept), strict=True)], np.concatenate([k[1] for k in kept]), np.concatenate([k[2] for k in kept]))

    pairs_found = cells.repartition("cell").sortWithinPartitions("cell", "n").mapInArrow(run, "x bigint, y bigint")
    return pairs_found.distinct()


def compare(pairs: DataFrame, texts: DataFrame, least: tuple[int, int] = (4, 5), fields: Callable[[str, str], tuple] | None = None, names: str = "") -> DataFrame:
    """``x, y, shared, united`` of the candidates whose exact Jaccard similarity is at least the fraction ``least``.

    ``fields`` gives further small numbers of the two texts, named by ``names`` ("a int, b int").
    """
    a, b = texts.select(F.col("tid").alias("x"), F.col("text").alias("tx")), texts.select(F.col("tid").alias("y"), F.col("text").alias("ty"))
    more = [f.split()[0] for f in names.split(", ")] if names else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
        held: dict[str, set] = {}
        for batch in batches:
            p, q = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows: list[tuple] = []
            for k, (s, t) in enumerate(zip(p, q, strict=True)):
                if len(held) > 512:
                    held.clear()
                u = held.get(s) or held.setdefault(s, grams(s))
                v = held.get(t) or held.setdefault(t, grams(t))
                shared = len(u & v)
                united = len(u) + len(v) - shared
                if united and shared * least[1] >= united * least[0]:
                    rows.append((k, shared, united, *(fields(s, t) if fields else ())))
            cols = list(zip(*rows, strict=True)) or [()] * (3 + len(more))
            take = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["x", "y", "shared", "united", *more])

    joined = pairs.join(a, "x").join(b, "y").select("x", "y", "tx", "ty")
    return joined.mapInArrow(run, "x bigint, y bigint, shared int, united int" + (f", {names}" if names else ""))


def numbered(texts: DataFrame, scratch: storage.Scratch, name: str, start: int = 0) -> DataFrame:
    """``tid, h, text, n_rows`` of the distinct texts of ``text``; h is their 128-bit hash. Written, so that ids stay."""
    by = texts.groupBy(F.unhex(F.md5("text")).alias("h")).agg(F.min("text").alias("text"), F.count("*").alias("n_rows"))
    return scratch.cut(by.select((F.monotonically_increasing_id() + start).alias("tid"), "h", "text", "n_rows"), name)
