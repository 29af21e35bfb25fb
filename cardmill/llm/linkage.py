"""New batches against everything accepted before, without going through the history again.

The history is a set of tables under one folder, each in hash buckets of its key: blocking keys, sketch, number, text
and cards of every front (``bands``, ``sketches``, ``names``, ``texts``, ``counts``), links between fronts with their weight, the representative mapping of merged clusters (``parents``, a union-find forest), the first batch that accepted
each front, each cluster and each fingerprint. ``manifest.json`` names the parts of each table, the epoch and the
learned weights; it is replaced last, so that an epoch that dies leaves the history as it was, and any later session
goes on from it.

An epoch takes in one batch or a run of batches. It signs only fronts not seen before, probes the buckets that their
blocking keys fall into, compares field by field, adds up the learned agreement weights, links what reaches the cutoff,
and adds to the forest only the clusters that new links join. Whether a card repeats an earlier one is then read from
the representatives: only a card whose cluster was accepted in an earlier batch is looked at further, by its own links.

A front met again is not compared again: its links are in the table. Batches must be added in time order; within an
epoch, order is settled by comparing batch ids, which gives the same answer as one epoch per batch.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill import storage
from cardmill.llm import shingles
from cardmill.operators import cluster

PLAN = shingles.Plan(rows=5, bands=30)
ACCEPTED = ("aprobada", "subida")
#: Rows of a bucket; a part of a table has as many buckets as its rows need.
BUCKET_ROWS = 1 << 20
#: Keys up to this number are broadcast to the table that they probe (some 30 MB).
MOST_KEYS = 500_000
#: Each table's columns, the first being its key.
_TABLES = {
    "names": "h binary, tid bigint",
    "texts": "tid bigint, text string",
    "counts": "tid bigint, n bigint",
    "bands": "key bigint, tid bigint",
    "sketches": "tid bigint, n int, sketch binary",
    "links": "tid bigint, other bigint, weight double",
    "parents": "tid bigint, parent bigint",
    "accepted": "tid bigint, batch string",
    "firsts": "tid bigint, batch string",
    "prints": "fingerprint string, batch string",
}
#: What is compared of two fronts, and the number of values of each: similarity (below .65, .8, .9, above), digits, first word, length.
FIELDS = {"level": 4, "digits": 2, "opening": 2, "length": 2}
_LINKED = 2  # the similarity level from which the rule (0.8 or more) holds


def learn_weights(patterns: dict[tuple, int], rounds: int = 50) -> list[list[float]]:
    """Agreement weights by expectation-maximization over counts of comparison patterns (Fellegi and Sunter).

    Fields are taken as independent given match or non-match; a value's weight is the log2 ratio of its two
    probabilities. One list per field, one weight per value, also of values not seen.
    """
    total, sizes = sum(patterns.values()), list(FIELDS.values())
    # starts from: a match agrees best in each field four times out of five
    m = [[0.8 if v == n - 1 else 0.2 / (n - 1) for v in range(n)] for n in sizes]
    u, share = [[1 / n] * n for n in sizes], 0.5
    for _ in range(rounds if total else 0):
        post = {}
        for p in patterns:
            a, b = share, 1 - share
            for f, v in enumerate(p):
                a, b = a * m[f][v], b * u[f][v]
            post[p] = a / (a + b) if a + b > 0 else 0.5
        matched = sum(n * post[p] for p, n in patterns.items())
        share = min(max(matched / total, 1e-6), 1 - 1e-6)
        for f, n in enumerate(sizes):
            for v in range(n):
                hit = sum(c * post[p] for p, c in patterns.items() if p[f] == v)
                miss = sum(c * (1 - post[p]) for p, c in patterns.items() if p[f] == v)
                m[f][v], u[f][v] = (hit + 0.5) / (matched + 0.5 * n), (miss + 0.5) / (total - matched + 0.5 * n)
    return [[round(math.log2(a / b), 4) for a, b in zip(x, y, strict=True)] for x, y in zip(m, u, strict=True)]


def calibrated(weights: list[list[float]]) -> tuple[list[list[float]], float]:
    """(weights, cutoff) with which the sum of a pair's weights reaches the cutoff just if its similarity is 0.8 or more.

    The other fields may outweigh a level by the sum of their spans; if they do, the levels that the rule accepts are
    raised by what is missing. So the cutoff parts all possible patterns, not only those seen.
    """
    level, *others = weights
    span = sum(max(w) - min(w) for w in others)
    missing = max(0.0, span + 1.0 - (min(level[_LINKED:]) - max(level[:_LINKED])))
    level = [w + missing * (v >= _LINKED) for v, w in enumerate(level)]
    least = min(level[_LINKED:]) + sum(map(min, others))
    return [level, *others], round(least - 0.5, 4)


def agreement(values: dict[str, Column], weights: list[list[float]]) -> Column:
    """The sum of the weights of the fields' values."""
    out = F.lit(0.0)
    for (name, n), own in zip(FIELDS.items(), weights, strict=True):
        out = out + F.element_at(F.array(*[F.lit(own[v]) for v in range(n)]), values[name] + 1)
    return out


_DIGITS = re.compile(r"\D+")


def _compare(a: str, b: str) -> tuple[int, int, int]:
    return int(_DIGITS.sub(" ", a) == _DIGITS.sub(" ", b)), int(a.partition(" ")[0] == b.partition(" ")[0]), int(abs(len(a) - len(b)) <= 2)


class History:
    """The persisted tables under ``path``, as of the last epoch that was completed there."""

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows = spark, path, bucket_rows
        self.work = storage.Scratch(spark, "linkage-work")
        held = storage.read_text(spark, f"{path}/manifest.json")
        self.state = json.loads(held) if held else {"epoch": 0, "weights": None, "cutoff": None, "tables": {n: [] for n in _TABLES}}

    # tables

    def _buckets(self, rows: int) -> int:
        return 1 << max(0, math.ceil(rows / self.bucket_rows) - 1).bit_length()

    def _write(self, name: str, df: DataFrame, rows: int, folder: str) -> dict:
        """A part of a table; ``rows`` is about how many it has. One bucket needs no shuffle."""
        n, key = self._buckets(rows), _TABLES[name].split()[0]
        if n == 1:
            df.write.mode("overwrite").parquet(folder)
        else:
            df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition(n, "bucket").sortWithinPartitions("bucket", *[c for c in df.columns if c.endswith("tid")]).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        return {"folder": folder, "rows": rows, "buckets": n}

    def _add(self, name: str, df: DataFrame, rows: int) -> DataFrame:
        part = self._write(name, df, rows, f"{self.path}/{name}/{self.state['epoch'] + 1}")
        self.state["tables"][name].append(part)
        return self._read(name, part)

    def _read(self, name: str, part: dict, only: list[int] | None = None) -> DataFrame:
        if part["buckets"] == 1:
            return self.spark.read.schema(_TABLES[name]).parquet(part["folder"])
        df = self.spark.read.schema(_TABLES[name] + ", bucket int").parquet(part["folder"])
        return (df if only is None else df.filter(F.col("bucket").isin(only))).drop("bucket")

    def table(self, name: str) -> DataFrame:
        """All rows of a table."""
        return self._union(name, [self._read(name, p) for p in self.state["tables"][name]])

    def _union(self, name: str, parts: list[DataFrame]) -> DataFrame:
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return self.spark.createDataFrame([], _TABLES[name]) if out is None else out

    def _probed(self, name: str, part: dict, keys: DataFrame, n_keys: int) -> DataFrame:
        """The rows of a part in the buckets that ``keys`` (one column, about ``n_keys`` rows) fall into."""
        n = part["buckets"]
        if n_keys >= 4 * n:  # nearly all buckets are touched
            return self._read(name, part)
        touched = keys.select(F.pmod(F.xxhash64(keys.columns[0]), F.lit(n)).cast("int")).distinct().collect()  # under n_keys numbers
        return self._read(name, part, [r[0] for r in touched])

    def probe(self, name: str, keys: DataFrame, n_keys: int) -> DataFrame:
        """The rows of a table whose key is in ``keys``, read from the buckets that these fall into."""
        key = _TABLES[name].split()[0]
        keys = keys.toDF(key)
        wanted = F.broadcast(keys.distinct()) if n_keys <= MOST_KEYS else keys
        return self._union(name, [self._probed(name, p, keys, n_keys).join(wanted, key, "left_semi") for p in self.state["tables"][name]])

    def find(self, rows: DataFrame, n_rows: int) -> DataFrame:
        """``rows`` with ``rep``, the representative of the cluster of their ``tid``.

        A part of the forest maps the representatives of its time to those that came to stand for them, in one step.
        """
        out = rows.withColumn("rep", F.col("tid"))
        for part in self.state["tables"]["parents"]:
            held = self._probed("parents", part, out.select("rep"), n_rows).toDF("rep", "above")
            out = out.join(held, "rep", "left").withColumn("rep", F.coalesce("above", "rep")).drop("above")
        return out

    def _commit(self) -> None:
        """Merge parts that aren't half as large as the one before (their number stays logarithmic), then replace the manifest."""
        self.state["epoch"] += 1
        old = []
        for name, parts in self.state["tables"].items():
            while len(parts) > 1 and parts[-2]["rows"] <= 2 * parts[-1]["rows"]:
                b, a = parts.pop(), parts.pop()
                x, y = self._read(name, a), self._read(name, b)
                if name == "parents":
                    x = x.join(y.toDF("parent", "above"), "parent", "left").select("tid", F.coalesce("above", "parent").alias("parent"))
                merged = x.unionByName(y)
                if name in ("accepted", "firsts", "prints"):
                    merged = merged.groupBy(merged.columns[0]).agg(F.min("batch").alias("batch"))
                if name == "counts":
                    merged = merged.groupBy("tid").agg(F.sum("n").alias("n"))
                parts.append(self._write(name, merged, a["rows"] + b["rows"], f"{self.path}/{name}/{self.state['epoch']}-merged-{len(parts)}"))
                old += [a["folder"], b["folder"]]
        storage.write_text(self.spark, f"{self.path}/manifest.json", json.dumps(self.state))
        for folder in old:
            storage.delete(self.spark, folder)

    # an epoch

    def process(self, cards: DataFrame) -> DataFrame:
        """Take in the cards of one or more batches (``id, batch, status, fingerprint, front``); gives the ids that repeat earlier ones."""
        with storage.shuffles_released(self.spark):
            return self._process(cards)

    def _process(self, cards: DataFrame) -> DataFrame:
        epoch, work = self.state["epoch"] + 1, self.work
        cards = cards.withColumn("h", F.when(F.length("front") >= 3, F.unhex(F.md5("front"))))
        total = cards.count()
        ok = F.when(F.col("status").isin(*ACCEPTED), F.col("batch"))
        fronts = cards.filter("h IS NOT NULL").groupBy("h").agg(F.min("front").alias("text"), F.count("*").alias("n_rows"), F.min(ok).alias("accepted"), F.max("batch").alias("last"))
        if self.state["tables"]["names"]:
            named = fronts.join(self.probe("names", fronts.select("h"), total).withColumnRenamed("tid", "known"), "h", "left")
        else:
            named = fronts.withColumn("known", F.lit(None).cast("bigint"))
        named = named.withColumn("tid", F.coalesce("known", F.monotonically_increasing_id() + (epoch << 50)))
        named = work.cut(named, f"named-{epoch}")  # written, so that the ids stay
        fresh = named.filter("known IS NULL")
        n_new = fresh.count()
        self._add("names", fresh.select("h", "tid"), n_new)
        new = self._add("texts", fresh.select("tid", "text"), n_new)
        self._add("counts", named.select("tid", F.col("n_rows").alias("n")), total)
        links = self._link(new, n_new, epoch)
        self._add("accepted", named.filter("accepted IS NOT NULL").select("tid", F.col("accepted").alias("batch")), total)
        self._add("prints", cards.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min(ok).alias("batch")).filter("batch IS NOT NULL"), total)
        self._merge_clusters(links, n_new, epoch)
        found = work.cut(self._found(cards, named, total, epoch), f"found-{epoch}")
        self._commit()
        work.drop(*[f"{n}-{epoch}" for n in ("named", "mine", "size", "suspects", "arcs", "first", "print")])
        return found

    def _link(self, new: DataFrame, n_new: int, epoch: int) -> DataFrame:
        """The links of the new fronts, in both directions, with their weights; the weights are learned from the first epoch that has pairs.

        The steps that take most disk come one after the other: candidates are written before the tables of the epoch
        are, and what only they need goes before texts are joined to them.
        """
        work = self.work
        signed = work.cut(shingles.with_signatures(new, PLAN), f"signed-{epoch}")
        rows = shingles.block_rows(signed)
        if self.state["tables"]["bands"]:
            n_keys = n_new * PLAN.bands
            probed = work.cut(self.probe("bands", rows.select("key"), n_keys), f"probed-{epoch}")
            probed = probed.join(self.probe("sketches", probed.select("tid"), probed.count()), "tid")
            both = rows.withColumn("fresh", F.lit(True)).unionByName(probed.withColumn("fresh", F.lit(False)))
            pairs = work.cut(shingles.candidates(both, work, f"hot-{epoch}", across=True), f"pairs-{epoch}")
            ends = pairs.select(F.explode(F.array("x", "y")).alias("tid")).filter(F.col("tid") < (epoch << 50)).distinct()
            texts = self.probe("texts", ends, 2 * pairs.count()).select("tid", "text")
            # what is new was added to the table already; old ends are those with smaller numbers
            texts = texts.filter(F.col("tid") < (epoch << 50)).unionByName(new.select("tid", "text"))
        else:
            pairs, texts = work.cut(shingles.candidates(rows, work, f"hot-{epoch}"), f"pairs-{epoch}"), new.select("tid", "text")
        self._add("bands", rows.select("key", "tid"), n_new * PLAN.bands)
        self._add("sketches", signed.select("tid", "n", "sketch"), n_new)
        work.drop(*[f"{n}-{epoch}" for n in ("signed", "probed", "hot")])
        compared = shingles.compare(pairs, texts, (1, 2), _compare, "digits int, opening int, length int")
        level = F.when(F.col("shared") * 10 >= F.col("united") * 9, 3).when(F.col("shared") * 5 >= F.col("united") * 4, _LINKED).when(F.col("shared") * 20 >= F.col("united") * 13, 1).otherwise(0)
        compared = work.cut(compared.select("x", "y", level.alias("level"), "digits", "opening", "length"), f"compared-{epoch}")
        if self.state["weights"] is None:
            patterns = {tuple(r[f] for f in FIELDS): r["count"] for r in compared.groupBy(*FIELDS).count().collect()}  # at most as many as there are patterns
            if patterns:
                self.state["weights"], self.state["cutoff"] = calibrated(learn_weights(patterns))
        weights, cutoff = (self.state["weights"], self.state["cutoff"]) if self.state["weights"] else calibrated(learn_weights({}))
        linked = compared.withColumn("weight", agreement({f: F.col(f) for f in FIELDS}, weights)).filter(F.col("weight") >= cutoff)
        ends = F.explode(F.array(F.struct(F.col("x").alias("tid"), F.col("y").alias("other")), F.struct(F.col("y").alias("tid"), F.col("x").alias("other")))).alias("e")
        links = self._add("links", linked.select("weight", ends).select("e.tid", "e.other", "weight"), 2 * n_new)
        work.drop(f"compared-{epoch}", f"pairs-{epoch}")
        return links

    def _merge_clusters(self, links: DataFrame, n_new: int, epoch: int) -> None:
        """Union by representatives: one row for each cluster that new links make part of another; nothing else is touched."""
        edges = links.filter("tid < other").select("tid", "other")
        if self.state["tables"]["parents"]:
            a = self.find(edges, 2 * n_new).select(F.col("rep").alias("a"), F.col("other").alias("tid"))
            edges = self.find(a, 2 * n_new).select("a", F.col("rep").alias("b")).filter("a <> b")
        else:
            edges = edges.toDF("a", "b")
        roots = cluster.components(edges, storage.Scratch(self.spark, "linkage-clusters"))
        self._add("parents", roots.filter("id <> root").select(F.col("id").alias("tid"), F.col("root").alias("parent")), n_new)

    def _found(self, cards: DataFrame, named: DataFrame, total: int, epoch: int) -> DataFrame:
        work = self.work
        mine = work.cut(self.find(named.select("tid", "h", "n_rows", "accepted", "last"), total), f"mine-{epoch}")
        # the first batch that accepted anything of a cluster: what came in now, and what clusters bring along that were merged
        now = mine.filter("accepted IS NOT NULL").select(F.col("rep").alias("tid"), F.col("accepted").alias("batch"))
        if self.state["tables"]["firsts"]:
            moved = self._read("parents", self.state["tables"]["parents"][-1])
            brought = self.probe("firsts", moved.select("tid"), moved.count())
            now = now.unionByName(brought.join(moved, "tid").select(F.col("parent").alias("tid"), "batch"))
        self._add("firsts", now.groupBy("tid").agg(F.min("batch").alias("batch")), total)
        reps = mine.select("rep").distinct()
        first = self.probe("firsts", reps, total).groupBy(F.col("tid").alias("rep")).agg(F.min("batch").alias("first"))
        size = mine.groupBy("rep").agg(F.count("*").alias("n")).join(first, "rep")
        suspects = storage.join_by_size(mine, work.cut(size, f"size-{epoch}"), "rep", "n", F.lit(total)).filter("first < last").select("tid", "h", "n_rows")
        suspects = work.cut(suspects, f"suspects-{epoch}")
        # of these, the exact check: the card's own front, or one directly linked to it, was accepted earlier
        arcs = self.probe("links", suspects.select("tid"), total).select("tid", "other")
        arcs = work.cut(arcs.unionByName(suspects.select("tid", F.col("tid").alias("other"))), f"arcs-{epoch}")
        accepted = self.probe("accepted", arcs.select("other"), arcs.count())
        near = arcs.join(accepted.toDF("other", "batch"), "other").groupBy("tid").agg(F.min("batch").alias("first"))
        per_front = work.cut(suspects.join(near, "tid").select("h", "n_rows", "first"), f"first-{epoch}")
        by_front = storage.join_by_size(cards.filter("h IS NOT NULL").select("id", "batch", "h"), per_front, "h", "n_rows", F.lit(total)).filter("first < batch").select("id")
        # a shared fingerprint is agreement of its own
        sizes = cards.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count("*").alias("n"))
        prints = self.probe("prints", sizes.select("fingerprint"), total).groupBy("fingerprint").agg(F.min("batch").alias("first"))
        per_print = work.cut(sizes.join(prints, "fingerprint"), f"print-{epoch}")
        by_print = storage.join_by_size(cards.filter("fingerprint IS NOT NULL").select("id", "batch", "fingerprint"), per_print, "fingerprint", "n", F.lit(total)).filter("first < batch").select("id")
        return by_front.unionByName(by_print).distinct()


def _batched(cards: DataFrame) -> DataFrame:
    """One row per id with a batch; rows repeated under one id are one record."""
    rows = cards.filter("id IS NOT NULL AND ingest_batch IS NOT NULL")
    kept = F.struct(F.col("ingest_batch").alias("batch"), "status", "fingerprint", F.col("front_normalized").alias("front"))
    return rows.groupBy("id").agg(F.min(kept).alias("c")).select("id", "c.*")


def run(cards: DataFrame, path: str | None = None) -> tuple[History, DataFrame]:
    """All batches but the newest as one epoch, then the newest against the persisted tables; gives the ids found in both.

    ``path``: a folder for a history that is to stay; without one it goes with the session.
    """
    spark = cards.sparkSession
    scratch = storage.Scratch(spark, "linkage")
    with storage.shuffles_released(spark):
        rows = scratch.cut(_batched(cards), "cards")
    newest = rows.agg(F.max("batch")).first()[0]
    history = History(spark, path or scratch.path("history"))
    found = history.process(rows.filter(F.col("batch") != newest))
    return history, found.unionByName(history.process(rows.filter(F.col("batch") == newest)))


def repeated_cards(cards: DataFrame) -> DataFrame:
    """``id``: cards that repeat or nearly repeat a card accepted in an earlier batch. Cards without batch take no part."""
    return run(cards)[1]


def front_clusters(cards: DataFrame) -> DataFrame:
    """``front, cluster_front, n_cards``: every front with the first text, in order, of its cluster and its number of cards."""
    history, _ = run(cards)
    texts = history.table("texts")
    n = texts.count()
    with storage.shuffles_released(history.spark):
        mine = history.work.cut(history.find(texts, n), "members")
        per = history.work.cut(mine.groupBy("rep").agg(F.count("*").alias("n"), F.min("text").alias("cluster_front")), "per")
    named = storage.join_by_size(mine, per, "rep", "n", F.lit(n))
    counts = history.table("counts").groupBy("tid").agg(F.sum("n").alias("n_cards"))
    return named.join(counts, "tid").select(F.col("text").alias("front"), "cluster_front", "n_cards")
