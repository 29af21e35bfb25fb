"""Scored edges, components and their summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill import storage
from cardmill.functions import scores

FIELDS = {"fingerprint": "fingerprint", "front": "front_norm", "key": "semantic_key", "tokens": "content", "trigrams": "trigrams", "backs": "back_stems", "vendor": "vendor"}


def score_pairs(pairs: DataFrame, records: DataFrame, least: float, key: str = "record_id") -> DataFrame:
    """``a, b, score, reasons`` of candidate pairs whose score is at least ``least``; the score is rounded after the test.

    Only features travel to the pairs, never the texts. ``pairs`` may carry a ``cosine``. Records need a ``vendor``
    (null where there is none), as vectors alone never link records of two vendors.
    """
    rows = records
    sides = []
    for side in ("a", "b"):
        sides.append(rows.select(F.col(key).alias(side), *[F.col(c).alias(f"{side}_{n}") for n, c in FIELDS.items()]))
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    cos: Column | None = F.col("cosine") if "cosine" in pairs.columns else None
    score, reasons = scores.pair_score(*[{n: F.col(f"{s}_{n}") for n in FIELDS} for s in "ab"], cos)
    kept = joined.select("a", "b", score.alias("score"), reasons.alias("reasons")).filter(F.col("score") >= least)
    return kept.withColumn("score", F.round("score", 4))


def components(edges: DataFrame, scratch: storage.Scratch, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``id, root``: the smallest id of each component, by contraction to the first neighbour in a random order.

    Each round moves every vertex to the first vertex of its neighbourhood by a hash that changes with the round, and
    replaces the edges by those between the targets; loops drop out. The order being random, rounds are logarithmic
    even for long chains. Each round's tables are written to the shared folder.
    """
    graph = scratch.cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y").distinct(), "graph-0")
    moves: list[DataFrame] = []
    for k in range(most_rounds):
        if graph.isEmpty():
            break
        hubs = storage.hot_keys(graph, ["x", "y"], graph.count(), scratch, f"hubs-{k}")
        order = lambda c, k=k: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("v"))
        seen = graph.select("x", order("y").alias("o")).union(graph.select("y", order("x"))).union(graph.select("x", order("x"))).union(graph.select("y", order("y")))
        move = scratch.cut(seen.groupBy(F.col("x").alias("v")).agg(F.min("o").alias("o")).select("v", F.col("o.v").alias("to")), f"move-{k}")
        moves.append(move)
        moved = storage.join_at(graph, "x", move.withColumnRenamed("to", "p"), hubs)
        moved = storage.join_at(moved, "y", move.withColumnRenamed("to", "q"), hubs).filter("p <> q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
        graph = scratch.cut(moved.distinct(), f"graph-{k + 1}")
        scratch.drop(f"graph-{k}")
    else:
        raise RuntimeError(f"edges are left after {most_rounds} rounds")
    if not moves:
        return graph.select(F.col("x").alias("id"), F.col("y").alias("root"))
    answer = moves[-1]
    for k in range(len(moves) - 2, -1, -1):
        up = answer.select(F.col("v").alias("to"), F.col("to").alias("above"))
        answer = scratch.cut(moves[k].join(up, "to", "left").select("v", F.coalesce("above", "to").alias("to")), f"answer-{k}")
    first = answer.groupBy("to").agg(F.min("v").alias("root"), F.count("*").alias("n"))
    return storage.join_by_size(answer, first, "to", "n", F.lit(answer.count())).select(F.col("v").alias("id"), "root")


def members(roots: DataFrame, scratch: storage.Scratch) -> DataFrame:
    """``cluster_id, root, id, size``: a row for every member. The cluster's id is drawn from its members' ids as text, in order.

    The digest is taken over the sorted rows as they stream by, so that a cluster of any size needs no memory.
    """
    size = roots.groupBy("root").agg(F.count("*").alias("size"))
    sorted_rows = roots.select("root", F.col("id").cast("string").alias("id")).repartition("root").sortWithinPartitions("root", "id")
    kind = roots.schema["root"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        at, held, out = None, None, []
        for batch in batches:
            for root, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is None or root != at:
                    if held is not None:
                        out.append((at, held.hexdigest()[:12]))
                    at, held = root, hashlib.sha1(i.encode())
                else:
                    held.update(b"||" + i.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in ((0, batch.schema.field(0).type), (1, pa.string()))], names=["root", "cluster_id"])
            out = []
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], batch.schema.field(0).type), pa.array([held.hexdigest()[:12]])], names=["root", "cluster_id"])

    named = scratch.cut(sorted_rows.mapInArrow(digest, f"root {kind}, cluster_id string").join(size, "root"), "named")
    return storage.join_by_size(roots, named, "root", "size", F.lit(roots.count())).select("cluster_id", "root", "id", "size")


def summaries(edges: DataFrame, found: DataFrame, records: DataFrame | None = None, a: str = "a") -> DataFrame:
    """``cluster_id, representative, size, reasons, score_floor`` of the clusters in ``found`` (see ``members``).

    The representative is the first member in record order, if ``records`` (``record_id`` and its ``place``) are given,
    else the smallest id. Only counts, a minimum and the few reason codes are gathered of a cluster.
    """
    inside = edges.join(found.select(F.col("id").alias(a), "cluster_id"), a)
    floors = inside.groupBy("cluster_id").agg(F.min("score").alias("score_floor"))
    codes = inside.select("cluster_id", F.explode("reasons").alias("reason")).groupBy("cluster_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    first = found if records is None else found.join(records.select(F.col("record_id").alias("id"), "place"), "id")
    order = F.col("id") if records is None else F.struct("place", F.col("id").cast("string").alias("text"), "id")
    first = first.groupBy("cluster_id").agg(F.min(order).alias("f"), F.first("size").alias("size"))
    rep = F.col("f") if records is None else F.col("f.id")
    out = first.join(floors, "cluster_id").join(codes, "cluster_id")
    return out.select("cluster_id", rep.alias("representative"), "size", "reasons", F.round("score_floor", 4).alias("score_floor"))


def pair_metrics(records: DataFrame, sizes: DataFrame, distinct: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: cards, raw candidates (closed form over block sizes), distinct candidate ``pairs`` (one row), clusters, and the share of all pairs saved."""
    n = records.agg(F.count("*").alias("cards"))
    raw = sizes.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("raw_candidates"))
    found = clusters.agg(F.count("*").alias("clusters"))
    one = n.crossJoin(raw).crossJoin(distinct).crossJoin(found)  # four one-row tables
    every = F.col("cards") * (F.col("cards") - 1) / 2
    return one.withColumn("reduction_pct", F.when(every > 0, F.round((1 - F.col("pairs") / every) * 100, 2)).otherwise(0.0))
