"""Groups of linked records, by low-diameter decomposition.

Every vertex draws an exponentially distributed head start (cut to a few steps) and clusters grow from the early ones:
after ``steps`` relaxations each vertex belongs to the centre that reached it first. Clusters become super-vertices,
the links between clusters the next graph, until no link is left; the assignments are composed from the last level
down. The level count is logarithmic in the diameter, each level a few joins of fixed form.

Vertices of very many links, of which there are few, get their state by a broadcast, so that their links stay where
they are and meet in no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill import storage

def _start(vertex: Column, level: int, beta: float, steps: int) -> Column:
    """The step at which a vertex starts its own cluster: ``steps`` less its exponential shift; from a hash, so repeatable."""
    uniform = (F.pmod(F.xxhash64(F.lit(level), vertex), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.greatest(F.lit(0), F.lit(steps) - F.floor(-F.log(uniform) / beta)).cast("int")


def decompose(links: DataFrame, level: int = 0, beta: float = 0.25, steps: int = 6, hubs: DataFrame | None = None) -> DataFrame:
    """One decomposition of undirected ``a, b`` links: ``v, c``, the centre of every vertex.

    A vertex that a cluster reaches before its own start joins the one that comes first, ties by the smaller centre;
    no path is longer than ``steps``, hence as many relaxations are exact.
    """
    arcs = links.select("a", "b", F.lit(1).alias("w")).union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1)))
    # with an arc of length 0 to itself a vertex keeps its state: each step refers to the one before only once
    arcs = arcs.union(arcs.select("a", F.col("a").alias("b"), F.lit(0)).distinct())
    state = None
    for _ in range(steps):
        if state is None:  # the first relaxation needs no join: every vertex's state follows from its name
            sent = arcs.select(F.col("b").alias("v"), F.struct((_start(F.col("a"), level, beta, steps) + F.col("w")).alias("d"), F.col("a").alias("c")).alias("s"))
        else:
            sent = storage.join_at(arcs, "a", state, hubs).select(F.col("b").alias("v"), F.struct((F.col("s.d") + F.col("w")).alias("d"), F.col("s.c").alias("c")).alias("s"))
        state = sent.groupBy("v").agg(F.min("s").alias("s"))
    return state.select("v", F.col("s.c").alias("c"))


def components(links: DataFrame, scratch: storage.Scratch | None = None, beta: float = 0.25, steps: int = 6, hub: int = storage.HUB, max_levels: int = 100) -> DataFrame:
    """``v, root``: for every vertex of ``a, b`` (strings or numbers) the smallest vertex of its component.

    The graph is decomposed and contracted until no link is left, at every size alike. Self-links name no vertex, null
    ends are left out, repeats and order don't matter, no links give no rows.
    """
    scratch = scratch or storage.Scratch(links.sparkSession, "components")
    pairs = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    graph = scratch.cut(pairs, "links-0")
    maps: list[DataFrame] = []
    for level in range(max_levels):
        left = graph.count()
        if not left:
            break
        hubs = storage.hot_keys(graph, ["a", "b"], left, scratch, f"hubs-{level}", hub)
        maps.append(scratch.cut(decompose(graph, level, beta, steps, hubs), f"map-{level}"))
        to = maps[-1]
        moved = storage.join_at(graph, "a", to.withColumnRenamed("c", "ca"), hubs)
        moved = storage.join_at(moved, "b", to.withColumnRenamed("c", "cb"), hubs).filter("ca <> cb")
        graph = scratch.cut(moved.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), f"links-{level + 1}")
        scratch.drop(f"links-{level}")
    else:
        raise RuntimeError(f"links are left after {max_levels} levels")
    if not maps:
        return graph.select(F.col("a").alias("v"), F.col("b").alias("root"))
    # down: a centre that is a vertex of the next level takes its answer from there, one that is not is final
    answer, vertices = maps[-1], maps[-1].count()
    for level in range(len(maps) - 2, -1, -1):
        vertices = maps[level].count()
        answer = scratch.cut(_compose(maps[level], answer, vertices, hub, scratch, f"above-{level}"), f"answer-{level}")
    least = answer.groupBy("c").agg(F.min("v").alias("root"), F.count("*").alias("n"))
    return _by_centre(answer, least, vertices, hub, scratch, "least").select("v", "root")


def _by_centre(rows: DataFrame, centres: DataFrame, total: int, hub: int, scratch: storage.Scratch, name: str) -> DataFrame:
    """``rows`` (``c`` among others) with what ``centres`` say of each ``c`` and its number of rows ``n``. Where all rows of one centre are still few, by a plain join."""
    if total <= hub:
        return rows.join(centres, "c")
    return storage.join_by_size(rows, scratch.cut(centres, name), "c", "n", F.lit(total))


def _compose(lower: DataFrame, upper: DataFrame, total: int, hub: int, scratch: storage.Scratch, name: str) -> DataFrame:
    """``v, c`` of the lower level with the centre that the upper level gives its centre, if any."""
    sizes = lower.groupBy("c").agg(F.count("*").alias("n"))
    named = sizes.join(upper.select(F.col("v").alias("c"), F.col("c").alias("above")), "c", "left").select("c", "n", F.coalesce("above", "c").alias("above"))
    return _by_centre(lower, named, total, hub, scratch, name).select("v", F.col("above").alias("c"))


def linked_records(edges: DataFrame, least_score: float = 0.90) -> DataFrame:
    """``record_id, group_id`` from ``left_id, right_id, score``: ids trimmed and lower-cased, links of ``least_score`` or more.

    Null and NaN scores, null or blank ids and links of a record with itself link nothing.
    """
    name = lambda c: F.regexp_replace(F.lower(F.col(c)), r"(?U)^\s+|\s+$", "")
    links = edges.filter((F.col("score") >= least_score) & ~F.isnan("score")).select(name("left_id").alias("a"), name("right_id").alias("b"))
    links = links.filter("a <> '' AND b <> ''")
    return components(links).select(F.col("v").alias("record_id"), F.col("root").alias("group_id"))
