"""Top-k lookups and what neighbours say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.functions import scores
from cardmill.operators import candidates, cluster

TOP, NEIGHBOURS, VOTE_SCORE, VOTE_CONFIDENCE, VOTES = 20, 8, 0.70, 0.70, 2


def least_overlap(least: float) -> float:
    """The token Jaccard below which no pair of different keys scores ``least`` by its texts."""
    by_tokens, by_rest = scores.WEIGHTS[0], scores.WEIGHTS[1] + scores.WEIGHTS[2]
    return max(0.01, min(scores.TOKENS_WEAK, (least - by_rest) / by_tokens - 1e-9))


def lookup_pairs(queries: DataFrame, pool: DataFrame, least: float, vectors: DataFrame | None = None, key: str = "record_id") -> DataFrame:
    """``q, r, cosine``: every pair of a query and a pool record whose score can reach ``least``; a query never meets itself.

    Equal fingerprint, front or question key by equi-joins; overlapping tokens by a prefix-filtered join, which never
    meets on common tokens alone; with ``vectors`` (one row per key) pairs of a cosine of 0.96 or more, and the cosines
    of all the others.
    """
    q, r = queries.withColumnRenamed(key, "q"), pool.withColumnRenamed(key, "r")
    parts = []
    for column in ("fingerprint", "front_norm", "semantic_key"):
        some = F.col(column).isNotNull() & (F.col(column) != "")
        parts.append(q.filter(some).select("q", column).join(r.filter(some).select("r", column), column).select("q", "r"))
    out = candidates.jaccard_lookup(queries, pool, least_overlap(least), key=key)
    for p in parts:
        out = out.union(p)
    out = out.filter("q <> r").distinct().withColumn("cosine", F.lit(None).cast("double"))
    if vectors is None:
        return out
    held = [df.select(key).join(vectors.select(key, "vector"), key) for df in (queries, pool)]
    near = candidates.vector_join(held[0], scores.VECTOR_ALONE, key, other=held[1]).filter("a <> b").toDF("q", "r", "cosine")
    return candidates.with_cosine(out.unionByName(near).withColumnsRenamed({"q": "a", "r": "b"}), vectors, key).withColumnsRenamed({"a": "q", "b": "r"})


def top_similar(pairs: DataFrame, queries: DataFrame, pool: DataFrame, least: float = 0.75, k: int = TOP, key: str = "record_id", order: list[Column] | None = None) -> DataFrame:
    """``q, r, score, reasons, rank``: the best ``k`` pool records per query; ties by ``order`` of the pool (its id by default)."""
    rows = queries.withColumn("side", F.lit("q")).unionByName(pool.withColumn("side", F.lit("r")), allowMissingColumns=True).drop("side").dropDuplicates([key])
    scored = cluster.score_pairs(pairs.select(F.col("q").alias("a"), F.col("r").alias("b"), *[c for c in pairs.columns if c == "cosine"]), rows, least, key)
    by = Window.partitionBy("a").orderBy(F.desc("score"), *(order or [F.col("b")]))
    ranked = scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("q"), F.col("b").alias("r"), "score", "reasons", "rank")


def nearest_vectors(queries: DataFrame, pool: DataFrame, k: int = TOP, least: float = 0.0, key: str = "record_id") -> DataFrame:
    """``q, r, cosine, rank`` by exact blocked products."""
    found = candidates.vector_join(queries, least, key, other=pool).filter("a <> b")
    by = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select(F.col("a").alias("q"), F.col("b").alias("r"), "cosine", "rank")


def facet_vote(matches: DataFrame, facets: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``q, category, value, confidence, votes``: score-weighted vote of the first eight matches of 0.70 or more.

    ``matches``: q, r, score, rank; ``facets``: r, category, value; only values of ``taxonomy`` vote. A tie goes to the
    value of the nearest match. Confidence is rounded to three places before anything is compared with it.
    """
    near = matches.filter((F.col("rank") <= NEIGHBOURS) & (F.col("score") >= VOTE_SCORE))
    votes = near.join(facets, "r").join(F.broadcast(taxonomy.select("category", "value")), ["category", "value"])  # a fixed, small table
    per = votes.groupBy("q", "category", "value").agg(F.sum("score").alias("w"), F.count("*").alias("votes"), F.min("rank").alias("first"))
    whole = Window.partitionBy("q", "category")
    best = whole.orderBy(F.desc("w"), "first")
    per = per.withColumns({"all": F.sum("w").over(whole), "place": F.row_number().over(best)}).filter("place = 1")
    return per.select("q", "category", "value", F.round(F.col("w") / F.col("all"), 3).alias("confidence"), "votes")


def apply_votes(scopes: DataFrame, votes: DataFrame) -> DataFrame:
    """``q, scope, applied``: facets of missing categories with confidence 0.70 or more and two votes or more added to ``scope``."""
    sure = votes.filter((F.col("confidence") >= VOTE_CONFIDENCE) & (F.col("votes") >= VOTES))
    new = sure.groupBy("q").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "value")))).alias("new"))
    joined = scopes.join(new, "q", "left").withColumn("new", F.coalesce("new", F.create_map().cast("map<string,string>")))
    fresh = F.map_filter("new", lambda c, v: ~F.array_contains(F.map_keys("scope"), c))
    tags = F.array_sort(F.transform(F.map_entries(fresh), lambda e: F.concat(e["key"], F.lit("::"), e["value"])))
    return joined.select("q", F.map_concat("scope", fresh).alias("scope"), tags.alias("applied"))


def label_clusters(members: DataFrame, known: list[str], stop: list[str], least_size: int = 3) -> DataFrame:
    """``cluster, label, size, is_new`` from ``cluster, id, words``: the word of most fronts, if in half of them and at least two.

    Words of more than three letters that are no stop words count once a front; ties go to the first in order.
    """
    size = members.groupBy("cluster").agg(F.count("*").alias("size")).filter(F.col("size") >= least_size)
    words = members.select("cluster", F.explode(F.array_distinct("words")).alias("label")).filter((F.length("label") > 3) & ~F.col("label").isin(stop))
    counted = words.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    best = Window.partitionBy("cluster").orderBy(F.desc("n"), "label")
    top = counted.withColumn("place", F.row_number().over(best)).filter("place = 1").join(size, "cluster")
    enough = F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("size") / 2))
    return top.filter(enough).select("cluster", "label", "size", (~F.col("label").isin(known)).alias("is_new"))
