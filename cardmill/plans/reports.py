"""The shapes in which records, clusters and matches leave the library: struct columns, JSON at the very end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.functions import text

EXCERPT, FRONT, SHORT_ID = 160, 80, 8


def record_struct() -> Column:
    """One record: ids, place, front, the beginning of the back, facets and question."""
    some = lambda c: F.col(c).alias(c)
    return F.struct(F.col("record_id").alias("id"), some("deck"), some("note_type"), some("front"), text.excerpt(F.coalesce("back", F.lit("")), EXCERPT).alias("back_excerpt"), some("scope"), some("intent"), some("semantic_key"))


def clusters_with_members(clusters: DataFrame, members: DataFrame, records: DataFrame, sample: int = 50) -> DataFrame:
    """``cluster_id, size, reasons, score_floor, representative, members``: the first ``sample`` members in full, for a page or a file.

    ``size`` counts all of them; all members as rows are in ``members`` itself.
    """
    shaped = records.select(F.col("record_id").alias("id"), record_struct().alias("record"))
    rep = shaped.select(F.col("id").alias("representative"), F.col("record").alias("shown"))
    place = F.row_number().over(_by("cluster_id", "id"))
    first = members.withColumn("at", place).filter(F.col("at") <= sample).join(shaped, "id").groupBy("cluster_id").agg(F.transform(_in_order(F.collect_list(F.struct("at", "record")), "at"), lambda x: x["record"]).alias("members"))
    out = clusters.join(rep, "representative").join(first, "cluster_id")
    return out.select("cluster_id", "size", F.col("shown").alias("representative"), "members", "reasons", "score_floor")


def matches(found: DataFrame, records: DataFrame, verbose: bool = False, limit: int = 2) -> DataFrame:
    """``q, matches``: what was found for each query (``q, r, score, reasons, rank``, perhaps ``version``), all of it or the first ``limit`` in short.

    In short a comparison of versions is shown only if it says that the new card should replace the old one.
    """
    version = F.col("version") if "version" in found.columns else F.lit(None).cast("string")
    rows = found.join(records.select(F.col("record_id").alias("r"), "deck", record_struct().alias("record")), "r")
    if verbose:
        shown = F.struct("rank", "record", "score", "reasons", version.alias("version"))
    else:
        rows = rows.filter(F.col("rank") <= limit)
        shown = F.struct("rank", F.col("r").alias("id"), "deck", "score", "reasons", F.when(version == "replace_old_with_new", version).alias("version"))
    return rows.groupBy("q").agg(_in_order(F.collect_list(shown), "rank").alias("matches"))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document a row, in the column ``json``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def _by(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def _in_order(rows: Column, by: str) -> Column:
    """An array of structs by one of their numbers; the structs hold maps, which have no order."""
    return F.array_sort(rows, lambda x, y: (x[by] - y[by]).cast("int"))
