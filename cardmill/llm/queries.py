"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardmill.llm import components, encode, ledger, linkage, lookalike, neardup, packing, reading, sql, subjects, vectors

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.card_subjects(*[_table(spark, sf_dir, n) for n in ("processed_cards", "subject_areas", "subject_labels")])


def queries() -> dict[str, Query]:
    t = _table
    return {
        "p1_found": lambda s, d: ledger.copies_found(t(s, d, "processed_cards")),
        "p1_distinct": lambda s, d: ledger.distinct_cards(t(s, d, "processed_cards")),
        "p2_found": lambda s, d: _subjects(s, d),
        "p2_composition": lambda s, d: subjects.composition(_subjects(s, d)),
        "p3_found": lambda s, d: lookalike.alike_pairs(t(s, d, "processed_cards")),
        "p3_canonical": lambda s, d: lookalike.canonical_cards(t(s, d, "processed_cards")),
        "p4_found": lambda s, d: neardup.near_pairs(t(s, d, "indexed_notes")),
        "p4_groups": lambda s, d: neardup.near_groups(t(s, d, "indexed_notes")),
        "p5_found": lambda s, d: linkage.repeated_cards(t(s, d, "processed_cards")),
        "p5_clusters": lambda s, d: linkage.front_clusters(t(s, d, "processed_cards")),
        "p6_found": lambda s, d: components.linked_records(t(s, d, "duplicate_edges")),
        "p7_found": lambda s, d: vectors.similar_notes(t(s, d, "indexed_notes"), t(s, d, "embedding_cache")),
        "p8_ids": lambda s, d: encode.encode_texts(t(s, d, "documents")),
        "p9_containers": lambda s, d: packing.pack_texts(t(s, d, "documents"), t(s, d, "pack_targets")),
        "p9_fill": lambda s, d: packing.fill(packing.pack_texts(t(s, d, "documents"), t(s, d, "pack_targets")), t(s, d, "pack_targets")),
        "p10_found": lambda s, d: reading.reading_levels(t(s, d, "documents"), t(s, d, "reading_labels")),
        "p10_held_out": lambda s, d: reading.held_out_accuracy(t(s, d, "documents"), t(s, d, "reading_labels")),
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
