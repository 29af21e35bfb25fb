"""Notes that repeat another note with small changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill import storage
from cardmill.llm import shingles
from cardmill.llm.components import components
from cardmill.operators.candidates import pairs_within

PLAN = shingles.Plan(rows=6, bands=40)


def note_texts(notes: DataFrame) -> DataFrame:
    """``note_id, text``: front, one space, back of every note with both sides non-empty; of repeated rows the last indexed."""
    rows = notes.filter("note_id IS NOT NULL AND front_normalized <> '' AND back_normalized <> ''")
    text = F.concat_ws(" ", "front_normalized", "back_normalized")
    return rows.groupBy("note_id").agg(F.max_by(text, F.struct(F.coalesce("indexed_at", F.lit("")), text)).alias("text"))


def _linked(notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``members`` (note_id, tid), ``texts`` (tid, h, text, n_rows) and ``links`` (x, y) between different texts."""
    scratch = storage.Scratch(notes.sparkSession, "neardup")
    rows = scratch.cut(note_texts(notes), "rows")
    texts = shingles.numbered(rows, scratch, "texts")
    signed = scratch.cut(shingles.with_signatures(texts, PLAN), "signed")
    pairs = shingles.candidates(shingles.block_rows(signed), scratch)
    links = scratch.cut(shingles.compare(pairs, texts).select("x", "y"), "links")
    scratch.drop("signed")
    named = rows.select("note_id", F.unhex(F.md5("text")).alias("h"))
    members = scratch.cut(storage.join_by_size(named, texts.select("h", "tid", "n_rows"), "h", "n_rows", F.lit(rows.count())).select("note_id", "tid"), "members")
    return members, texts, links


def near_pairs(notes: DataFrame) -> DataFrame:
    """``note_id_a, note_id_b``: notes with a trigram Jaccard similarity of 0.8 or more; identical texts count.

    Texts are compared once each; the pairs of their notes are joined on at the end, every joined row is a result.
    Texts of under three characters have no substrings: two of them are a pair only if identical.
    """
    members, texts, links = _linked(notes)
    x, y = members.select(F.col("note_id").alias("p"), F.col("tid").alias("x")), members.select(F.col("note_id").alias("q"), F.col("tid").alias("y"))
    different = links.join(x, "x").join(y, "y").select("p", "q")
    several = members.join(texts.filter("n_rows > 1").select("tid"), "tid", "left_semi")
    same = pairs_within(several, "tid", "note_id").select("p", "q")
    return different.unionByName(same).select(F.least("p", "q").alias("note_id_a"), F.greatest("p", "q").alias("note_id_b"))


def near_groups(notes: DataFrame) -> DataFrame:
    """``note_id, group_id, n_links``: every note with the smallest id of its group and its number of links to other texts."""
    members, _, links = _linked(notes)
    scratch = storage.Scratch(notes.sparkSession, "neargroups")
    first = members.groupBy("tid").agg(F.min("note_id").alias("first"), F.count("*").alias("n"))
    roots = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch).select(F.col("v").alias("tid"), "root")
    degree = links.select(F.explode(F.array("x", "y")).alias("tid")).groupBy("tid").agg(F.count("*").alias("n_links"))
    per = scratch.cut(first.join(roots, "tid", "left").join(degree, "tid", "left").select("tid", "first", "n", F.coalesce("root", "tid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "per")
    group = per.groupBy("root").agg(F.min("first").alias("group_id"), F.sum("n").alias("size"))
    total = F.lit(members.count())
    named = storage.join_by_size(per, group, "root", "size", total).select("tid", "group_id", "n_links", "n")
    return storage.join_by_size(members, named, "tid", "n", total).select("note_id", "group_id", "n_links")
