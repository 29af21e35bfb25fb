"""Features of records: keys, stems, trigrams, anchors, block keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.functions import text

ANCHORS, TRIGRAM_BLOCKS, SIGNATURE = 4, 4, 6


def with_text_features(df: DataFrame, front: str = "front", back: str = "back", normalized: bool = False) -> DataFrame:
    """Adds ``front_norm, back_norm, fingerprint, front_sem, intent, semantic_key, stems, content, back_stems, trigrams``.

    ``normalized``: the two columns are in normal form already. Null sides count as ''.
    """
    f, b = (F.coalesce(F.col(c), F.lit("")) for c in (front, back))
    out = df.withColumns({"front_norm": f if normalized else text.normal(f), "back_norm": b if normalized else text.normal(b)})
    out = out.withColumns({"front_folded": text.unaccented(F.col("front_norm")), "back_folded": text.unaccented(F.col("back_norm"))})
    out = out.withColumns({"front_sem": text.words_only(F.col("front_folded")), "back_sem": text.words_only(F.col("back_folded"))})
    out = out.withColumn("question", text.words_only(text.without_brackets(F.col("front_folded"))))
    intent, key = text.question_key(F.col("question"))
    return out.withColumns(
        {
            "fingerprint": text.fingerprint(F.col("front_norm"), F.col("back_norm")),
            "intent": intent,
            "semantic_key": key,
            "stems": text.tokens(F.col("front_sem")),
            "content": text.content(text.tokens(F.col("front_sem"))),
            "back_stems": text.tokens(F.col("back_sem")),
            "trigrams": text.trigrams(F.col("front_norm")),
        }
    ).drop("front_folded", "back_folded", "question")


def idf(records: DataFrame, tokens: str = "stems", key: str = "record_id") -> DataFrame:
    """``token, df, idf``: records over records with the token; over the whole collection, so that it depends on no order."""
    n = records.select(key).distinct().count()
    per = records.select(key, F.explode(tokens).alias("token")).distinct().groupBy("token").agg(F.count("*").alias("df"))
    return per.withColumn("idf", F.lit(float(n)) / F.col("df"))


def anchors(records: DataFrame, idf_table: DataFrame, tokens: str = "stems", key: str = "record_id") -> DataFrame:
    """``<key>, anchors``: up to four tokens, rarest first, then longest, then by name."""
    order = Window.partitionBy(key).orderBy(F.desc("idf"), F.desc(F.length("token")), "token")
    ranked = records.select(key, F.explode(tokens).alias("token")).distinct().join(idf_table.select("token", "idf"), "token").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= ANCHORS).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("anchors"))


def scope_block(scope: Column, kind: Column, deck: Column, deck_form: Column) -> Column:
    """``scope:cat=value|..:type`` of a non-empty facet map, else ``deck:..:type``, else null; ``kind`` and ``deck_form`` are normal forms."""
    kind = F.coalesce(kind, F.lit(""))
    # a map can't be ordered as such; blanks are no facets
    entries = F.array_sort(F.filter(F.map_entries(scope), lambda e: F.trim(e["value"]) != ""))
    parts = F.array_join(F.transform(entries, lambda e: F.concat(F.lower(e["key"]), F.lit("="), F.lower(F.regexp_replace(e["value"], r"[^\p{L}\p{N}_\s]", " ")))), "|")
    by_deck = F.concat(F.lit("deck:"), F.coalesce(deck_form, F.lit("")), F.lit(":"), kind)
    return F.when(F.coalesce(F.size(entries), F.lit(0)) > 0, F.concat(F.lit("scope:"), parts, F.lit(":"), kind)).when(deck.isNotNull() & (deck != ""), by_deck)


def record_place(note_id: Column, created_at: Column) -> Column:
    """Sorts notes before other records: notes by their number, the others by when they were made. Ties go by id."""
    return F.struct(F.when(note_id.isNull(), 1).otherwise(0).alias("rank"), F.coalesce(note_id, F.lit(0)).alias("note"), F.when(note_id.isNull(), F.coalesce(created_at, F.lit(""))).otherwise("").alias("made"))


def block_keys(scope_key: Column, semantic_key: Column, anchor_tokens: Column, trigrams: Column) -> Column:
    """Sorted distinct keys: scope, question key, anchors, first trigrams."""
    named = F.array_compact(F.array(scope_key, F.concat(F.lit("semantic:"), semantic_key)))
    rest = F.concat(F.transform(F.coalesce(anchor_tokens, F.array().cast("array<string>")), lambda t: F.concat(F.lit("anchor:"), t)), F.transform(F.slice(trigrams, 1, TRIGRAM_BLOCKS), lambda t: F.concat(F.lit("tri:"), t)))
    return F.array_sort(F.array_distinct(F.concat(named, rest)))
