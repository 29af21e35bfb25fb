"""One form for text that prints alike.

Each side is mapped (compatibility forms folded, invisible characters dropped, spaces and hyphens unified, look-alike
letters of other scripts replaced); the mapped values are grouped in SQL under the accent- and case-sensitive Unicode
collation, which also sets composed and separate accents equal. The canonical member of a class is its smallest
variant; it is joined back to every card.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardmill import storage
from cardmill.operators.candidates import pairs_within

#: Letters that print like a basic Latin letter: all of Cyrillic, Greek, Armenian and the Latin extensions that the public
#: Unicode confusables name, and a few capitals that they leave out (fixed values, in code order).
LOOKALIKES = {
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ь": "b", "а": "a", "г": "r",
    "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѡ": "w", "Ѵ": "V", "ѵ": "v", "Ү": "Y", "ү": "y", "Һ": "h", "һ": "h", "ҽ": "e", "Ӏ": "I",
    "ӏ": "i", "Ԁ": "d", "ԁ": "d", "Ԍ": "G", "Ԛ": "Q", "ԛ": "q", "Ԝ": "W", "ԝ": "w", "ꙇ": "i",
    "Ϳ": "J", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "γ": "y", "ι": "i",
    "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "Ϝ": "F", "ϳ": "j", "Ϻ": "M", "ᴦ": "r",
    "Լ": "L", "Ս": "U", "Տ": "S", "Օ": "O", "ա": "w", "գ": "q", "զ": "q", "հ": "h", "ո": "n", "ռ": "n", "ս": "u", "ց": "g", "ք": "f", "օ": "o",
    "ı": "i", "Ƅ": "b", "ƍ": "g", "Ɩ": "I", "Ʀ": "R", "ƽ": "s", "ǀ": "l", "ɑ": "a", "ɡ": "g", "ɣ": "y", "ɩ": "i", "ɪ": "i", "ɯ": "w", "ʋ": "u", "ʏ": "y", "ᴄ": "c", "ᴏ": "o", "ᴑ": "o",
    "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᶃ": "g", "ᶌ": "y", "ẝ": "f", "ỿ": "y", "ꜱ": "s", "Ꞙ": "F", "ꞙ": "f", "ꞟ": "u", "Ʝ": "J", "Ꭓ": "X", "Ꞵ": "B", "ꬲ": "e", "ꬵ": "f", "ꬽ": "o",
    "ꭇ": "r", "ꭈ": "r", "ꭎ": "u", "ꭒ": "u", "ꭚ": "y",
}
#: Hyphens and minus signs that print as the plain one (fixed values).
HYPHENS = "‐‑‒–⁃−﹣－"
_TABLE = str.maketrans(LOOKALIKES | {h: "-" for h in HYPHENS} | {"⁄": "/"})
_DROP = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
_SPACE = re.compile(r"\s+")


def printed_form(text: str | None) -> str:
    """What the text prints like. Null counts as ''. Accents, case and punctuation stay as they are."""
    if not text:
        return ""
    if not text.isascii():
        # split accents off first: a look-alike base under a separate accent is mapped as well
        text = unicodedata.normalize("NFKD", _DROP.sub("", text))
        text = unicodedata.normalize("NFC", _DROP.sub("", text).translate(_TABLE))
    return _SPACE.sub(" ", text).strip()


@F.pandas_udf(T.StringType())
def printed_form_udf(texts: pd.Series) -> pd.Series:
    return texts.map(printed_form)


def plain_spaces(text: Column) -> Column:
    """Runs of plain spaces, tabs and line breaks as one space, none at the ends; nothing else changes."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\r\n]+", " "), "^ | $", "")


def _prepare(cards: DataFrame, scratch: storage.Scratch) -> tuple[DataFrame, DataFrame]:
    """``members`` (id, variant) and ``variants`` (variant, its class' canonical variant, n). One row per non-null id.

    A variant is the 128-bit hash of a card's two plain sides. Cards that agree in every character share it, so that
    hot copies are one row from here on.
    """
    spark = cards.sparkSession
    plain = cards.filter(F.col("id").isNotNull()).select("id", plain_spaces(F.col("front_original")).alias("f"), plain_spaces(F.col("back_original")).alias("b"))
    rows = plain.select("id", F.unhex(F.md5(F.concat_ws("\u0001", "f", "b"))).alias("variant"), "f", "b")
    mapped = rows.select("id", "variant", printed_form_udf("f").alias("mf"), printed_form_udf("b").alias("mb"))
    mapped = scratch.cut(mapped, "mapped")
    members = mapped.groupBy("id").agg(F.min("variant").alias("variant"))
    mapped.createOrReplaceTempView("cardmill_mapped")
    try:
        variants = spark.sql("SELECT variant, min(mf) AS mf, min(mb) AS mb FROM cardmill_mapped GROUP BY variant")
    finally:
        spark.catalog.dropTempView("cardmill_mapped")
    variants.createOrReplaceTempView("cardmill_variants")
    try:
        classes = spark.sql(
            """
            SELECT v.variant, c.canonical, c.n
            FROM cardmill_variants v
            JOIN (SELECT mf COLLATE UNICODE AS kf, mb COLLATE UNICODE AS kb, min(variant) AS canonical, count(*) AS n
                  FROM cardmill_variants GROUP BY mf COLLATE UNICODE, mb COLLATE UNICODE) c
              ON v.mf COLLATE UNICODE = c.kf AND v.mb COLLATE UNICODE = c.kb
            """
        )
    finally:
        spark.catalog.dropTempView("cardmill_variants")
    return members, classes


def alike_pairs(cards: DataFrame) -> DataFrame:
    """``id_a, id_b``: cards that print the same on both sides but differ in characters; the smaller id first.

    Pairs are first formed between the variants of a class, in cells where they are many, and then joined with their
    cards, so that no copies of one variant are ever compared with each other; every joined row is a result row.
    ``canonical_cards`` gives the classes without any pairs.
    """
    scratch = storage.Scratch(cards.sparkSession, "lookalike")
    members, classes = _prepare(cards, scratch)
    several = scratch.cut(classes.filter("n > 1").select("variant", "canonical"), "several")
    pairs = pairs_within(several, "canonical", "variant").toDF("canonical", "va", "vb").select("va", "vb")
    left, right = members.select(F.col("id").alias("x"), F.col("variant").alias("va")), members.select(F.col("id").alias("y"), F.col("variant").alias("vb"))
    both = pairs.join(left, "va").join(right, "vb")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def canonical_cards(cards: DataFrame) -> DataFrame:
    """``id, canonical_id``: for every card the smallest id among the cards of its class' canonical variant."""
    scratch = storage.Scratch(cards.sparkSession, "lookalike")
    members, classes = _prepare(cards, scratch)
    members = scratch.cut(members, "members")
    per_variant = members.groupBy("variant").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    named = classes.join(per_variant.select(F.col("variant").alias("canonical"), F.col("first").alias("canonical_id")), "canonical").select("variant", "canonical_id")
    named = named.join(per_variant.select("variant", "rows"), "variant")
    return storage.join_by_size(members, named, "variant", "rows", F.lit(members.count())).select("id", "canonical_id")
