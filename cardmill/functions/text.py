"""Text as columns: normal forms, question keys, stems, tokens, trigrams.

Only Unicode normalization and entity decoding need Python; they run as Arrow-batched UDFs with a fast path for ASCII.
Everything else is a built-in expression. Character classes are written out (``\\p{L}``, ``\\p{N}``) because Java's
``\\w`` differs from what is meant: letters, digits and underscore, no combining marks.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as understood by the normal forms, beyond ASCII.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Words without content of their own in a question, and words of its frame (fixed values).
STOPWORDS = (
    "a", "an", "and", "are", "between", "como", "con", "cual", "cuál", "dame", "de", "del", "dime", "does", "el", "en", "entre", "es", "explain", "for", "give", "how", "is", "la", "las", "lo",
    "los", "mean", "me", "of", "por", "para", "que", "qué", "s", "significa", "tell", "the", "to", "un", "una", "unos", "unas", "versus", "vs", "what", "y",
)
BOILERPLATE = ("compare", "compara", "definition", "definicion", "define", "difference", "diferencia", "explica")

# Suffixes in order, with the least length of what stays and what is put in place (fixed values); the first that fits is taken off.
SUFFIXES = (
    ("aciones", 3, "ar"), ("ioning", 3, "ion"), ("mente", 3, ""), ("ation", 3, ""), ("ness", 3, ""), ("ment", 3, ""), ("ting", 3, ""), ("ning", 3, ""), ("cion", 3, ""), ("ling", 3, ""),
    ("ices", 5, "ic"), ("able", 3, ""), ("ible", 3, ""), ("ing", 3, ""), ("ion", 3, ""), ("ies", 3, "y"), ("ous", 3, ""), ("ado", 3, ""), ("ity", 3, ""), ("ful", 3, ""),
    ("ly", 3, ""), ("ed", 3, ""), ("es", 4, ""), ("er", 3, ""), ("al", 3, ""), ("s", 3, ""), ("e", 5, ""),
)

ARTICLES = ("a", "an", "the", "un", "una", "unos", "unas", "el", "la", "los", "las")

# Question forms, in order: kind, pattern over accent-free text, groups (fixed values).
QUESTIONS = (
    ("acronym", r"^que significan?\s+(?:las\s+)?siglas?\s+(?:de\s+)?(.+)$"),
    ("acronym", r"^siglas?\s+de\s+(.+)$"),
    ("acronym", r"^what (?:does|do)\s+(.+?)\s+stand for\b.*$"),
    ("definition", r"^(?:what is|what s|define|definition of|tell me the definition of|give me the definition of|explain)\s+(.+)$"),
    ("definition", r"^what does\s+(.+)$"),
    ("definition", r"^(?:que es|cual es la definicion de|dime la definicion de|dame la definicion de|define|explica)\s+(.+)$"),
    ("definition", r"^que significa\s+(.+)$"),
    ("comparison", r"^(?:difference between|compare)\s+(.+?)\s+(?:and|vs|versus)\s+(.+)$"),
    ("comparison", r"^(.+?)\s+(?:vs|versus)\s+(.+)$"),
    ("comparison", r"^(?:diferencia entre|compara)\s+(.+?)\s+(?:y|vs|versus)\s+(.+)$"),
)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", html.unescape(x)))


@F.pandas_udf(T.StringType())
def unaccented(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without its combining marks."""
    return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def normal(c: Column) -> Column:
    """Compatibility-composed, without tags, white space collapsed, lower case. Null stays null."""
    return F.lower(collapse(strip_tags(nfkc(c))))


def normal_format(c: Column) -> Column:
    """Entities decoded, compatibility-composed, without tags, white space collapsed; case kept."""
    return collapse(strip_tags(unescaped(c)))


def words_only(c: Column) -> Column:
    """What is left of normalized accent-free text when all but letters, digits and underscores becomes space."""
    return collapse(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "))


def semantic(c: Column) -> Column:
    return words_only(unaccented(normal(c)))


def subject(c: Column) -> Column:
    """The bare subject of a question: without a trailing "mean" and one leading article."""
    c = F.regexp_replace(collapse(c), r"\s+mean$", "")
    return collapse(F.regexp_replace(c, f"^(?:{'|'.join(ARTICLES)})\\s+", ""))


def without_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]", " ")


def question_key(text: Column) -> tuple[Column, Column]:
    """(intent, key) of semantic text: ``acronym::X``, ``definition::X``, ``comparison::A::B`` with A before B, else unknown and null."""
    intent, key = F.lit("unknown"), F.lit(None).cast("string")
    for kind, pattern in reversed(QUESTIONS):
        first, second = subject(F.regexp_extract(text, pattern, 1)), None
        made = F.concat(F.lit(f"{kind}::"), first)
        if kind == "comparison":
            second = subject(F.regexp_extract(text, pattern, 2))
            made = F.concat(F.lit("comparison::"), F.least(first, second), F.lit("::"), F.greatest(first, second))
        hit = text.rlike(pattern)
        intent, key = F.when(hit, F.lit(kind)).otherwise(intent), F.when(hit, made).otherwise(key)
    return intent, key


def fingerprint(front: Column, back: Column) -> Column:
    return F.sha2(F.concat(front, F.lit("||"), back), 256)


def stem(token: Column) -> Column:
    out = token
    for suffix, least, put in reversed(SUFFIXES):
        fits = token.endswith(suffix) & (F.length(token) - len(suffix) >= least)
        out = F.when(fits, F.concat(token.substr(F.lit(1), F.length(token) - len(suffix)), F.lit(put))).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Sorted distinct stems of semantic text."""
    parts = F.filter(F.split(text, " "), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.transform(parts, stem)))


def content(stems: Column) -> Column:
    """Stems longer than one character that are neither stop words nor frame words."""
    return F.filter(F.array_except(stems, F.array(*[F.lit(w) for w in (*STOPWORDS, *BOILERPLATE)])), lambda t: F.length(t) > 1)


def trigrams(text: Column) -> Column:
    """Sorted distinct 3-character windows of the text between two spaces on either side; blank windows don't count."""
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    windows = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: padded.substr(i, F.lit(3)))
    return F.when(F.length(F.trim(text)) == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.filter(windows, lambda w: F.trim(w) != ""))))


def parse_tag(tag: Column) -> Column:
    """``category``, ``value`` of ``category::value``, both trimmed; null if either is empty."""
    parts = F.split(tag, "::", 2)
    category, value = F.trim(parts[0]), F.trim(F.get(parts, F.lit(1)))
    return F.when((category != "") & (value != ""), F.struct(category.alias("category"), value.alias("value")))


def deck_parts(deck: Column) -> Column:
    """Normalized, non-empty parts of ``A::B::C``."""
    return F.filter(F.transform(F.split(unaccented(normal(deck)), "::"), words_only), lambda p: p != "")


def embedding_text(front: Column, back: Column) -> Column:
    f, b = F.trim(front), F.trim(F.coalesce(back, F.lit("")))
    return F.when(b == "", f).otherwise(F.concat(f, F.lit("\n"), b))


def excerpt(c: Column, length: int = 160) -> Column:
    return F.substring(c, 1, length)
