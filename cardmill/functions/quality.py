"""Checks of a single card."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardmill.functions import text

# Limits (fixed values).
LONG_ANSWER, SEGMENTS, LEAK_LENGTH, CLOZE_WORDS, LONGER = 320, 3, 6, 4, 1.3
YES_NO = r"^(?:s[ií]|no|yes|true|false|verdadero|falso)(?:$|[^\p{L}\p{N}_])"
LIST_MARK = r"(?m)^\s*(?:[-*•·]|\d+[.)])\s+"


def flags(back_raw: Column, back: Column, front_words: Column, back_words: Column) -> Column:
    """Codes of what is wrong: ``back`` is the normal form, the word arrays are semantic tokens."""
    marks = F.regexp_count(back_raw, F.lit(LIST_MARK))
    segments = F.size(F.filter(F.split(back, r"[.;\n]+"), lambda s: F.trim(s) != ""))
    shared = F.exists(F.array_intersect(front_words, back_words), lambda w: F.length(w) >= LEAK_LENGTH)
    found = F.array(
        F.when(F.length(back) > LONG_ANSWER, "respuesta_larga"),
        F.when((marks >= 2) | (segments >= SEGMENTS), "no_atomica"),
        F.when(back.rlike(YES_NO) & (F.length(back) <= 12), "reconocimiento"),
        F.when(shared, "pista_filtrada"),
    )
    return F.when(F.trim(back) == "", F.array(F.lit("back_vacio"))).otherwise(F.array_compact(found))


def suits_cloze(back: Column) -> Column:
    """One to four words, no yes or no, no sentence punctuation."""
    back = F.trim(back)
    return (back != "") & (F.size(F.split(back, " ")) <= CLOZE_WORDS) & ~back.rlike(YES_NO) & ~back.rlike("[.;:]")


def better_version(new_flags: Column, old_flags: Column, new_back: Column, old_back: Column) -> Column:
    """Whether the new card should replace the old: fewer flags, or as many and clearly longer without being too long."""
    new, old = F.length(F.trim(new_back)), F.length(F.trim(old_back))
    fuller = (F.size(new_flags) == F.size(old_flags)) & (old > 0) & (new > old * LONGER) & ~F.array_contains(new_flags, "respuesta_larga")
    return F.when((F.size(new_flags) < F.size(old_flags)) | fuller, "replace_old_with_new").otherwise("keep_existing")


def confidence(required: list[str], scope: Column, resolved: Column, unresolved: Column) -> Column:
    """high: all required categories covered and no unresolved tag; medium: some covered, or a resolved tag and none unresolved; else low."""
    required = required or ["vendor", "topic"]

    def has_tag(category: str) -> Column:
        return F.exists(resolved, lambda t: t.startswith(f"{category}::"))

    covered = [F.coalesce(scope[c].isNotNull(), F.lit(False)) | has_tag(c) for c in required]
    clean = F.size(unresolved) == 0
    every, some = covered[0], covered[0]
    for c in covered[1:]:
        every, some = every & c, some | c
    return F.when(every & clean, "high").when(some | ((F.size(resolved) >= 1) & clean), "medium").otherwise("low")


def words(c: Column) -> Column:
    """Semantic words, without stemming."""
    return F.array_distinct(F.filter(F.split(text.semantic(c), " "), lambda w: w != ""))
