"""Similarity measures and the score of a pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calibration of the cosine to a score, linear in between (fixed values).
CALIBRATION = ((0.20, 0.0), (0.40, 0.75), (0.55, 0.90), (0.68, 0.97), (1.0, 1.0))
# Limits and weights of the pair score (fixed values).
TOKENS_STRONG, TOKENS_WEAK, TRIGRAMS = 0.70, 0.50, 0.40
WEIGHTS = (0.65, 0.25, 0.10)
MATCH_REASON, VECTOR_ALONE = 0.45, 0.96


def jaccard(a: Column, b: Column) -> Column:
    """Shared by united; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, empty, null or zero."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(usable, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def calibrate(c: Column) -> Column:
    out = F.lit(CALIBRATION[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(CALIBRATION, CALIBRATION[1:], strict=False))):
        out = F.when(c < x1, F.lit(y0) + (c - x0) / (x1 - x0) * (y1 - y0)).otherwise(out)
    return F.when(c <= CALIBRATION[0][0], F.lit(CALIBRATION[0][1])).otherwise(out)


def cosine_floor(score: float) -> float:
    """The cosine that is calibrated to ``score``; to push a score limit down into a vector join."""
    if score <= CALIBRATION[0][1]:
        return CALIBRATION[0][0]
    for (x0, y0), (x1, y1) in zip(CALIBRATION, CALIBRATION[1:], strict=False):
        if score <= y1:
            return x0 + (score - y0) / (y1 - y0) * (x1 - x0)
    return CALIBRATION[-1][0]


def least_overlap(score: float, vectors: bool) -> float:
    """A token Jaccard that pairs of this score have, unless they agree in a value or in their vectors; to push a score limit down into a token join.

    Below 0.70 a score without vectors is 0.80, or 0.65 * 0.70 + 0.25 + 0.10, at most. A little less is asked, for the rounding of products.
    """
    return TOKENS_STRONG - 0.01 if not vectors and score > WEIGHTS[0] * TOKENS_STRONG + WEIGHTS[1] + WEIGHTS[2] + 1e-9 else TOKENS_WEAK


def pair_score(left: dict[str, Column], right: dict[str, Column], cos: Column | None = None) -> tuple[Column, Column]:
    """(score, reasons) of a pair from ``fingerprint, front, key, tokens, trigrams, backs, vendor`` of both sides.

    The score is not rounded; limits are compared with it as it is.
    """
    same_print = left["fingerprint"] == right["fingerprint"]
    same_front = (left["front"] == right["front"]) & (left["front"] != "")
    same_key = F.coalesce(left["key"] == right["key"], F.lit(False))
    j, t, b = (jaccard(left[n], right[n]) for n in ("tokens", "trigrams", "backs"))
    lexical = (
        F.when(same_print, 1.0)
        .when(same_front, 0.98)
        .when(same_key, 0.95)
        .when(j >= TOKENS_STRONG, 0.90)
        .when((j >= TOKENS_WEAK) & (t >= TRIGRAMS), 0.80)
        .otherwise(WEIGHTS[0] * j + WEIGHTS[1] * t + WEIGHTS[2] * b)
    )
    cos = F.lit(0.0) if cos is None else F.coalesce(cos, F.lit(0.0))
    cross = F.coalesce(left["vendor"] != right["vendor"], F.lit(False))
    backed = same_print | same_front | same_key | (j >= TOKENS_WEAK)
    trusted = ~cross & (backed | (cos >= VECTOR_ALONE))
    score = F.least(F.lit(1.0), F.greatest(lexical, F.when(trusted, calibrate(cos)).otherwise(0.0)))
    reasons = F.array_compact(
        F.array(
            F.when(trusted & (cos >= MATCH_REASON), "embedding_match").when(cross & (cos >= MATCH_REASON), "embedding_cross_vendor_ignored"),
            F.when(same_print, "exact_fingerprint"),
            F.when(same_front, "exact_front"),
            F.when(same_key, "semantic_key_match"),
            F.when(j >= TOKENS_WEAK, "token_overlap"),
            F.when(t >= TRIGRAMS, "trigram_overlap"),
        )
    )
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("low_similarity"))).otherwise(F.array_sort(reasons))
    return score, reasons
