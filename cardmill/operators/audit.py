"""Decisions on new cards."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill import storage
from cardmill.functions import quality
from cardmill.operators import classify, registry, similar
from cardmill.settings import Profile, Settings, Taxonomy

DETAILS = 5


def pool(*parts: DataFrame) -> DataFrame:
    """Union of record tables, later ones winning per ``record_id``."""
    out = None
    for rank, part in enumerate(parts):
        part = part.withColumn("pool_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return registry.latest(out, "record_id", F.col("pool_rank")).drop("pool_rank")


def decide(cards: DataFrame, matches: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``action, reason, match_ids``: a strong match (not of the same batch) outranks a reject for unresolved tags.

    ``matches``: q, r, score, rank, reasons and whether r is a sibling of the batch. A card is rejected if more than
    half of its suggested tags, repeats counted, are unresolved.
    """
    strong = matches.filter((F.col("score") >= settings.cluster_threshold) & ~F.coalesce(F.col("sibling"), F.lit(False)))
    first = strong.groupBy("q").agg(F.min_by(F.struct("r", "score", "reasons"), "rank").alias("top"), F.slice(F.array_sort(F.collect_list(F.struct("rank", "r"))), 1, DETAILS).alias("seen"))
    out = cards.join(first, cards.record_id == first.q, "left").drop("q")
    given, bad = F.size(F.coalesce("suggested_tags", F.array())), F.size("tags_unresolved")
    action = F.when(F.col("top").isNotNull(), "possible_duplicate").when((given > 0) & (bad / given > 0.5), "reject").otherwise("insert")
    reason = F.when(action == "possible_duplicate", F.format_string("match (%s, score=%.2f)", F.array_join("top.reasons", ", "), F.col("top.score"))).when(action == "reject", "more than half of the tags are unresolved").otherwise("no duplicate")
    out = out.withColumns({"action": action, "reason": reason, "match_ids": F.coalesce(F.transform("seen", lambda x: x["r"]), F.array().cast("array<string>"))})
    return out.withColumn("status", registry.derive_status(F.col("action"), F.lit(None), bad > 0)).drop("top", "seen")


def settle_votes(scopes: DataFrame, matches: DataFrame, fixed: DataFrame, terms: DataFrame, scratch: storage.Scratch) -> DataFrame:
    """``q, scope, applied`` once no vote changes a scope: ``fixed`` (r, category, value) and the cards' own facets vote.

    A card matches earlier ones only, so each round settles one more card of every chain at least and the rounds end.
    """
    near = matches.filter((F.col("rank") <= similar.NEIGHBOURS) & (F.col("score") >= similar.VOTE_SCORE))  # others never vote
    applied = scopes.withColumn("applied", F.array().cast("array<string>"))
    for k in itertools.count():
        facets = fixed.unionByName(applied.select(F.col("q").alias("r"), F.explode("scope").alias("category", "value")))
        following = scratch.cut(similar.apply_votes(scopes, similar.facet_vote(near, facets, terms)), f"scopes-{k}")
        changed = following.select("q", F.to_json("scope").alias("a")).join(applied.select("q", F.to_json("scope").alias("b")), "q").filter("a <> b")
        done = changed.isEmpty()
        applied = following
        if k:
            scratch.drop(f"scopes-{k - 1}")
        if done:
            return applied


def audit_batch(cards: DataFrame, held: DataFrame, profile: Profile, taxonomy: Taxonomy, settings: Settings, scratch: storage.Scratch, vectors: DataFrame | None = None) -> DataFrame:
    """Audit a batch (``record_id, idx, front, back, deck, suggested_tags`` and features) against ``held`` records.

    ``vectors`` (record_id, vector) of either side add near vectors to what the texts find.

    Cards are judged in order: card i sees the pool and its siblings before it, whose facets may come from votes of
    their own. All cards are scored at once (a pair with a later sibling is dropped); votes are repeated until no scope
    changes, which settles at least one more card of every chain each round: a card depends on those before it only,
    so there are no more rounds than cards in the longest chain, and one to see that nothing changes.
    """
    batch = scratch.cut(classify.classify(cards, profile, taxonomy), "batch")
    siblings = batch.select("record_id", "idx")
    rows = batch.withColumns({"sibling": F.lit(True), "vendor": F.col("scope")["vendor"]})
    pool_rows = held.withColumns({"sibling": F.lit(False), "vendor": F.col("scope")["vendor"]})
    records = pool_rows.unionByName(rows, allowMissingColumns=True)
    pairs = similar.lookup_pairs(rows, records, settings.similar_threshold, vectors)
    order = pairs.join(siblings.select(F.col("record_id").alias("q"), F.col("idx").alias("qi")), "q").join(siblings.select(F.col("record_id").alias("r"), F.col("idx").alias("ri")), "r", "left")
    pairs = order.filter("ri IS NULL OR ri < qi").select("q", "r", "cosine")
    matches = similar.top_similar(pairs, rows, records, settings.similar_threshold)
    matches = scratch.cut(matches.join(records.select(F.col("record_id").alias("r"), "sibling"), "r"), "matches")
    terms = cards.sparkSession.createDataFrame([(c, v) for c, values in taxonomy.categories.items() for v in values], "category string, value string")
    scopes = batch.select(F.col("record_id").alias("q"), "scope")
    fixed = held.select(F.col("record_id").alias("r"), F.explode("scope").alias("category", "value"))
    applied = settle_votes(scopes, matches, fixed, terms, scratch)
    out = batch.drop("scope").join(applied.withColumnRenamed("q", "record_id"), "record_id")
    out = out.withColumn("tags_resolved", F.array_distinct(F.concat("tags_resolved", "applied"))).drop("applied")
    return decide(out, matches, settings)


def annotate(audited: DataFrame, held: DataFrame) -> DataFrame:
    """Adds ``quality, cloze, version`` to audited cards: advice only, nothing is written.

    ``version`` compares with the best match, if the card is a possible duplicate.
    """
    new = audited.withColumn("quality", quality.flags(F.col("back"), F.col("back_norm"), F.split("front_sem", " "), F.split("back_sem", " ")))
    old = held.select(F.col("record_id").alias("old_id"), F.col("back").alias("old_back"), quality.flags(F.col("back"), F.col("back_norm"), F.split("front_sem", " "), F.split("back_sem", " ")).alias("old_quality"))
    joined = new.withColumn("old_id", F.get("match_ids", F.lit(0))).join(old, "old_id", "left")
    version = F.when(F.col("old_quality").isNotNull(), quality.better_version(F.col("quality"), F.col("old_quality"), F.col("back"), F.col("old_back")))
    return joined.withColumns({"cloze": quality.suits_cloze(F.col("back_norm")), "version": version}).drop("old_back", "old_quality")


def summary(audited: DataFrame) -> DataFrame:
    return audited.groupBy("action").agg(F.count("*").alias("cards"))


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page with ``total`` and ``next_offset`` (null on the last page)."""
    if offset < 0 or limit <= 0:
        raise ValueError("offset must be 0 or more and limit above 0")
    total = rows.count()
    following = offset + limit if offset + limit < total else None
    return rows.orderBy(*order).offset(offset).limit(limit).withColumns({"total": F.lit(total).cast("bigint"), "next_offset": F.lit(following).cast("bigint")})


def auto_classify(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled, for review): high confidence needs no further look."""
    sure = F.col("confidence") == "high"
    return classified.filter(sure), classified.filter(~sure)
