"""The queries over the project's tables, by name, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill import catalog_sql, storage
from cardmill.functions import quality, scores, text
from cardmill.operators import audit, candidates, classify, cluster, features, registry, similar
from cardmill.plans import audits, curation, reports
from cardmill.settings import Profile, Settings, Taxonomy
from cardmill.sources import cards as card_files

SETTINGS = Settings(default_deck="Aula Abierta", default_model="Basic", model_aliases={"Cloze": "Cloze EN"})
#: A small rule pack for the study cards.
PROFILE = Profile(
    required_categories=("topic", "type"),
    routing_categories=("topic",),
    keyword_rules={"area": {"software": ["load balancer", "message queue", "container image"], "law": ["notary deed", "court order"], "health": ["blood pressure", "insulin dose"]}, "level": {"upper": ["grade: upper", "grado: alto"], "basic": ["grade: basic", "grado: inicial"]}},
    topic_keywords={"caching": ["cache layer", "capa de cache"], "optics": ["lens focus", "foco de la lente"], "cells": ["cell membrane", "membrana celular"]},
    deck_tag_rules={"Software::Caching": {"topic": "caching"}, "Law::Courts": {"topic": "courts", "cert": "faro-1"}, "Rules": {"topic": "rules"}},
)
MODEL = "tilo-embed:64"
ROOT = "Aula Abierta"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cards(s: SparkSession, d: str) -> DataFrame:
    return registry.latest(_t(s, d, "processed_cards").filter("id IS NOT NULL"), "id", F.col("created_at"))


def _notes(s: SparkSession, d: str) -> DataFrame:
    return registry.latest(_t(s, d, "indexed_notes").filter("note_id IS NOT NULL"), "note_id", F.col("indexed_at"))


def _records(s: SparkSession, d: str) -> DataFrame:
    return audits.records(_notes(s, d), "note_id", "front_normalized", "back_normalized", "deck_name", "note_type", "scope_json")


def _written(s: SparkSession, d: str) -> DataFrame:
    """The records with their features, computed once, for plans that read them several times."""
    return storage.Scratch(s, "records").cut(_records(s, d), "records")


def _taxonomy(s: SparkSession, d: str) -> Taxonomy:
    rows = _t(s, d, "taxonomy").orderBy("cat_ord", "val_ord").collect()  # a fixed table
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.category, []).append(r.value)
    return Taxonomy.of(out)


def _norm_cards(s: SparkSession, d: str) -> DataFrame:
    c = _cards(s, d).select("id", F.coalesce("front_normalized", F.lit("")).alias("f"), F.coalesce("back_normalized", F.lit("")).alias("b"), "back_original", "tags_resolved", "target_deck", "created_at", "scope_json", "note_type")
    return c


def exact_duplicates(s: SparkSession, d: str) -> DataFrame:
    c = _norm_cards(s, d).withColumn("fingerprint", text.fingerprint(F.col("f"), F.col("b")))
    return c.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("id").alias("representative")).filter("copies > 1")


def normalized_text(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "documents").select("doc_id", text.normal(F.col("text")).alias("norm"))


def semantic_text(s: SparkSession, d: str) -> DataFrame:
    return _notes(s, d).select("note_id", text.words_only(text.unaccented(F.coalesce("front_normalized", F.lit("")))).alias("words"))


def normalized_format(s: SparkSession, d: str) -> DataFrame:
    return _cards(s, d).select("id", text.normal_format(F.col("front_original")).alias("front"), text.normal_format(F.col("back_original")).alias("back"))


def question_keys(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).select(F.col("record_id").alias("note_id"), "intent", "semantic_key")


def stemmed_tokens(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).select(F.col("record_id").alias("note_id"), F.array_join("stems", " ").alias("stems"), F.array_join("content", " ").alias("content"))


def char_trigrams(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).select(F.col("record_id").alias("note_id"), F.array_join("trigrams", "|").alias("trigrams"))


def token_idf(s: SparkSession, d: str) -> DataFrame:
    return features.idf(_written(s, d)).select("token", "df", F.round("idf", 6).alias("idf"))


def anchor_tokens(s: SparkSession, d: str) -> DataFrame:
    r = _written(s, d)
    return features.anchors(r, features.idf(r)).select(F.col("record_id").alias("note_id"), F.array_join("anchors", " ").alias("anchors"))


def block_keys(s: SparkSession, d: str) -> DataFrame:
    return audits.with_blocks(_records(s, d)).select(F.col("record_id").alias("note_id"), F.array_join("block_keys", "|").alias("block_keys"))


def block_sizes(s: SparkSession, d: str) -> DataFrame:
    return candidates.block_sizes(audits.with_blocks(_records(s, d)))


def blocked_pairs(s: SparkSession, d: str) -> DataFrame:
    read = _t(s, d, "indexed_notes").filter("note_id IS NOT NULL").select("note_id", "front_normalized", "back_normalized", "deck_name", "note_type", "scope_json", "indexed_at")
    records = audits.records(registry.latest(read, "note_id", F.col("indexed_at")), "note_id", "front_normalized", "back_normalized", "deck_name", "note_type", "scope_json")
    keyed = records.select("record_id", "deck", "note_type", "scope", "semantic_key", "stems", F.slice("trigrams", 1, features.TRIGRAM_BLOCKS).alias("trigrams"))
    with storage.shuffles_released(s):
        return candidates.blocked(audits.with_blocks(keyed))


def exact_links(s: SparkSession, d: str) -> DataFrame:
    return candidates.exact(_written(s, d))


def jaccard_pairs(s: SparkSession, d: str) -> DataFrame:
    return candidates.jaccard_all(_written(s, d)).select("a", "b", F.col("shared").cast("bigint").alias("shared"))


def scored_edges(s: SparkSession, d: str) -> DataFrame:
    r = _written(s, d)
    found = cluster.score_pairs(candidates.complete(r, copies=True).select("a", "b"), r, SETTINGS.similar_threshold)
    return found.select("a", "b", "score", F.array_join("reasons", ",").alias("reasons"))


def _report(found: DataFrame) -> DataFrame:
    return found.withColumn("reasons", F.array_join("reasons", ","))


def duplicate_clusters(s: SparkSession, d: str) -> DataFrame:
    return _report(audits.duplicate_clusters(_records(s, d), SETTINGS)[2])


def cluster_members(s: SparkSession, d: str) -> DataFrame:
    return audits.duplicate_clusters(_records(s, d), SETTINGS)[1].select("cluster_id", F.col("id").alias("note_id"), "size")


def largest_clusters(s: SparkSession, d: str) -> DataFrame:
    return _report(audits.largest(audits.duplicate_clusters(_records(s, d), SETTINGS)[2]))


def _note_vectors(s: SparkSession, d: str) -> DataFrame:
    notes = _notes(s, d).select("note_id", "fingerprint", "embedding_vector")
    return registry.own_or_cached(notes, _t(s, d, "embedding_cache"), MODEL).select(F.col("note_id").alias("record_id"), "vector")


def cluster_report(s: SparkSession, d: str) -> DataFrame:
    """Clusters with vectors as a further signal."""
    return _report(audits.duplicate_clusters(_records(s, d), SETTINGS, _note_vectors(s, d))[2])


def pair_metrics(s: SparkSession, d: str) -> DataFrame:
    scratch = storage.Scratch(s, "metrics")
    r = scratch.cut(_records(s, d), "records")
    _, _, found = audits.duplicate_clusters(r, SETTINGS)
    blocks = scratch.cut(audits.with_blocks(r.select("record_id", "deck", "note_type", "scope", "semantic_key", "stems", F.slice("trigrams", 1, features.TRIGRAM_BLOCKS).alias("trigrams"), "fingerprint", "front_norm")).select("record_id", "fingerprint", "front_norm", "block_keys"), "blocks")
    return cluster.pair_metrics(r, candidates.block_sizes(blocks), audits.candidate_count(blocks, _note_vectors(s, d)), found)


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"), "label")


def cosine_pairs(s: SparkSession, d: str) -> DataFrame:
    return candidates.vector_join(_vectors(s, d), 0.40).select("a", "b", F.round("cosine", 4).alias("cosine"))


def calibrated_cosine(s: SparkSession, d: str) -> DataFrame:
    return candidates.vector_join(_vectors(s, d), 0.30).select("a", "b", F.round(scores.calibrate(F.col("cosine")), 4).alias("score"))


def _similar(s: SparkSession, d: str, least: float, vectors: DataFrame | None = None) -> DataFrame:
    pool = _written(s, d)
    queries = pool.filter("record_id % 100 = 0")
    found = similar.top_similar(similar.lookup_pairs(queries, pool, least, vectors), queries, pool, least)
    return found.select("q", "r", "score", F.array_join("reasons", ",").alias("reasons"), F.col("rank").cast("bigint").alias("rank"))


def similar_topk(s: SparkSession, d: str) -> DataFrame:
    return _similar(s, d, 0.60)


def similar_by_vectors(s: SparkSession, d: str) -> DataFrame:
    return _similar(s, d, SETTINGS.similar_threshold, storage.Scratch(s, "vectors").cut(_note_vectors(s, d), "vectors"))


def _neighbours(s: SparkSession, d: str) -> DataFrame:
    v = _vectors(s, d)
    return similar.nearest_vectors(v.filter("record_id % 100 = 0"), v, least=0.0)


def knn_topk(s: SparkSession, d: str) -> DataFrame:
    return _neighbours(s, d).select("q", "r", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def _votes(s: SparkSession, d: str) -> DataFrame:
    v = _vectors(s, d)
    matches = _neighbours(s, d).select("q", "r", (F.lit(0.5) + F.col("cosine")).alias("score"), "rank")
    facets = v.select(F.col("record_id").alias("r"), F.lit("label").alias("category"), F.col("label").cast("string").alias("value"))
    return similar.facet_vote(matches, facets, facets.select("category", "value").distinct())


def facet_vote(s: SparkSession, d: str) -> DataFrame:
    return _votes(s, d).select("q", "category", "value", "confidence", "votes")


def applied_votes(s: SparkSession, d: str) -> DataFrame:
    scopes = _vectors(s, d).filter("record_id % 100 = 0").select(F.col("record_id").alias("q"), F.create_map().cast("map<string,string>").alias("scope"))
    return similar.apply_votes(scopes, _votes(s, d)).select("q", F.array_join("applied", " ").alias("applied"))


def keyword_facets(s: SparkSession, d: str) -> DataFrame:
    found = classify.keyword_facets(PROFILE, F.concat_ws(" ", "f", "b"))
    return _norm_cards(s, d).select("id", *[c.alias(n) for n, c in found.items()])


def topic_facet(s: SparkSession, d: str) -> DataFrame:
    found = classify.topic_facet(PROFILE, _taxonomy(s, d), text.words_only(text.unaccented(F.concat_ws(" ", "f", "b"))), classify.python_fold)
    return _norm_cards(s, d).select("id", found.alias("topic"))


def type_facet(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d)
    return r.select(F.col("record_id").alias("note_id"), classify.type_facet(PROFILE, _taxonomy(s, d), F.col("front_sem"), F.col("intent")).alias("type"))


def deck_facets(s: SparkSession, d: str) -> DataFrame:
    rows = _norm_cards(s, d).withColumn("p", text.deck_parts(F.coalesce("target_deck", F.lit(""))))
    return rows.select("id", *[c.alias(n) for n, c in classify.deck_facets(PROFILE, F.col("p"), classify.python_path).items()])


def _suggested(s: SparkSession, d: str) -> DataFrame:
    tags = F.filter(F.split(F.coalesce("tags_resolved", F.lit("")), " "), lambda t: t != "")
    return _norm_cards(s, d).select("id", tags.alias("suggested_tags"))


def resolved_tags(s: SparkSession, d: str) -> DataFrame:
    good, bad, _ = classify.resolve_tags(F.col("suggested_tags"), _taxonomy(s, d))
    return _suggested(s, d).select("id", F.array_join(good, " ").alias("resolved"), F.array_join(bad, " ").alias("unresolved"))


def _classified(s: SparkSession, d: str) -> DataFrame:
    c = _norm_cards(s, d).select(F.col("id").alias("record_id"), F.col("f").alias("front"), F.col("b").alias("back"), F.col("target_deck").alias("deck"), F.filter(F.split(F.coalesce("tags_resolved", F.lit("")), " "), lambda t: t != "").alias("suggested_tags"))
    return classify.classify(c, PROFILE, _taxonomy(s, d))


def classified(s: SparkSession, d: str) -> DataFrame:
    scope = [F.col("scope")[c].alias(c) for c in ("topic", "cert", "area", "level", "type")]
    return _classified(s, d).select("record_id", *scope, F.array_join("tags_resolved", " ").alias("tags"), "confidence")


def confidence(s: SparkSession, d: str) -> DataFrame:
    good, bad, _ = classify.resolve_tags(F.col("suggested_tags"), _taxonomy(s, d))
    rows = _suggested(s, d).select("id", good.alias("r"), bad.alias("u"))
    return rows.select("id", quality.confidence(["topic", "type"], F.create_map().cast("map<string,string>"), F.col("r"), F.col("u")).alias("confidence"))


def auto_classify_summary(s: SparkSession, d: str) -> DataFrame:
    return registry.counts_by(confidence(s, d), "confidence")


def missing_categories(s: SparkSession, d: str) -> DataFrame:
    lack = classify.missing_categories(["topic", "type", "cert"], F.col("suggested_tags"), F.array().cast("array<string>"))
    return _suggested(s, d).select("id", F.array_join(lack, " ").alias("missing"))


def deck_route(s: SparkSession, d: str) -> DataFrame:
    scope = F.coalesce(F.from_json("scope_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = _norm_cards(s, d).select(F.col("id").alias("record_id"), scope.alias("scope"))
    decks = _t(s, d, "indexed_decks").select("deck_name").distinct()
    decks = decks.withColumn("ordinal", F.col("deck_name"))
    return classify.route_decks(rows, decks, list(PROFILE.routing_categories), ROOT)


def quality_flags(s: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.split(text.words_only(text.unaccented(F.col(c))), " ")
    found = quality.flags(F.coalesce("back_original", F.lit("")), F.col("b"), words("f"), words("b"))
    return _norm_cards(s, d).select("id", F.array_join(found, " ").alias("flags"))


def cloze(s: SparkSession, d: str) -> DataFrame:
    return _norm_cards(s, d).select("id", quality.suits_cloze(F.col("b")).alias("cloze"))


def better_version(s: SparkSession, d: str) -> DataFrame:
    c = _norm_cards(s, d).filter("f <> ''")
    words = lambda x: F.split(text.words_only(text.unaccented(F.col(x))), " ")
    flags = quality.flags(F.coalesce("back_original", F.lit("")), F.col("b"), words("f"), words("b"))
    c = c.withColumn("flags", flags)
    pairs = candidates.stars(c.withColumnRenamed("id", "record_id"), ["f"]).select("a", "b")
    old = c.select(F.col("id").alias("a"), F.col("flags").alias("old_flags"), F.col("back_original").alias("old_back"))
    new = c.select(F.col("id").alias("b"), F.col("flags").alias("new_flags"), F.col("back_original").alias("new_back"))
    both = pairs.join(old, "a").join(new, "b")
    return both.select(F.col("b").alias("new_id"), F.col("a").alias("old_id"), quality.better_version(F.col("new_flags"), F.col("old_flags"), F.col("new_back"), F.col("old_back")).alias("suggestion"))


def _audit(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The newest batch against all other records."""
    scratch = storage.Scratch(s, "audit")
    c = _cards(s, d)
    newest = c.agg(F.max("ingest_batch")).first()[0]
    is_new = F.coalesce(F.col("ingest_batch") == newest, F.lit(False))
    parts = []
    for rows in (c.filter(is_new), registry.active(c.filter(~is_new))):
        parts.append(audits.records(rows, "id", "front_normalized", "back_normalized", "target_deck", "note_type", "scope_json"))
    every = scratch.cut(parts[0].withColumn("new", F.lit(True)).unionByName(parts[1].withColumn("new", F.lit(False))), "records")
    batch = every.filter("new").drop("new", "scope")
    tags = F.filter(F.split(F.coalesce("tags_resolved", F.lit("")), " "), lambda t: t != "")
    batch = batch.join(c.select(F.col("id").alias("record_id"), tags.alias("suggested_tags"), F.struct("created_at", "id").alias("idx")), "record_id")
    held = every.filter("NOT new").drop("new")
    return audit.audit_batch(batch, held, PROFILE, _taxonomy(s, d), SETTINGS, scratch), held


def annotate(s: SparkSession, d: str) -> DataFrame:
    audited, held = _audit(s, d)
    return audit.annotate(audited, held).select("record_id", "action", "reason", F.array_join("match_ids", " ").alias("matches"), "status", F.array_join("quality", " ").alias("quality"), "cloze", "version")


def annotated_tags(s: SparkSession, d: str) -> DataFrame:
    """The tags of the newest batch, with what its neighbours' votes add; rows only, as cards vote in a chain."""
    return _audit(s, d)[0].select("record_id", F.array_join("tags_resolved", " ").alias("tags"), "confidence")


def audit_summary(s: SparkSession, d: str) -> DataFrame:
    return audit.summary(_audit(s, d)[0])


def ingest_upsert(s: SparkSession, d: str) -> DataFrame:
    c = _cards(s, d)
    newest = c.agg(F.max("ingest_batch")).first()[0]
    return registry.upsert(c.filter(F.col("ingest_batch") == newest), c.filter(F.col("ingest_batch") < newest)).select("id", "outcome")


def lifecycle_fold(s: SparkSession, d: str) -> DataFrame:
    """An event log made of the cards: inserted, then uploaded where there is a note, then purged where discarded; folded again."""
    c = _cards(s, d).select(F.col("id").alias("record_id"), "status", "anki_note_id", "action_taken", "sync_batch")
    null = lambda k: F.lit(None).cast(k)
    one = c.select("record_id", F.lit(1).cast("bigint").alias("seq"), F.lit("inserted").alias("event"), F.lit("aprobada").alias("status"), null("bigint").alias("anki_note_id"), "action_taken", null("string").alias("sync_batch"))
    two = c.filter("anki_note_id IS NOT NULL").select("record_id", F.lit(2).cast("bigint").alias("seq"), F.lit("uploaded").alias("event"), F.lit("subida").alias("status"), "anki_note_id", "action_taken", "sync_batch")
    three = c.filter("status = 'descartada'").select("record_id", F.lit(3).cast("bigint").alias("seq"), F.lit("purged").alias("event"), null("string").alias("status"), null("bigint").alias("anki_note_id"), null("string").alias("action_taken"), null("string").alias("sync_batch"))
    return registry.fold(one.unionByName(two).unionByName(three), ["status", "anki_note_id", "sync_batch"])


def latest_events(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events").select("user_id", "event_id", "event_type", "ts")
    return registry.latest(e, "user_id", F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


def untagged_page(s: SparkSession, d: str) -> DataFrame:
    rows = _suggested(s, d).filter(F.size(F.filter("suggested_tags", lambda t: t.startswith("topic::"))) == 0).select("id")
    return audit.page(rows, ["id"], 50, 50)


def taxonomy_proposals(s: SparkSession, d: str) -> DataFrame:
    return audits.taxonomy_proposals(_records(s, d), ["topic"], _taxonomy(s, d), SETTINGS).withColumn("samples", F.array_join("samples", " | "))


def collection_health(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d)
    _, _, found = audits.duplicate_clusters(r, SETTINGS)
    return audits.health(r, found, ["topic"])


def cache_join(s: SparkSession, d: str) -> DataFrame:
    found = registry.cache_join(_notes(s, d).select("note_id", "fingerprint"), _t(s, d, "embedding_cache"), MODEL)
    return found.select("note_id", F.col("vector").isNotNull().alias("cached"), F.round(F.coalesce(scores.norm("vector"), F.lit(0.0)), 4).alias("length"))


def recent_notes(s: SparkSession, d: str) -> DataFrame:
    return audits.recent(_notes(s, d).select("note_id", "indexed_at"), "indexed_at", 30)


def recent_audit(s: SparkSession, d: str) -> DataFrame:
    scratch = storage.Scratch(s, "recent")
    r = scratch.cut(_records(s, d), "records")
    ids = recent_notes(s, d).select(F.col("note_id").alias("record_id"))
    return audits.recent_audit(r.join(ids, "record_id", "left_semi"), r, ["topic", "type"], SETTINGS).withColumn("missing", F.array_join("missing", " "))


def tsv_export(s: SparkSession, d: str) -> DataFrame:
    """Approved cards written as TSV and read back."""
    path = storage.Scratch(s, "tsv").path("out")
    card_files.write_tsv(registry.sync_queue(_cards(s, d)), path)
    return card_files.read_tsv(s, path)


def id_lookup(s: SparkSession, d: str) -> DataFrame:
    c = _cards(s, d)
    out = None
    for prefix in ("0", "00", "zz"):
        one = registry.by_prefix(c, prefix).select(F.lit(prefix).alias("prefix"), "outcome", "id", "n")
        out = one if out is None else out.union(one)
    return out


def sync_plan(s: SparkSession, d: str) -> DataFrame:
    decks = [r[0] for r in _t(s, d, "indexed_decks").select("deck_name").distinct().orderBy("deck_name").collect()]  # a fixed table
    return audits.sync_plan(_cards(s, d), ["Basic", "Cloze EN", "Basic (reversed)"], SETTINGS, decks).select("id", "model", "deck", "error")


def _newest(s: SparkSession, d: str, column: str) -> str:
    return _cards(s, d).agg(F.max(column)).first()[0] or ""


def undo_ingest(s: SparkSession, d: str) -> DataFrame:
    return registry.undo_ingest(_cards(s, d), _newest(s, d, "ingest_batch"))[1]


def undo_sync(s: SparkSession, d: str) -> DataFrame:
    return registry.counts_by(registry.undo_sync(_cards(s, d), _newest(s, d, "sync_batch")), "status")


def replaced_deck(s: SparkSession, d: str) -> DataFrame:
    n = _notes(s, d).select("note_id", "deck_name", "indexed_at")
    decks = _t(s, d, "indexed_decks").filter(registry.in_deck(F.col("deck_name"), ROOT))
    at = decks.agg(F.max("last_refreshed_at")).first()[0] or ""
    fresh = n.filter(registry.in_deck(F.col("deck_name"), ROOT) & (F.col("indexed_at") >= at))
    return registry.counts_by(registry.replace_deck(n, fresh, ROOT), "deck_name")


def deck_counts(s: SparkSession, d: str) -> DataFrame:
    return registry.deck_counts(_notes(s, d))


def stale_decks(s: SparkSession, d: str) -> DataFrame:
    now = registry.deck_counts(_notes(s, d)).withColumnRenamed("note_count", "now")
    held = _t(s, d, "indexed_decks").select("deck_name", F.col("note_count").alias("held"))
    return held.join(now, "deck_name", "full_outer").select("deck_name", "held", F.coalesce("now", F.lit(0)).alias("now")).filter("held IS NULL OR held <> now")


def record_pool(s: SparkSession, d: str) -> DataFrame:
    c = registry.active(_cards(s, d)).select(F.coalesce(F.concat(F.lit("anki:"), F.col("anki_note_id").cast("string")), F.col("id")).alias("record_id"), F.col("front_normalized").alias("front"))
    c = registry.latest(c, "record_id", F.col("front"))
    n = _notes(s, d).select(F.concat(F.lit("anki:"), F.col("note_id").cast("string")).alias("record_id"), F.col("front_normalized").alias("front"))
    return audit.pool(c, n)


def embedding_text(s: SparkSession, d: str) -> DataFrame:
    return _cards(s, d).select("id", text.embedding_text(F.col("front_original"), F.col("back_original")).alias("text"))


def card_files_read(s: SparkSession, d: str) -> DataFrame:
    """All cards written as a card file and read again; what the reader refuses, with its reason, stands beside."""
    path = storage.Scratch(s, "files").path("cards")
    _cards(s, d).select(F.col("front_original").alias("front"), F.col("back_original").alias("back"), "source", "note_type", F.col("target_deck").alias("deck")).write.json(path)
    good, bad = card_files.read_cards(s, path)
    return good.select("front", "back", "source", "note_type", F.lit(None).cast("string").alias("error")).unionByName(bad.withColumn("note_type", F.lit(None).cast("string")).select("front", "back", "source", "note_type", "error"))


def registry_backup(s: SparkSession, d: str) -> DataFrame:
    path = card_files.snapshot(_cards(s, d), storage.Scratch(s, "backup").path("registry"), "20250101T000000Z")
    return registry.counts_by(s.read.parquet(path), "status")


def index_codec(s: SparkSession, d: str) -> DataFrame:
    """The index's delimited columns as arrays and back."""
    arrays = card_files.import_index(_notes(s, d))
    sizes = arrays.select("note_id", *[F.size(c).alias(f"n_{c}") for c in ("content_tokens", "back_tokens", "anchor_tokens", "char_trigrams")])
    return card_files.export_index(arrays).select("note_id", "content_tokens", "anchor_tokens").join(sizes, "note_id")


def migrated(s: SparkSession, d: str) -> DataFrame:
    """An older registry without status and scope brought up to date."""
    old = _cards(s, d).select("id", "action_taken", "anki_note_id", "tags_resolved", F.get_json_object("scope_json", "$.topic").alias("scope_topic"))
    return card_files.migrate(old).select("id", "status", F.get_json_object("scope_json", "$.topic").alias("topic"))


def review_list(s: SparkSession, d: str) -> DataFrame:
    return curation.review_list(_cards(s, d)).select("id", "id_short", "front", F.col("scope")["topic"].alias("topic"), "profile", "deck", "status", "created_at")


def reconcile_events(s: SparkSession, d: str) -> DataFrame:
    return curation.reconcile(_cards(s, d), _notes(s, d), 1).select("record_id", "event", "status", "seq")


def auto_classify(s: SparkSession, d: str) -> DataFrame:
    c = _norm_cards(s, d).select(F.col("id").alias("record_id"), F.col("f").alias("front"), F.col("b").alias("back"), F.col("target_deck").alias("deck"), F.filter(F.split(F.coalesce("tags_resolved", F.lit("")), " "), lambda t: t != "").alias("suggested_tags"))
    return curation.auto_classify(c, PROFILE, _taxonomy(s, d))[2]


def date_stamps(s: SparkSession, d: str) -> DataFrame:
    return _cards(s, d).select("id", curation.stamp(F.to_timestamp("created_at")).alias("stamp"))


def record_shapes(s: SparkSession, d: str) -> DataFrame:
    """Records as they are reported, without their facets."""
    r = _records(s, d).select(reports.record_struct().alias("r"))
    return r.select("r.id", "r.deck", "r.note_type", "r.front", "r.back_excerpt", "r.intent", "r.semantic_key")


def records_as_json(s: SparkSession, d: str) -> DataFrame:
    return reports.as_json(_cards(s, d).select("id", "status"))


def cache_upserted(s: SparkSession, d: str) -> DataFrame:
    """The cache written once more with its own rows: the last of each key and model stays."""
    cache = _t(s, d, "embedding_cache").select("fingerprint", "model", "dim", "vector", "created_at").filter("size(vector) > 0")
    return registry.cache_upsert(cache, cache).select("fingerprint", "model", "dim", "created_at")


def by_fingerprint(s: SparkSession, d: str) -> DataFrame:
    c = _cards(s, d)
    return registry.by_fingerprint(c, c.agg(F.max("fingerprint")).first()[0] or "").select("id", "fingerprint")


def first_of_fronts(s: SparkSession, d: str) -> DataFrame:
    """The first record of every front in record order: notes before cards, notes by number, cards by when they were made."""
    null = F.lit(None)
    c = registry.active(_cards(s, d)).select(F.col("front_normalized").alias("front"), F.col("id").alias("record_id"), features.record_place(null.cast("bigint"), F.col("created_at")).alias("place"))
    n = _notes(s, d).select(F.col("front_normalized").alias("front"), F.concat(F.lit("anki:"), F.col("note_id").cast("string")).alias("record_id"), features.record_place(F.col("note_id"), null.cast("string")).alias("place"))
    return c.unionByName(n).filter("front <> ''").groupBy("front").agg(F.min(F.struct("place", "record_id"))["record_id"].alias("first"), F.count("*").alias("records"))


def refreshed_decks(s: SparkSession, d: str) -> DataFrame:
    """The decks' lines after a fresh scan of one of them that finds the notes of the index."""
    decks, index = _t(s, d, "indexed_decks"), _notes(s, d)
    field = lambda n, c: F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit("")).alias("value"))
    notes = index.select("note_id", "deck_name", "note_type", F.array().cast("array<string>").alias("tags"), F.array(field("Front", "front_original"), field("Back", "back_original")).alias("fields"))
    return audits.refresh_index(index, decks, notes, ROOT, "2030")[1].select("deck_name", "include_subdecks", "last_refreshed_at", "note_count")


def simple(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: f(_cards(s, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        exact_duplicates, normalized_text, semantic_text, normalized_format, question_keys, stemmed_tokens, char_trigrams, token_idf, anchor_tokens, block_keys, block_sizes, blocked_pairs, exact_links, jaccard_pairs,
        scored_edges, duplicate_clusters, cluster_members, largest_clusters, cluster_report, pair_metrics, cosine_pairs, calibrated_cosine, similar_topk, similar_by_vectors, knn_topk, facet_vote, applied_votes, keyword_facets, topic_facet, type_facet, deck_facets, resolved_tags,
        classified, confidence, auto_classify_summary, missing_categories, deck_route, quality_flags, cloze, better_version, annotate, annotated_tags, audit_summary, ingest_upsert, lifecycle_fold, latest_events, untagged_page, taxonomy_proposals,
        collection_health, cache_join, recent_notes, recent_audit, tsv_export, id_lookup, sync_plan, undo_ingest, undo_sync, replaced_deck, deck_counts, stale_decks, record_pool, embedding_text,
        card_files_read, registry_backup, index_codec, migrated, review_list, reconcile_events, auto_classify, date_stamps, record_shapes, records_as_json, cache_upserted, by_fingerprint, first_of_fronts, refreshed_decks,
    ]
    return {f.__name__: f for f in named} | {
        "review_queue": simple(lambda c: registry.review_queue(c).select("id", "created_at")),
        "sync_queue": simple(lambda c: registry.sync_queue(c).select("id", "created_at")),
        "action_counts": simple(lambda c: registry.counts_by(c, "action_taken")),
        "status_metrics": simple(registry.status_metrics),
        "transition_matrix": simple(registry.transitions),
        "precision_metrics": simple(registry.duplicate_precision),
        "ingest_batches": simple(lambda c: registry.batches(c, "ingest_batch")),
        "sync_batches": simple(lambda c: registry.batches(c, "sync_batch")),
        "reconcile_orphans": lambda s, d: registry.orphans(_cards(s, d), _notes(s, d)).select("id", "anki_note_id"),
    }


def oracle_sql() -> dict[str, str]:
    return catalog_sql.build(PROFILE)
