"""Whole jobs over a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardmill import storage
from cardmill.functions import scores, text
from cardmill.operators import audit, candidates, classify, cluster, features, registry, similar, tiles
from cardmill.settings import APPROVED, Profile, Settings, Taxonomy
from cardmill.sources import cards as card_files
from cardmill.sources.services import note_cards


def records(rows: DataFrame, key: str, front: str, back: str, deck: str | None, note_type: str | None, scope_json: str | None, normalized: bool = True) -> DataFrame:
    """``record_id, front, back, deck, note_type, scope, vendor`` with text features, one row per key."""
    null = F.lit(None).cast("string")
    col = lambda c: F.col(c) if c else null
    scope = F.coalesce(F.from_json(col(scope_json), "map<string,string>"), F.create_map().cast("map<string,string>"))
    out = rows.select(F.col(key).alias("record_id"), F.col(front).alias("front"), F.col(back).alias("back"), col(deck).alias("deck"), col(note_type).alias("note_type"), scope.alias("scope")).withColumn("vendor", F.col("scope")["vendor"])
    return features.with_text_features(out, normalized=normalized)


def with_blocks(rows: DataFrame) -> DataFrame:
    """Adds ``anchors`` and ``block_keys``; token weights are those of the rows themselves.

    The features are read by several branches of the plan, so they are computed and written once. Decks and note types
    are few: their normal forms are made once each and joined on.
    """
    scratch = storage.Scratch(rows.sparkSession, "features")
    rows = scratch.cut(rows, "rows")
    names = rows.select(F.explode(F.array("deck", "note_type")).alias("name")).filter("name IS NOT NULL").distinct()
    names = scratch.cut(names.select("name", text.semantic(F.col("name")).alias("form")), "names")
    found = features.anchors(rows, features.idf(rows))
    out = rows.join(found, "record_id", "left")
    for column, form in (("deck", "deck_form"), ("note_type", "type_form")):
        out = out.join(names.toDF(column, form), column, "left")
    keys = features.block_keys(features.scope_block(F.col("scope"), F.col("type_form"), F.col("deck"), F.col("deck_form")), F.col("semantic_key"), F.col("anchors"), F.col("trigrams"))
    return out.withColumn("block_keys", keys).select(*rows.columns, "anchors", "block_keys")


def candidate_count(rows: DataFrame, vectors: DataFrame, least: float = 0.75) -> DataFrame:
    """``pairs``, one row: the size of the union of pairs that share a block, pairs of equal values, and pairs of near vectors, each counted once."""
    scratch = storage.Scratch(rows.sparkSession, "counted")
    front = F.when(F.col("front_norm") != "", F.concat(F.lit("front:"), F.md5("front_norm")))
    keys = F.concat("block_keys", F.array_compact(F.array(F.concat(F.lit("fingerprint:"), "fingerprint"), front)))
    placed = candidates.numbered(rows.select(F.col("record_id").alias("id"), keys.alias("keys")), scratch)
    vectors = vectors.select(F.col("record_id").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    each = rows.select(F.col("record_id").alias("id")).join(placed.select("id", F.transform("o", lambda x: x["block"]).alias("keys")), "id", "left").join(vectors, "id", "left")
    return tiles.count_met(each, scores.cosine_floor(least), scratch)


def duplicate_clusters(rows: DataFrame, settings: Settings, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, members, clusters) at the cluster threshold, by the complete candidate joins.

    ``rows`` come with text features; vectors (record_id, vector) add pairs of very close vectors and raise the score
    of pairs that their texts support. Members are rows (cluster_id, root, id, size), whatever the size of a cluster;
    a cluster's representative is the first in record order, if rows have a ``place``.
    """
    scratch = storage.Scratch(rows.sparkSession, "clusters")
    used = {"record_id", "back_norm", "place", *cluster.FIELDS.values()}
    rows = scratch.cut(rows.select(*[c for c in rows.columns if c in used]), "records")
    if vectors is not None:
        vectors = scratch.cut(vectors.select("record_id", "vector"), "vectors")
    pairs = candidates.complete(rows, vectors, least=scores.least_overlap(settings.cluster_threshold, vectors is not None))
    edges = scratch.cut(cluster.score_pairs(pairs, rows, settings.cluster_threshold), "edges")
    members = scratch.cut(cluster.members(cluster.components(edges, scratch), scratch), "members")
    return edges, members, cluster.summaries(edges, members, rows if "place" in rows.columns else None)


def taxonomy_proposals(rows: DataFrame, required: list[str], taxonomy: Taxonomy, settings: Settings, least_size: int = 3, samples: int = 5) -> DataFrame:
    """Labels mined from clusters of records without a required facet, at the lookup threshold; largest clusters first.

    ``samples``: the fronts of the first few members.
    """
    open_rows = rows.filter(classify.untagged(required, F.col("scope")))
    _, members, _ = duplicate_clusters(open_rows, Settings(cluster_threshold=settings.similar_threshold))
    words = members.select("cluster_id", "id", F.col("root").alias("cluster")).join(open_rows.select(F.col("record_id").alias("id"), "front", F.split("front_sem", " ").alias("words")), "id")
    known = [v for values in taxonomy.categories.values() for v in values]
    found = similar.label_clusters(words.select("cluster", "id", "words"), known, list(text.STOPWORDS), least_size)
    first = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    some = words.withColumn("at", first).filter(F.col("at") <= samples).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "front"))), lambda x: x["front"]).alias("samples"))
    return found.join(some, "cluster").orderBy(F.desc("size"), "cluster")


def largest(clusters: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest clusters, for a report."""
    return clusters.orderBy(F.desc("size"), "cluster_id").limit(n)


def health(rows: DataFrame, clusters: DataFrame, required: list[str], leeches: DataFrame | None = None) -> DataFrame:
    """One row: scanned, untagged, clusters, records in clusters, leeches (records that are failed again and again, as the note service names them)."""
    scanned = rows.agg(F.count("*").alias("scanned"), F.count_if(classify.untagged(required, F.col("scope"))).alias("untagged"))
    found = clusters.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("clustered"))
    out = scanned.crossJoin(found)  # one row each
    return out.crossJoin(leeches.agg(F.count("*").alias("leeches"))) if leeches is not None else out.withColumn("leeches", F.lit(0).cast("bigint"))


def untagged_page(cards: DataFrame, profile: Profile, taxonomy: Taxonomy, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(to tag at once, page for review) of cards without a required facet: high confidence with new tags is settled."""
    open_cards = classify.classify(cards, profile, taxonomy)
    new = F.size(F.array_except("tags_resolved", F.coalesce("suggested_tags", F.array().cast("array<string>")))) > 0
    sure = (F.col("confidence") == "high") & new
    return open_cards.filter(sure), audit.page(open_cards.filter(~sure), ["record_id"], offset, limit)


def recent(rows: DataFrame, at: str, days: int) -> DataFrame:
    """Rows of the last days before the newest one."""
    newest = rows.agg(F.max(at)).first()[0]
    if newest is None:
        return rows.limit(0)
    return rows.filter(F.to_timestamp(at) >= F.to_timestamp(F.lit(newest)) - F.expr(f"INTERVAL {int(days)} DAYS"))


def recent_audit(new: DataFrame, held: DataFrame, required: list[str], settings: Settings) -> DataFrame:
    """Recent records with their best lexical match and the facets they lack."""
    pairs = similar.lookup_pairs(new, held, settings.similar_threshold).drop("cosine")
    best = similar.top_similar(pairs, new, held, settings.similar_threshold, 1)
    lack = F.filter(F.array(*[F.lit(c) for c in required]), lambda c: ~F.array_contains(F.map_keys("scope"), c))
    return new.join(best.withColumnRenamed("q", "record_id"), "record_id", "left").select("record_id", F.col("r").alias("best"), "score", lack.alias("missing"), (F.col("r").isNull() & (F.size(lack) == 0)).alias("ok"))


def sync_plan(cards: DataFrame, models: list[str], settings: Settings, decks: list[str]) -> DataFrame:
    """What an upload would do: every approved card with its model and deck, or the error that stops all of it."""
    queue = cards.filter((F.col("status") == APPROVED) & F.col("anki_note_id").isNull())
    planned = registry.resolve_models(queue, models, settings.model_aliases, settings.default_model)
    deck = F.coalesce("target_deck", F.lit(settings.default_deck))
    error = F.when(F.col("model").isNull(), F.concat(F.lit("unknown model: "), F.col("note_type"))).when(~deck.isin(decks), F.concat(F.lit("unknown deck: "), deck))
    return planned.withColumns({"deck": deck, "error": error})


def sync(cards: DataFrame, plan: DataFrame, service, batch: str, dry_run: bool = False, backup: str | None = None, stamp: str = "", tsv: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events of the upload, errors). Nothing is uploaded if any planned card has an error, on a dry run, or without a service.

    Without a service the queue may be written to ``tsv``. Before an upload a copy of the registry goes to ``backup``.
    Every note carries a tag made of its card's id; a task that runs again finds it and adds no second note.
    """
    errors = plan.filter("error IS NOT NULL").select("id", "error")
    none = cards.sparkSession.createDataFrame([], "record_id string, event string, anki_note_id bigint, status string, sync_batch string, error string")
    if service is None:
        if tsv:
            card_files.write_tsv(plan, tsv)
        return none, errors
    if dry_run or not errors.isEmpty():
        return none, errors
    if backup:
        card_files.snapshot(cards, backup, stamp)

    def upload(frames):
        import pandas as pd

        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                try:
                    mark = f"card-{r.id}"
                    held = service.find(f"tag:{mark}")
                    note = held[0] if held else service.add({"deckName": r.deck, "modelName": r.model, "fields": {"Front": r.front_original, "Back": r.back_original}, "tags": [*(r.tags_resolved or "").split(), mark]})
                    out.append((r.id, "uploaded" if note is not None else "failed", note, "subida" if note is not None else None, batch, None))
                except Exception as e:
                    out.append((r.id, "failed", None, None, batch, str(e)))
            yield pd.DataFrame(out, columns=["record_id", "event", "anki_note_id", "status", "sync_batch", "error"]).astype({"anki_note_id": "Int64"})

    done = plan.select("id", "deck", "model", "front_original", "back_original", "tags_resolved").mapInPandas(upload, none.schema)
    # written at once: a later read must not upload again
    done = storage.Scratch(cards.sparkSession, "sync").cut(done, "events")
    return done.filter("event = 'uploaded'"), done.filter("event = 'failed'").select(F.col("record_id").alias("id"), "error")


def refresh_index(index: DataFrame, decks: DataFrame, service_notes: DataFrame, deck: str, at: str, front: str = "Front", back: str = "Back", subdecks: bool = True) -> tuple[DataFrame, DataFrame]:
    """(index, decks) after a fresh scan of a deck: its rows replaced, its line in ``decks`` (deck_name, include_subdecks, last_refreshed_at, note_count) too.

    ``service_notes`` are rows of the note source; notes with a blank front are left out.
    """
    made = note_cards(service_notes, front, back).filter(registry.in_deck(F.col("deck_name"), deck, subdecks))
    made = made.withColumns({"front_original": F.col("front"), "back_original": F.col("back"), "front_normalized": text.normal(F.col("front")), "back_normalized": text.normal(F.col("back"))})
    made = made.withColumns({"fingerprint": text.fingerprint(F.col("front_normalized"), F.col("back_normalized")), "indexed_at": F.lit(at)})
    fresh = storage.Scratch(index.sparkSession, "refresh").cut(made.select([c for c in made.columns if c in index.columns]), "fresh")
    line = fresh.agg(F.lit(deck).alias("deck_name"), F.lit(int(subdecks)).alias("include_subdecks"), F.lit(at).alias("last_refreshed_at"), F.count("*").alias("note_count"))
    return registry.replace_deck(index, fresh, deck, subdecks), decks.filter(F.col("deck_name") != deck).unionByName(line.select(decks.columns))


def apply_tags(assignments: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """``note_id, front, back, add, unknown, error``: a malformed tag rejects its assignment, an unknown one is reported."""
    valid = F.array(*[F.lit(t) for t in taxonomy.tags()]).cast("array<string>")
    malformed = F.exists("tags", lambda t: text.parse_tag(t).isNull())
    target = F.col("note_id").isNotNull().cast("int") + F.col("front").isNotNull().cast("int")
    error = F.when(target != 1, "give either a note or a card").when(malformed, "malformed tag")
    keep = F.when(error.isNull(), F.array_distinct(F.filter("tags", lambda t: F.array_contains(valid, t))))
    return assignments.select("note_id", "front", "back", keep.alias("add"), F.filter("tags", lambda t: ~F.array_contains(valid, t)).alias("unknown"), error.alias("error"))
