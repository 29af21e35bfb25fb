"""Jobs that change the registry: each gives the events to append, and what to report. Nothing is changed in place.

An event is a row of the log that ``registry.fold`` folds; ``registry.OWNED`` says which columns each kind sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill import storage
from cardmill.operators import audit, classify, registry
from cardmill.plans import audits
from cardmill.settings import APPROVED, DELETED, DISCARDED, REMOVED, UPLOADED, Profile, Settings, Taxonomy

#: The columns of a registry row that events carry.
COLUMNS = (
    "fingerprint", "front_original", "back_original", "front_normalized", "back_normalized", "scope_json", "note_type", "tags_resolved", "action_taken", "anki_note_id", "created_at", "source", "profile_name", "target_deck", "match_json",
    "material_origen", "status", "reason", "sync_batch", "audit_action", "ingest_batch",
)
_KIND = {"anki_note_id": "bigint"}


def event_rows(rows: DataFrame, event: str, seq: Column, **values: Column) -> DataFrame:
    """``record_id, seq, event`` and all columns of a registry row: given values, else null."""
    return rows.select(F.col("record_id"), seq.cast("bigint").alias("seq"), F.lit(event).alias("event"), *[values.get(c, F.lit(None)).cast(_KIND.get(c, "string")).alias(c) for c in COLUMNS])


def stamp(at: Column | None = None) -> Column:
    """``20250131T235959Z``: the name of a snapshot, from a time in UTC (now by default)."""
    return F.date_format(F.to_utc_timestamp(at if at is not None else F.current_timestamp(), F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


def new_id(batch: str, *parts: Column) -> Column:
    """An id in the form of a UUID that follows from the batch and the card, so that a task that runs twice gives it twice."""
    h = F.md5(F.concat_ws("\u0001", F.lit(batch), *parts))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))


def sorted_json(scope: Column) -> Column:
    """A facet map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(scope))))


def categories(*groups: list[str]) -> list[str]:
    """All categories of several lists, each once, in the order of their first mention."""
    return list(dict.fromkeys(c for g in groups for c in g))


class RegistryLog:
    """A registry in a folder: events appended as Parquet, folded when read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _events(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/log") if storage.exists(self.spark, f"{self.path}/log") else None

    def append(self, events: DataFrame) -> int:
        """Add events behind all others, in the order of their ``seq``; gives their number."""
        held = self._events()
        base = (held.agg(F.max("seq")).first()[0] or 0) if held is not None else 0
        written = storage.Scratch(self.spark, "events").cut(events, "events")  # computed once, whatever it reads from this log
        written.withColumn("seq", F.col("seq") + F.lit(base + 1)).write.mode("append").parquet(f"{self.path}/log")
        return written.count()

    def cards(self) -> DataFrame:
        """The cards as of now, with ``id``."""
        held = self._events()
        if held is None:
            held = self.spark.createDataFrame([], "record_id string, seq bigint, event string, " + ", ".join(f"{c} {_KIND.get(c, 'string')}" for c in COLUMNS))
        return registry.fold(held, list(COLUMNS)).withColumnRenamed("record_id", "id")


def ingest(cards: DataFrame, held: DataFrame, profile: Profile, taxonomy: Taxonomy, settings: Settings, batch: str, at: str, mode: str = "update", vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Audit new cards and say what becomes of each: (decisions, events).

    ``cards``: idx, front, back, source, suggested_tags, note_type, profile, deck, material_origen; ``held``: registry
    rows. A card whose fingerprint is held already updates that row ("update"), leaves it ("skip") or is added all the
    same ("new"); a removed row is taken back up. Equal cards of the batch after the first one find the first.
    """
    if mode not in ("update", "skip", "new"):
        mode = "update"
    scratch = storage.Scratch(cards.sparkSession, "ingest")
    rows = cards.withColumn("record_id", new_id(batch, F.col("idx").cast("string"), F.col("front"), F.col("back")))
    new = audits.records(rows, "record_id", "front", "back", "deck", "note_type", None, normalized=False).drop("scope", "vendor")
    new = new.join(rows.select("record_id", "idx", "suggested_tags", "source", "profile", "material_origen"), "record_id")
    pool = scratch.cut(audits.records(registry.active(held), "id", "front_normalized", "back_normalized", "target_deck", "note_type", "scope_json"), "pool")
    done = scratch.cut(audit.audit_batch(scratch.cut(new, "new"), pool, profile, taxonomy, settings, scratch, vectors), "audited")
    if mode == "new":
        out = done.withColumns({"outcome": F.col("action"), "id": F.col("record_id"), "held_status": F.lit(None).cast("string")})
    else:
        first = done.groupBy("fingerprint").agg(F.min(F.struct("idx", "record_id")).alias("first"), F.count("*").alias("n"))
        known = held.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min_by(F.struct("id", "status"), F.struct("created_at", "id")).alias("held"))
        joined = storage.join_by_size(done, scratch.cut(first.join(known, "fingerprint", "left"), "first"), "fingerprint", "n", F.lit(done.count()))
        repeat = F.col("record_id") != F.col("first.record_id")
        found = F.col("held").isNotNull() | repeat
        outcome = F.when(~found, F.col("action")).when(F.lit(mode == "skip"), "skipped").when(~repeat & F.col("held.status").isin(*REMOVED), "resurrected").otherwise("updated")
        out = joined.withColumns({"outcome": outcome, "id": F.coalesce("held.id", "first.record_id"), "held_status": F.col("held.status")}).drop("held", "first", "n")
    out = scratch.cut(out, "decided")
    tags = F.array_join("tags_resolved", " ")
    own = {"note_type": F.coalesce("note_type", F.lit("Basic")), "tags_resolved": tags, "scope_json": sorted_json(F.col("scope")), "target_deck": F.col("deck"), "material_origen": F.col("material_origen")}
    whole = own | {
        "fingerprint": F.col("fingerprint"), "front_original": F.col("front"), "back_original": F.col("back"), "front_normalized": F.col("front_norm"), "back_normalized": F.col("back_norm"),
        "action_taken": F.col("action"), "created_at": F.lit(at), "source": F.col("source"), "profile_name": F.col("profile"), "match_json": F.to_json("match_ids"), "status": F.col("status"), "reason": F.col("reason"),
        "audit_action": F.col("action"), "ingest_batch": F.lit(batch),
    }
    seq = F.col("idx") * 2
    target = out.withColumn("record_id", F.col("id"))
    events = event_rows(out.filter("outcome NOT IN ('updated', 'skipped', 'resurrected')"), "inserted", seq, **whole)
    events = events.unionByName(event_rows(target.filter("outcome IN ('updated', 'resurrected')"), "fields_updated", seq, **own))
    events = events.unionByName(event_rows(target.filter("outcome = 'resurrected'"), "action", seq + 1, action_taken=F.lit("insert"), status=F.lit(APPROVED)))
    report = out.select("idx", "front", F.col("outcome").alias("action"), F.col("action").alias("audit"), "reason", F.substring("id", 1, 8).alias("id_short"), "scope", "tags_resolved", "tags_unresolved", "confidence", "match_ids", "profile", "deck")
    return report, events


def review_list(cards: DataFrame) -> DataFrame:
    """The review queue as a listing: newest first, with a short id and the facets."""
    scope = F.from_json("scope_json", "map<string,string>")
    return registry.review_queue(cards).select("id", F.substring("id", 1, 8).alias("id_short"), F.col("front_original").alias("front"), "front_normalized", scope.alias("scope"), F.col("profile_name").alias("profile"), F.col("target_deck").alias("deck"), "status", "created_at", "match_json")


def resolve(cards: DataFrame, id_or_prefix: str, action: str, seq: int) -> tuple[str, DataFrame, DataFrame]:
    """(outcome, events, report) of approving, rejecting or purging one card, named by its id or a prefix of it.

    The outcome is that of the lookup: "found", "missing" or "ambiguous"; only a card that is found gives events. A
    purged card that was uploaded keeps its note, which the report says.
    """
    kinds = {"approve": ("action", "insert", APPROVED), "reject": ("action", "reject", DISCARDED), "purge": ("purged", None, None)}
    if action not in kinds:
        raise ValueError("action must be approve, reject or purge")
    found = registry.by_prefix(cards, id_or_prefix).first()
    row = cards.filter(F.col("id") == found.id) if found.outcome == "found" else cards.limit(0)
    event, taken, status = kinds[action]
    events = event_rows(row.withColumn("record_id", F.col("id")), event, F.lit(seq), action_taken=F.lit(taken), status=F.lit(status), anki_note_id=F.col("anki_note_id"))
    warning = F.when((F.col("status") == UPLOADED) & F.lit(action == "purge"), "the note itself stays: undo its upload to remove it")
    return found.outcome, events, row.select("id", F.lit(status).alias("status"), F.col("front_original").alias("front"), warning.alias("warning"))


def correct(cards: DataFrame, record_id: str, front: str, back: str, tags: list[str] | None, profile: Profile, taxonomy: Taxonomy, settings: Settings, seq: int, note_type: str | None = None, deck: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(decision, events): a corrected card is audited again against all others and its row written afresh; no rows for an unknown id."""
    scratch = storage.Scratch(cards.sparkSession, "correct")
    lit = lambda v, kind="string": F.lit(v).cast(kind)
    row = cards.filter(F.col("id") == record_id).limit(1)
    given = row.select(
        F.col("id").alias("record_id"), lit(front).alias("front"), lit(back).alias("back"), F.coalesce(lit(deck), F.col("target_deck")).alias("deck"), F.coalesce(lit(note_type), F.col("note_type"), F.lit("Basic")).alias("note_type"),
        F.array(*[F.lit(t) for t in tags or []]).cast("array<string>").alias("suggested_tags"), F.lit(0).alias("idx"), "material_origen",
    )
    new = audits.records(given, "record_id", "front", "back", "deck", "note_type", None, normalized=False).drop("scope", "vendor").join(given.select("record_id", "suggested_tags", "idx", "material_origen"), "record_id")
    others = audits.records(registry.active(cards).filter(F.col("id") != record_id), "id", "front_normalized", "back_normalized", "target_deck", "note_type", "scope_json")
    done = scratch.cut(audit.audit_batch(scratch.cut(new, "new"), scratch.cut(others, "others"), profile, taxonomy, settings, scratch), "done")
    events = event_rows(
        done, "corrected", F.lit(seq), fingerprint=F.col("fingerprint"), front_original=F.col("front"), back_original=F.col("back"), front_normalized=F.col("front_norm"), back_normalized=F.col("back_norm"), scope_json=sorted_json(F.col("scope")),
        tags_resolved=F.array_join("tags_resolved", " "), note_type=F.col("note_type"), action_taken=F.col("action"), match_json=F.to_json("match_ids"), material_origen=F.col("material_origen"), status=F.col("status"), reason=F.col("reason"),
    )
    return done, events


def reconcile(cards: DataFrame, live: DataFrame, seq: int) -> DataFrame:
    """Events that mark uploaded cards whose note is gone."""
    return event_rows(registry.orphans(cards, live).withColumn("record_id", F.col("id")), "deleted_in_anki", F.lit(seq), status=F.lit(DELETED))


def undo(cards: DataFrame, batch: str, seq: int, service=None) -> tuple[str, DataFrame, list[int]]:
    """(kind, events, notes deleted) of taking back a batch: an upload (notes deleted, cards approved again), else an ingest (cards purged, but for uploaded ones)."""
    rows = cards.withColumn("record_id", F.col("id"))
    mine = rows.filter(F.coalesce(F.col("sync_batch") == batch, F.lit(False)))
    if not mine.isEmpty():
        notes = [r[0] for r in mine.filter("anki_note_id IS NOT NULL").select("anki_note_id").collect()]  # one upload of the service's size
        if service is not None and notes:
            service.delete(notes)
        return "sync", event_rows(mine, "reverted", F.lit(seq), action_taken=F.col("action_taken"), status=F.lit(APPROVED)), notes if service is not None else []
    mine = rows.filter(F.coalesce(F.col("ingest_batch") == batch, F.lit(False)))
    kind = "none" if mine.isEmpty() else "ingest"
    return kind, event_rows(mine.filter(~F.coalesce(F.col("status") == UPLOADED, F.lit(False))), "purged", F.lit(seq)), []


def apply_tags(assignments: DataFrame, held: DataFrame, profile: Profile, taxonomy: Taxonomy, settings: Settings, batch: str, at: str, service=None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(assignments checked, decisions on cards among them, their events). Tags of notes go to the note service, cards through an ingest."""
    checked = storage.Scratch(assignments.sparkSession, "tags").cut(audits.apply_tags(assignments, taxonomy), "checked")
    if service is not None:
        for r in checked.filter("note_id IS NOT NULL AND error IS NULL AND size(add) > 0").toLocalIterator():
            service.add_tags([r.note_id], " ".join(r.add))
    null = F.lit(None).cast("string")
    cards = checked.filter("front IS NOT NULL AND error IS NULL").select(F.xxhash64("front", "back").alias("idx"), "front", "back", F.lit("manual").alias("source"), F.concat("add", "unknown").alias("suggested_tags"), F.lit("Basic").alias("note_type"), null.alias("profile"), null.alias("deck"), null.alias("material_origen"))
    decisions, events = ingest(cards, held, profile, taxonomy, settings, batch, at, mode="new")
    return checked, decisions, events


def reorganize(notes: DataFrame, required: list[str], profile: Profile, taxonomy: Taxonomy, settings: Settings, service=None, apply: bool = False) -> tuple[DataFrame, DataFrame]:
    """(health, tags to add) of a deck's notes (records with ``suggested_tags``): what is sure is tagged if ``apply``, duplicates are only reported."""
    scratch = storage.Scratch(notes.sparkSession, "reorganize")
    rows = scratch.cut(notes, "notes")
    clusters = audits.duplicate_clusters(rows.drop("suggested_tags"), settings)[2]
    report = audits.health(rows, clusters, required)
    sure, _ = audits.untagged_page(rows.drop("scope", "vendor"), profile, taxonomy)
    tags = scratch.cut(sure.select("record_id", F.array_except("tags_resolved", F.coalesce("suggested_tags", F.array().cast("array<string>"))).alias("add")), "tags")
    if apply and service is not None:
        for r in tags.toLocalIterator():
            service.add_tags([r.record_id], " ".join(r.add))
    return report, tags


def auto_classify(cards: DataFrame, profile: Profile, taxonomy: Taxonomy) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(settled, for review with what they lack, summary): cards of high confidence need no model and no person."""
    done = classify.classify(cards, profile, taxonomy)
    settled, rest = audit.auto_classify(done)
    required = list(profile.required_categories)
    lack = F.filter(F.array(*[F.lit(c) for c in required]).cast("array<string>"), lambda c: ~F.array_contains(F.map_keys("scope"), c) & ~F.exists("tags_resolved", lambda t: t.startswith(F.concat(c, F.lit("::")))))
    total, sure = F.count("*"), F.count_if(F.col("confidence") == "high")
    summary = done.agg(total.alias("total"), sure.alias("auto_classified"), (total - sure).alias("needs_review"), F.round(F.coalesce(F.try_divide(sure, total), F.lit(0.0)) * 100).cast("int").alias("saved_pct"))
    return settled, rest.withColumn("missing", lack), summary


def audit_collection(mode: str, **jobs) -> DataFrame:
    """One of the read-only audits by name; ``jobs`` are functions without arguments, as prepared by the caller."""
    name = mode.strip().lower()
    if name not in jobs:
        raise ValueError(f"mode must be one of {', '.join(sorted(jobs))}")
    return jobs[name]()
