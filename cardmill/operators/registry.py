"""The card registry as an event log folded into a snapshot, its queues, batches and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill import storage
from cardmill.settings import APPROVED, DELETED, DISCARDED, IN_REVIEW, REMOVED, UPLOADED

# Columns that each kind of event sets (fixed values of the domain); all others keep what they have.
OWNED = {
    "inserted": None,  # all
    "action": ("action_taken", "anki_note_id", "status"),
    "fields_updated": ("note_type", "tags_resolved", "scope_json", "target_deck", "material_origen"),
    "corrected": ("front_original", "back_original", "front_normalized", "back_normalized", "fingerprint", "scope_json", "tags_resolved", "note_type", "action_taken", "match_json", "material_origen", "status", "reason", "anki_note_id", "sync_batch"),
    "uploaded": ("action_taken", "anki_note_id", "status", "sync_batch"),
    "reverted": ("action_taken", "anki_note_id", "status", "sync_batch"),
    "deleted_in_anki": ("status",),
}


def derive_status(action: Column, note_id: Column, has_unresolved: Column) -> Column:
    return F.when(action == "reject", DISCARDED).when(action == "possible_duplicate", IN_REVIEW).when(note_id.isNotNull(), UPLOADED).when(has_unresolved, IN_REVIEW).otherwise(APPROVED)


def latest(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row per key, the last by ``order``: an aggregation (map-side combined), no window over a hot key."""
    keys = [key] if isinstance(key, str) else key
    whole = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def fold(events: DataFrame, columns: list[str]) -> DataFrame:
    """Snapshot of ``record_id, seq, event, <columns>``: for every column the value of the last event that sets it.

    ``purged`` is a tombstone: what lies before it is gone, and without a later ``inserted`` so is the record.
    """
    return unfolded(fold_state(events, columns), columns)


def fold_state(events: DataFrame, columns: list[str]) -> DataFrame:
    """What has to be kept of events to go on folding: per record the last ``purged`` and ``inserted``, and per column the last that sets it with its value."""
    aggs = []
    for c in columns:
        setters = [e for e, owned in OWNED.items() if owned is None or c in owned]
        aggs.append(F.max_by(F.struct("seq", F.col(c).alias("v")), F.when(F.col("event").isin(setters), F.col("seq"))).alias(c))
    last = lambda e: F.max(F.when(F.col("event") == e, F.col("seq")))
    return events.groupBy("record_id").agg(last("purged").alias("gone"), last("inserted").alias("born"), *aggs)


def merge_states(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The state of all events of both: a maximum each, so order doesn't matter and nothing is read twice."""
    return a.unionByName(b).groupBy("record_id").agg(F.max("gone").alias("gone"), F.max("born").alias("born"), *[F.max_by(c, F.col(f"{c}.seq")).alias(c) for c in columns])


def unfolded(state: DataFrame, columns: list[str]) -> DataFrame:
    """The snapshot that a state stands for."""
    gone = F.coalesce("gone", F.lit(-(1 << 62)))
    return state.filter(F.col("born") > gone).select("record_id", *[F.when(F.col(f"{c}.seq") > gone, F.col(f"{c}.v")).alias(c) for c in columns])


def active(cards: DataFrame) -> DataFrame:
    return cards.filter(~F.col("status").isin(*REMOVED))


def review_queue(cards: DataFrame) -> DataFrame:
    return cards.filter(F.col("status") == IN_REVIEW).orderBy(F.desc("created_at"), "id")


def sync_queue(cards: DataFrame) -> DataFrame:
    return cards.filter((F.col("status") == APPROVED) & F.col("anki_note_id").isNull()).orderBy("created_at", "id")


def uploaded_ids(cards: DataFrame) -> DataFrame:
    return cards.filter((F.col("status") == UPLOADED) & F.col("anki_note_id").isNotNull()).select("anki_note_id")


def by_prefix(cards: DataFrame, prefix: str, most: int = 10) -> DataFrame:
    """``outcome, id, matches, n``: exact id, one id with the prefix, or ambiguous with the first ``most`` 8-character ids; one row."""
    found = cards.filter(F.col("id").startswith(prefix)).select("id").distinct()
    one = found.agg(F.count("*").alias("n"), F.max(F.col("id") == prefix).alias("exact"), F.min("id").alias("id"))
    some = found.orderBy("id").limit(most).agg(F.array_sort(F.collect_list(F.substring("id", 1, 8))).alias("ids"))
    one = one.crossJoin(some)  # one row each
    outcome = F.when(F.col("n") == 0, "missing").when(F.col("exact"), "found").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return one.select(outcome.alias("outcome"), F.when(outcome == "found", F.when(F.col("exact"), F.lit(prefix)).otherwise(F.col("id"))).alias("id"), F.array_join("ids", " ").alias("matches"), "n")


def by_fingerprint(cards: DataFrame, fingerprint: str) -> DataFrame:
    """The first card of a fingerprint, by creation and id; no row if there is none."""
    return cards.filter(F.col("fingerprint") == fingerprint).orderBy("created_at", "id").limit(1)


def upsert(batch: DataFrame, held: DataFrame) -> DataFrame:
    """``id, fingerprint, outcome`` of an ingest by fingerprint: new, updated, or resurrected where the held card was removed.

    Equal cards of one batch: the first is what the registry says, the later ones update it. The first is found by an
    aggregation and brought to hot fingerprints by a broadcast.
    """
    rows = batch.filter("fingerprint IS NOT NULL").select("id", "fingerprint", "created_at")
    first = rows.groupBy("fingerprint").agg(F.min(F.struct("created_at", "id")).alias("first"), F.count("*").alias("n"))
    known = held.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min_by("status", F.struct("created_at", "id")).alias("held_status"))
    joined = storage.join_by_size(rows, first.join(known, "fingerprint", "left"), "fingerprint", "n", F.lit(rows.count()))
    later = F.struct("created_at", "id") != F.col("first")
    outcome = F.when(later, "updated").when(F.col("held_status").isNull(), "new").when(F.col("held_status").isin(*REMOVED), "resurrected").otherwise("updated")
    return joined.select("id", "fingerprint", outcome.alias("outcome"))


def counts_by(cards: DataFrame, column: str) -> DataFrame:
    return cards.groupBy(column).agg(F.count("*").alias("n"))


def status_metrics(cards: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return cards.agg(F.count("*").alias("total"), n(APPROVED, UPLOADED).alias("auto_resolved"), n(IN_REVIEW).alias("escalated"), n(DISCARDED).alias("discarded"), n(DELETED).alias("deleted"))


def transitions(cards: DataFrame) -> DataFrame:
    return cards.filter("audit_action IS NOT NULL").groupBy("audit_action", "status").agg(F.count("*").alias("n"))


def duplicate_precision(cards: DataFrame) -> DataFrame:
    """Of the cards flagged as possible duplicates: kept, discarded, pending, and kept by resolved (null if none is resolved)."""
    flagged = cards.filter(F.col("audit_action") == "possible_duplicate")
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = flagged.agg(n(APPROVED, UPLOADED).alias("kept"), n(DISCARDED).alias("discarded"), n(IN_REVIEW).alias("pending"))
    resolved = F.col("kept") + F.col("discarded")
    return out.withColumn("resolved", resolved).withColumn("kept_share", F.round(F.try_divide(F.col("kept"), F.col("resolved")), 3))


def batches(cards: DataFrame, column: str) -> DataFrame:
    """``batch, cards, first_at``, the newest first."""
    return cards.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("batch")).agg(F.count("*").alias("cards"), F.min("created_at").alias("first_at")).orderBy(F.desc("batch"))


def orphans(cards: DataFrame, live: DataFrame) -> DataFrame:
    """Uploaded cards whose note the note service no longer has: an anti-join."""
    gone = cards.filter((F.col("status") == UPLOADED) & F.col("anki_note_id").isNotNull())
    return gone.join(live.select(F.col("note_id").alias("anki_note_id")).distinct(), "anki_note_id", "left_anti")


def undo_ingest(cards: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """(cards that stay, counts ``deleted, kept``): a batch is taken back except for what is uploaded."""
    mine = F.coalesce(F.col("ingest_batch") == batch, F.lit(False))
    up = F.col("status") == UPLOADED
    return cards.filter(~mine | up), cards.filter(mine).agg(F.count_if(~up).alias("deleted"), F.count_if(up).alias("kept"))


def undo_sync(cards: DataFrame, batch: str) -> DataFrame:
    """Cards of a sync batch back to approved, without note id and batch."""
    mine = F.coalesce(F.col("sync_batch") == batch, F.lit(False))
    return cards.withColumns({"status": F.when(mine, APPROVED).otherwise(F.col("status")), "anki_note_id": F.when(~mine, F.col("anki_note_id")), "sync_batch": F.when(~mine, F.col("sync_batch"))})


def in_deck(column: Column, deck: str | None, subdecks: bool = True) -> Column:
    """Equality or the ``deck::`` prefix; no wildcard in a name has a meaning. None is every deck."""
    if deck is None:
        return F.lit(True)
    return (column == deck) | column.startswith(deck + "::") if subdecks else column == deck


def replace_deck(index: DataFrame, fresh: DataFrame, deck: str, subdecks: bool = True) -> DataFrame:
    """The index with a deck's rows replaced by a fresh scan."""
    return index.filter(~F.coalesce(in_deck(F.col("deck_name"), deck, subdecks), F.lit(False))).unionByName(fresh, allowMissingColumns=True)


def deck_counts(index: DataFrame) -> DataFrame:
    """``deck_name, note_count`` of every deck with its subdecks: paths are exploded into their prefixes."""
    parts = F.split("deck_name", "::")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))
    return index.filter("deck_name IS NOT NULL").select(F.explode(paths).alias("deck_name")).groupBy("deck_name").agg(F.count("*").alias("note_count"))


def cache_join(records: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Records with the cached vector of one model (the last written per key), null where there is none."""
    rows = cache.filter((F.col("model") == model) & (F.size("vector") > 0)).groupBy("fingerprint").agg(F.max_by("vector", F.struct("created_at", "vector")).alias("vector"))
    return records.join(rows, "fingerprint", "left")


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new vectors (``fingerprint, model, dim, vector, created_at``): the last written of a key and model counts, empty ones don't."""
    rows = cache.unionByName(new.filter(F.size("vector") > 0))
    return latest(rows, ["fingerprint", "model"], F.col("created_at"), F.col("vector"))


def own_or_cached(records: DataFrame, cache: DataFrame, model: str, own: str = "embedding_vector") -> DataFrame:
    """Adds ``vector``: the record's own, if it is a JSON list of as many finite numbers as the model's name says, else the cached one."""
    given = F.from_json(own, "array<double>")
    usable = (F.size(given) == int(model.rpartition(":")[2])) & F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = cache_join(records, cache, model)
    return held.withColumn("vector", F.when(usable, given).otherwise(F.col("vector")))


def resolve_models(wanted: DataFrame, models: list[str], aliases: dict[str, str], default: str) -> DataFrame:
    """Adds ``model``: the name if it exists, its alias, the default for Basic, else null."""
    exists = lambda c: c.isin(models)
    alias = F.lit(None).cast("string")
    for name, target in aliases.items():
        alias = F.when(F.col("note_type") == name, F.lit(target)).otherwise(alias)
    model = F.when(exists(F.col("note_type")), F.col("note_type")).when(exists(alias), alias)
    if default in models:
        model = model.when(F.col("note_type") == "Basic", F.lit(default))
    return wanted.withColumn("model", model)


def closest_name(name: str, names: list[str]) -> str | None:
    """A hint for an unknown name, from a short list on the driver."""
    import difflib

    found = difflib.get_close_matches(name, names, n=1)
    return found[0] if found else None
