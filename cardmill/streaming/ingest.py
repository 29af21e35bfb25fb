"""Extensions of the batch jobs to streams: idempotent ingest by batch, and a running registry fold.

Both keep a bucketed table of what they must remember; a micro-batch reads and writes the buckets of its own keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardmill import storage
from cardmill.operators import registry

_KNOWN = "fingerprint string, id string, status string, created_at string"


def ingest(cards: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, buckets: int = 64) -> StreamingQuery:
    """Each micro-batch is upserted by fingerprint against what came before and appended to ``path`` with its outcome.

    A part is written under its batch number, overwriting itself, before the batch is remembered; a batch that is
    replayed after a failure counts once.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = storage.BucketTable(spark, f"{path}-known", "fingerprint", _KNOWN, buckets)
        if table.manifest()["done"] >= number:
            return
        batch = batch.persist()
        try:
            mine = batch.filter("fingerprint IS NOT NULL").select(*[c.split()[0] for c in _KNOWN.split(", ")])
            only = table.touched(mine)
            held = table.read(only)
            outcome = registry.upsert(batch, held)
            batch.select("id", "fingerprint", "status", "created_at").join(outcome.select("id", "outcome"), "id").write.mode("overwrite").parquet(f"{path}/part={number}")
            first = F.min_by(F.struct("id", "status", "created_at"), F.struct("created_at", "id"))
            table.replace(held.unionByName(mine).groupBy("fingerprint").agg(first.alias("r")).select("fingerprint", "r.*"), only, number)
        finally:
            batch.unpersist()

    writer = cards.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer.trigger(availableNow=True)).start()


def first_seen(cards: DataFrame, at: str = "created_at", late: str = "7 days") -> DataFrame:
    """The stream without cards whose fingerprint came within the watermark: state is bounded by time, not by history."""
    return cards.withWatermark(at, late).dropDuplicatesWithinWatermark(["fingerprint"])


def activity(events: DataFrame, at: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by kind and window."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def _states(spark: SparkSession, events: DataFrame | None, columns: list[str], path: str, buckets: int) -> storage.BucketTable:
    kinds = {f.name: f.dataType.simpleString() for f in events.schema} if events is not None else dict.fromkeys(columns, "string")
    fields = ", ".join(f"{c} struct<seq:bigint,v:{kinds[c]}>" for c in columns)
    return storage.BucketTable(spark, path, "record_id", f"record_id string, gone bigint, born bigint, {fields}", buckets)


def fold_stream(events: DataFrame, columns: list[str], path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Lifecycle events folded into a running state, one row per record; ``folded`` reads the snapshot."""

    def one(batch: DataFrame, number: int) -> None:
        table = _states(batch.sparkSession, batch, columns, path, buckets)
        if table.manifest()["done"] >= number:
            return
        new = registry.fold_state(batch, columns)
        only = table.touched(batch.select("record_id"))
        table.replace(registry.merge_states(table.read(only), new, columns), only, number)

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, columns: list[str], path: str, kinds: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """The snapshot as of the last micro-batch; ``kinds``: a table with the columns' types (strings without)."""
    return registry.unfolded(_states(spark, kinds, columns, path, buckets).read(), columns)
