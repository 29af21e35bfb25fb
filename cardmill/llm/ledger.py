"""Copies that differ only in format, counted in an incremental ledger.

A card's canonical key keeps the letters, digits and combining marks of its two sides, lower-cased. The sides may be
exchanged, and a side that is a list of labelled entries is keyed by its sorted entries. The ledger holds one row per
key (copies, earliest card, smallest id) in hash buckets; a batch is aggregated first, full-outer-joined with the
buckets it touches and only these are written again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill import storage

#: Words that open an entry of a labelled list (fixed values).
LABELS = ("case", "theme", "unit", "grade", "caso", "tema", "unidad", "grado")
_MARK, _JOIN = "\u0001", "\u0002"
#: A label in text whose words are set apart by two spaces, also with something dropped between its letters.
LABEL = "(?:" + "|".join("(?:  )?".join(w) for w in LABELS) + ")"


def side_key(text: Column) -> Column:
    """The content of one side. Null counts as empty; a side without letters and digits gives ''.

    Words are first set apart by two spaces, so that labels next to each other are both found. A list starts with a
    label and has at least two of them. What is dropped doesn't count within a label either ("The:me" is one).
    """
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{Cf}+", "")
    words = F.concat(F.lit("  "), F.regexp_replace(words, r"[^\p{L}\p{M}\p{N}]+", "  "), F.lit("  "))
    marked = F.regexp_replace(words, f" ({LABEL}) ", f"{_MARK}$1 ")
    entries = F.array_sort(F.split(F.replace(marked, F.lit(" "), F.lit("")), _MARK))
    return F.when(marked.rlike(f"^ *{_MARK}[^{_MARK}]*{_MARK}"), F.array_join(entries, _JOIN)).otherwise(F.replace(words, F.lit(" "), F.lit("")))


def card_key(front: Column, back: Column) -> Column:
    """128 bits of the two side keys in sorted order."""
    sides = F.array_sort(F.array(side_key(front), side_key(back)))
    return F.unhex(F.md5(F.array_join(sides, "\u0003")))


def keyed_cards(cards: DataFrame) -> DataFrame:
    """``id, key, batch, seen_at``: one row per id; rows repeated under one id are one record. A null id is no record."""
    rows = cards.filter(F.col("id").isNotNull()).select(
        "id", card_key(F.col("front_original"), F.col("back_original")).alias("key"), F.col("ingest_batch").alias("batch"), F.col("created_at").alias("seen_at")
    )
    return rows.groupBy("id").agg(*[F.min_by(c, F.struct("seen_at", "key")).alias(c) for c in ("key", "batch")], F.min("seen_at").alias("seen_at"))


#: Keys of a bucket; the number of buckets follows the ledger's size.
BUCKET_KEYS = 1 << 18


class CopyLedger:
    """Counts per canonical key, persisted in hash buckets under ``path``.

    ``manifest.json`` names the version that each bucket is to be read from, the batches folded and about how many keys
    there are. It is replaced after a fold's files are complete, so a fold that dies leaves the ledger as it was; the
    versions it replaces are removed then. When the buckets have become too large, their number is doubled and all of
    them are written again, which happens once per doubling of the ledger. A batch that comes again under its name
    changes nothing. A replayed row must carry the batch of its original: it is dropped by id within its batch.
    """

    COLUMNS = "key binary, n bigint, seen_at string, first_id string, keep_id string, bucket int"

    def __init__(self, spark: SparkSession, path: str, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.path, self.bucket_keys = spark, path, bucket_keys

    def manifest(self) -> dict:
        return json.loads(storage.read_text(self.spark, f"{self.path}/manifest.json") or '{"version": 0, "number": 1, "keys": 0, "buckets": {}, "folded": []}')

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The current rows, of all buckets or of some; reads the files of these buckets alone."""
        state = self.manifest()
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in state["buckets"].items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], self.COLUMNS)
        plain = self.COLUMNS.rpartition(",")[0]
        return self.spark.read.schema(plain).parquet(*paths).withColumn("bucket", self._bucket(state["number"]))

    @staticmethod
    def _bucket(number: int) -> Column:
        return F.pmod(F.hash("key"), F.lit(number))

    def fold(self, batch: DataFrame, name: str) -> bool:
        """Add a batch of ``id, key, seen_at`` (ids distinct); False if a batch of this name was added before."""
        state = self.manifest()
        if name in state["folded"]:
            return False
        version = state["version"] + 1
        new = batch.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("seen_at", "id")).alias("first"), F.min("id").alias("keep_id"))
        delta = f"{self.path}/delta-{version}"
        new.select("key", "n", F.col("first.seen_at").alias("seen_at"), F.col("first.id").alias("first_id"), "keep_id").write.mode("overwrite").parquet(delta)
        new = self.spark.read.parquet(delta)
        state["keys"] += new.count()  # an upper bound, as some keys are held already
        number = max(state["number"], 1 << max(0, -(-state["keys"] // self.bucket_keys) - 1).bit_length())
        new = new.withColumn("bucket", self._bucket(number))
        if number > state["number"]:
            touched = list(range(number))
            old = self.read().withColumn("bucket", self._bucket(number)) if state["buckets"] else None
        else:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most one row per bucket
            old = self.read(touched) if state["buckets"] else None
        merged = new if old is None else self._merge(old, new)
        folder = f"{self.path}/v={version}"
        merged.repartition(number, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        gone = [f"{self.path}/v={v}/bucket={b}" for b, v in state["buckets"].items() if number > state["number"] or int(b) in touched]
        held = {} if number > state["number"] else state["buckets"]
        held |= {str(b): version for b in touched if storage.exists(self.spark, f"{folder}/bucket={b}")}
        storage.write_text(self.spark, f"{self.path}/manifest.json", json.dumps({"version": version, "number": number, "keys": state["keys"], "buckets": held, "folded": [*state["folded"], name]}))
        for path in [delta, *gone]:
            storage.delete(self.spark, path)
        return True

    @staticmethod
    def _merge(old: DataFrame, new: DataFrame) -> DataFrame:
        o, n = old.alias("o"), new.alias("n")
        both = o.join(n, (F.col("o.key") == F.col("n.key")) & (F.col("o.bucket") == F.col("n.bucket")), "full_outer")
        first = F.least(*[F.when(F.col(f"{s}.key").isNotNull(), F.struct(F.col(f"{s}.seen_at").alias("at"), F.col(f"{s}.first_id").alias("id"))) for s in "on"])
        return both.select(
            F.coalesce("o.key", "n.key").alias("key"),
            (F.coalesce("o.n", F.lit(0)) + F.coalesce("n.n", F.lit(0))).alias("n"),
            first["at"].alias("seen_at"),
            first["id"].alias("first_id"),
            F.least("o.keep_id", "n.keep_id").alias("keep_id"),
            F.coalesce("o.bucket", "n.bucket").alias("bucket"),
        )


def fold_cards(cards: DataFrame, scratch: storage.Scratch) -> tuple[DataFrame, CopyLedger]:
    """All cards through a ledger: everything before the newest batch as the base, then the newest batch on top."""
    members = scratch.cut(keyed_cards(cards), "members")
    newest = members.agg(F.max("batch")).first()[0]
    ledger = CopyLedger(cards.sparkSession, scratch.path("ledger"))
    ledger.fold(members.filter(F.coalesce(F.col("batch") != newest, F.lit(True))) if newest else members, f"before {newest}")
    if newest:
        ledger.fold(members.filter(F.col("batch") == newest), newest)
    return members, ledger


def copies_found(cards: DataFrame) -> DataFrame:
    """``keep_id, copy_id``: for each set of equal cards its smallest id, with each other id. Empty input: no rows."""
    members, ledger = fold_cards(cards, storage.Scratch(cards.sparkSession, "ledger"))
    sets = ledger.read().filter("n > 1").select("key", "keep_id", "n")
    joined = storage.join_by_size(members.select("id", "key"), sets, "key", "n", F.lit(members.count()))
    return joined.filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def distinct_cards(cards: DataFrame) -> DataFrame:
    """``keep_id, first_id, copies``: one row per distinct card."""
    _, ledger = fold_cards(cards, storage.Scratch(cards.sparkSession, "ledger"))
    return ledger.read().select("keep_id", "first_id", F.col("n").alias("copies"))
