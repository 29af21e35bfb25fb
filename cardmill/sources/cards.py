"""Card and assignment files; TSV export; snapshots."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CARD = "front string, back string, source string, suggested_tags array<string>, note_type string, meta map<string,string>, profile string, deck string, material_origen string"


def read_cards(spark: SparkSession, path: str, multi_line: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid cards, errors) of JSON files: arrays of cards, or one card a line, which is read in splits.

    ``multi_line``: whether a document spans lines; by default that is told from the first line of the first file, so
    files of both kinds need to be read apart. A card needs a non-blank front and back and a source; others are errors
    with what is missing and don't stop the rest.
    """
    if multi_line is None:
        first = spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value")).head()
        multi_line = first is not None and (first[0][0] + first[0][-1]) not in ("{}", "[]")
    raw = spark.read.schema(CARD + ", _corrupt string").option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return _checked(raw)


def cards_from_json(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """The same from a JSON array in memory; anything but an array is an error of the call."""
    import json

    items = json.loads(text)
    if not isinstance(items, list):
        raise ValueError("expected a list of cards")
    lines = spark.createDataFrame([(json.dumps(i),) for i in items], "value string")
    raw = lines.select(F.from_json("value", CARD + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("c")).select("c.*")
    return _checked(raw)


def cards_from_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A small JSON or YAML file, or standard input by the name "-": JSON first, YAML if that fails."""
    import json
    import sys

    text = sys.stdin.read() if path == "-" else Path(path).read_text(encoding="utf-8")
    try:
        return cards_from_json(spark, text)
    except json.JSONDecodeError:
        import yaml

        return cards_from_json(spark, json.dumps(yaml.safe_load(text), default=str))


def _checked(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    error = F.when(F.col("_corrupt").isNotNull(), "not a card").when(blank("front"), "front is empty").when(blank("back"), "back is empty").when(F.col("source").isNull(), "source is missing")
    rows = raw.withColumn("error", error)
    good = rows.filter("error IS NULL").drop("error", "_corrupt").withColumns({"note_type": F.coalesce("note_type", F.lit("Basic")), "suggested_tags": F.coalesce("suggested_tags", F.array().cast("array<string>"))})
    return good, rows.filter("error IS NOT NULL").select("front", "back", "source", "error")


def read_assignments(spark: SparkSession, inline: str | None = None, path: str | None = None) -> DataFrame:
    """``note_id, front, back, tags`` of tag assignments, from exactly one of an inline JSON list and a JSON or YAML file."""
    import json

    if (inline is None) == (path is None):
        raise ValueError("give exactly one of inline and path")
    if inline is not None:
        items = json.loads(inline)
    elif str(path).endswith((".yaml", ".yml")):
        import yaml

        items = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    else:
        items = json.loads(Path(path).read_text(encoding="utf-8"))
    rows = [(i.get("note_id"), (i.get("card") or {}).get("front"), (i.get("card") or {}).get("back"), i.get("tags") or []) for i in items]
    return spark.createDataFrame(rows, "note_id bigint, front string, back string, tags array<string>")


def write_tsv(cards: DataFrame, path: str, front: str = "front_original", back: str = "back_original", tags: str = "tags_resolved") -> None:
    """Front, back and space-joined tags, no header, quoted only where needed."""
    joined = F.array_join(tags, " ") if cards.schema[tags].dataType.typeName() == "array" else F.col(tags)
    out = cards.select(*[F.coalesce(c, F.lit("")).alias(n) for n, c in (("front", F.col(front)), ("back", F.col(back)), ("tags", joined))])
    out.write.mode("overwrite").option("sep", "\t").option("quote", '"').option("escape", '"').option("quoteAll", False).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("front string, back string, tags string").option("sep", "\t").option("quote", '"').option("escape", '"').option("multiLine", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def snapshot(cards: DataFrame, root: str, stamp: str) -> str:
    """A dated copy of the registry; the stamp is ``%Y%m%dT%H%M%SZ``."""
    path = f"{root}/registry-{stamp}"
    cards.write.mode("errorifexists").parquet(path)
    return path


def import_index(rows: DataFrame) -> DataFrame:
    """An index with delimited text columns as one with arrays: tokens by blank, trigrams and keys by bar."""
    split = lambda c, by: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), by), lambda x: x != "")
    return rows.withColumns({c: split(c, " ") for c in ("content_tokens", "back_tokens", "anchor_tokens")} | {c: split(c, r"\|") for c in ("char_trigrams", "block_keys")})


def export_index(rows: DataFrame) -> DataFrame:
    """The inverse of ``import_index``. A key that holds a bar itself comes back in parts: keep arrays where you can."""
    return rows.withColumns({c: F.array_join(c, " ") for c in ("content_tokens", "back_tokens", "anchor_tokens")} | {c: F.array_join(c, "|") for c in ("char_trigrams", "block_keys")})


def migrate(cards: DataFrame) -> DataFrame:
    """An older registry with the current columns: missing ones null, status from action, facet columns into ``scope_json``."""
    from cardmill.operators.registry import derive_status

    have = set(cards.columns)
    for c in ("profile_name", "target_deck", "material_origen", "sync_batch", "audit_action", "ingest_batch", "reason", "status", "scope_json"):
        if c not in have:
            cards = cards.withColumn(c, F.lit(None).cast("string"))
    cards = cards.withColumn("status", F.coalesce("status", derive_status(F.col("action_taken"), F.col("anki_note_id"), F.coalesce(F.col("tags_resolved").contains("_unresolved::"), F.lit(False)))))
    legacy = [c for c in ("scope_vendor", "scope_topic", "scope_cert") if c in have]
    if legacy:
        pairs = F.filter(F.array(*[F.struct(F.lit(c[6:]).alias("key"), F.col(c).alias("value")) for c in legacy]), lambda e: F.coalesce(F.trim(e["value"]), F.lit("")) != "")
        cards = cards.withColumn("scope_json", F.coalesce("scope_json", F.to_json(F.map_from_entries(pairs)))).drop(*legacy)
    return cards
