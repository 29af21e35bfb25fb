import json

import pytest
from pyspark.sql import functions as F

from cardmill import storage
from cardmill.operators import registry
from cardmill.plans import audits
from cardmill.settings import Settings, Taxonomy, save_taxonomy
from cardmill.sources import cards, services
from cardmill.streaming import ingest

ITEMS = [{"front": "q", "back": "a", "source": "s", "suggested_tags": ["x"]}, {"front": " ", "back": "a", "source": "s"}, {"front": "q", "back": "a"}, {"front": "q2", "back": "a2", "source": "s", "extra": 1}]


def test_cards_from_text_and_files(spark, tmp_path):
    good, bad = cards.cards_from_json(spark, json.dumps(ITEMS))
    assert [(r.front, r.note_type, r.suggested_tags) for r in good.collect()] == [("q", "Basic", ["x"]), ("q2", "Basic", [])]
    assert sorted(r.error for r in bad.collect()) == ["front is empty", "source is missing"]
    with pytest.raises(ValueError):
        cards.cards_from_json(spark, "{}")
    (tmp_path / "a.json").write_text(json.dumps(ITEMS))
    assert cards.read_cards(spark, str(tmp_path / "a.json"))[0].count() == 2
    (tmp_path / "a.yaml").write_text("- {front: q, back: a, source: s}\n")
    assert cards.cards_from_file(spark, str(tmp_path / "a.yaml"))[0].count() == 1


def test_assignments(spark, tmp_path):
    text = json.dumps([{"note_id": 1, "tags": ["topic::x"]}, {"card": {"front": "f", "back": "b"}, "tags": ["bad"]}, {"tags": []}])
    rows = audits.apply_tags(cards.read_assignments(spark, text), Taxonomy.of({"topic": ["x"]})).collect()
    assert [(r.add, r.error) for r in rows] == [(["topic::x"], None), (None, "malformed tag"), (None, "give either a note or a card")]
    with pytest.raises(ValueError):
        cards.read_assignments(spark)


def test_tsv_round_trip(spark, tmp_path):
    rows = [('say "hi"', "tab\there", "a b"), ("line\nbreak", " blank ", ""), ("plain", "x", None)]
    df = spark.createDataFrame(rows, "front_original string, back_original string, tags_resolved string")
    cards.write_tsv(df, str(tmp_path / "out"))
    got = {(r.front, r.back, r.tags or "") for r in cards.read_tsv(spark, str(tmp_path / "out")).collect()}
    assert got == {(a, b, c or "") for a, b, c in rows}


def test_index_and_migration(spark):
    row = spark.createDataFrame([("a b", "c", "a", "x|y", "k1|k2")], "content_tokens string, back_tokens string, anchor_tokens string, char_trigrams string, block_keys string")
    there = cards.import_index(row)
    assert there.first().block_keys == ["k1", "k2"] and cards.export_index(there).first() == row.first()
    old = spark.createDataFrame([("1", "insert", None, "_unresolved::x", "aws", None, "")], "id string, action_taken string, anki_note_id bigint, tags_resolved string, scope_vendor string, scope_topic string, scope_cert string")
    new = cards.migrate(old).first()
    assert new.status == "en-revision" and json.loads(new.scope_json) == {"vendor": "aws"}


def test_note_source(spark):
    held = {"1": {"noteId": 1, "deckName": "A", "modelName": "Basic", "tags": ["t"], "fields": {"Front": {"value": "f"}, "Back": {"value": "b"}}}, "2": {"noteId": 2, "deckName": "A::B", "modelName": "Otro", "tags": [], "fields": {"Uno": {"value": "u"}, "Dos": {"value": "d"}}}, "3": {"noteId": 3, "deckName": "C", "modelName": "Basic", "fields": {"Front": {"value": " "}}}}
    services.register(spark)
    df = spark.read.format("cardmill_notes").option("notes", json.dumps(held)).load()
    assert {(r.note_id, r.front, r.back) for r in services.note_cards(df, "Front", "Back").collect()} == {(1, "f", "b"), (2, "u", "d")}
    assert spark.read.format("cardmill_notes").option("notes", json.dumps(held)).option("deck", "A").load().count() == 2
    assert services.expand_deck(["A", "A::B"], "Z") == ["Z"]


class Lengths:
    def embed(self, texts):
        return None if "bad" in texts else [[float(len(t))] for t in texts]


def test_embedding_and_answers(spark):
    rows = spark.createDataFrame([("p", "abc"), ("q", "de"), ("p", "abc")], "fingerprint string, text string")
    held = spark.createDataFrame([("q", [1.0])], "fingerprint string, vector array<double>")
    assert [(r.fingerprint, r.vector) for r in services.embed_missing(rows, held, Lengths()).collect()] == [("p", [3.0])]
    answers = spark.createDataFrame([('well: {"topic": "x", "vendor": "no"} ok',), ("no json",), (None,)], "a string")
    got = [r.f for r in answers.select(services.facets_from_answer(F.col("a"), {"topic": ("x",), "vendor": ("aws",)}).alias("f")).collect()]
    assert got == [{"topic": "x"}, {}, {}]


def test_sync(spark):
    kind = "id string, status string, anki_note_id bigint, note_type string, target_deck string, front_original string, back_original string, tags_resolved string"
    df = spark.createDataFrame([("a", "aprobada", None, "Basic", "D", "f", "b", "t1 t2"), ("b", "subida", 4, "Basic", "D", "f", "b", "")], kind)
    plan = audits.sync_plan(df, ["Basic"], Settings(), ["D"])
    done, errors = audits.sync(df, plan, services.MemoryNotes(decks=["D"]), "s1")
    assert [(r.record_id, r.status) for r in done.collect()] == [("a", "subida")] and errors.count() == 0
    bad = audits.sync_plan(df.withColumn("note_type", F.lit("Nope")), ["Basic"], Settings(), ["D"])
    done, errors = audits.sync(df, bad, services.MemoryNotes(), "s1")
    assert done.count() == 0 and errors.first().error == "unknown model: Nope"
    assert audits.sync(df, plan, services.MemoryNotes(), "s1", dry_run=True)[0].count() == 0
    assert registry.closest_name("Basc", ["Basic", "Cloze"]) == "Basic"


def test_streams(spark, tmp_path):
    kind = "id string, fingerprint string, status string, created_at string"
    spark.createDataFrame([("1", "p", "aprobada", "1"), ("2", "p", "aprobada", "2")], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    for more in (False, True):
        if more:
            spark.createDataFrame([("3", "p", "aprobada", "3"), ("4", "q", "aprobada", "4")], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {(r.id, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("1", "new"), ("2", "updated"), ("3", "updated"), ("4", "new")}


def test_stream_windows(spark, tmp_path):
    kind = "ts timestamp, event_type string, fingerprint string"
    spark.createDataFrame([("2024-01-01 01:00:00", "a", "p"), ("2024-01-01 02:00:00", "a", "p"), ("2024-01-03 00:00:00", "b", "q")], "ts string, event_type string, fingerprint string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.activity(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("cardmill_activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.sql("SELECT * FROM cardmill_activity").collect()) == [1, 2]


def test_fold_stream(spark, tmp_path):
    kind = "record_id string, seq bigint, event string, status string"
    spark.createDataFrame([("a", 1, "inserted", "aprobada"), ("a", 2, "deleted_in_anki", "borrada-en-anki")], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    ingest.fold_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), ["status"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in ingest.folded(spark, ["status"], str(tmp_path / "out")).collect()] == [("a", "borrada-en-anki")]
    # later batches read and write the buckets of their own records only
    rows = [("b", 1, "inserted", "aprobada"), ("a", 3, "purged", None), ("c", 1, "purged", None), ("c", 2, "inserted", "en-revision")]
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.fold_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), ["status"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {tuple(r) for r in ingest.folded(spark, ["status"], str(tmp_path / "out")).collect()} == {("b", "aprobada"), ("c", "en-revision")}


def test_card_files_of_every_shape(spark, tmp_path):
    import json

    made = [{"front": f"f{i}", "back": "two\nlines", "source": "s"} for i in range(5)] + [{"front": " ", "back": "b", "source": "s"}]
    shapes = {"lines": "\n".join(map(json.dumps, made)), "array": json.dumps(made), "spread": json.dumps(made, indent=1), "blank": "\n\n" + "\n".join(map(json.dumps, made))}
    for name, content in shapes.items():
        (tmp_path / f"{name}.json").write_text(content)
        good, bad = cards.read_cards(spark, str(tmp_path / f"{name}.json"))
        assert sorted(r.front for r in good.collect()) == [f"f{i}" for i in range(5)], name
        assert [r.error for r in bad.collect()] == ["front is empty"], name


def test_bucket_table(spark, tmp_path):
    table = storage.BucketTable(spark, str(tmp_path / "t"), "k", "k string, v bigint", buckets=16)
    assert table.read().count() == 0
    rows = spark.range(100).selectExpr("concat('k', id) AS k", "id AS v")
    table.replace(rows, table.touched(rows), 0)
    one = rows.filter("k = 'k7'")
    (only,) = table.touched(one)
    held = table.read([only])
    assert 0 < held.count() < 30
    table.replace(held.withColumn("v", F.col("v") + F.when(F.col("k") == "k7", 1000).otherwise(0)), [only], 1)
    assert table.read().count() == 100 and table.read().filter("k = 'k7'").first().v == 1007 and table.manifest()["done"] == 1
    assert sum(v == 2 for v in table.manifest()["buckets"].values()) == 1 and not storage.exists(spark, str(tmp_path / f"t/v=1/bucket={only}"))


def test_state_files_and_shared_folder(spark, tmp_path):
    path = str(tmp_path / "state.json")
    assert storage.read_text(spark, path) is None
    storage.write_text(spark, path, "one")
    storage.write_text(spark, path, "två")
    assert storage.read_text(spark, path) == "två"
    assert storage.shared_dir(spark) == storage.shared_dir(spark)


def test_join_by_size(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id < 4000, 'hot', concat('k', id % 100)) AS k")
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.upper("k"))
    out = storage.join_by_size(rows, groups, "k", "n", F.lit(5000))
    assert out.count() == 5000 and out.filter("v <> upper(k)").count() == 0


def test_snapshot_and_taxonomy_file(spark, tmp_path):
    path = cards.snapshot(spark.range(3), str(tmp_path), "20240101T000000Z")
    assert spark.read.parquet(path).count() == 3
    save_taxonomy(Taxonomy.of({"b": ["y", "x"], "a": ["z"]}), str(tmp_path / "t.yaml"))
    assert (tmp_path / "t.yaml").read_text() == "b:\n- y\n- x\na:\n- z\n"
