import json

from pyspark.sql import functions as F

from cardmill import cli, storage
from cardmill.operators import registry
from cardmill.plans import audits, curation, reports
from cardmill.settings import Profile, Settings, Taxonomy
from cardmill.sources import cards as files
from cardmill.sources import services

TAX = Taxonomy.of({"topic": ["dns", "queues"], "type": ["definition"]})
RULES = Profile(required_categories=("topic",), topic_keywords={"dns": ["dns"], "queues": ["queue"]})
CARD = "idx bigint, front string, back string, source string, suggested_tags array<string>, note_type string, profile string, deck string, material_origen string"


def batch(spark, *rows):
    return spark.createDataFrame([(i, f, b, "me", t, "Basic", None, "D", None) for i, (f, b, t) in enumerate(rows)], CARD)


def log(spark, tmp_path):
    return curation.RegistryLog(spark, str(tmp_path / "registry"))


def test_ingest_review_resolve_and_undo(spark, tmp_path):
    held = log(spark, tmp_path)
    rows = batch(spark, ("What is DNS?", "names to numbers", []), ("Define a queue", "a line", ["topic::queues", "topic::nope"]), ("odd", "words", ["x", "y"]), ("What is DNS?", "names to numbers", []))
    report, events = curation.ingest(rows, held.cards(), RULES, TAX, Settings(), "b1", "2024-01-01")
    assert [(r.action, r.audit) for r in report.orderBy("idx").collect()] == [("insert", "insert"), ("insert", "insert"), ("reject", "reject"), ("updated", "insert")]
    held.append(events)
    now = {r.front_original: r for r in held.cards().collect()}
    assert {f: r.status for f, r in now.items()} == {"What is DNS?": "aprobada", "Define a queue": "en-revision", "odd": "descartada"}
    dns = now["What is DNS?"]
    assert json.loads(dns.scope_json) == {"topic": "dns", "type": "definition"} and dns.audit_action == "insert" and dns.ingest_batch == "b1" and len(dns.id) == 36
    # the same again: held cards are updated, a removed one comes back; nothing is added
    report, events = curation.ingest(rows.limit(3), held.cards(), RULES, TAX, Settings(), "b2", "2024-01-02")
    assert [r.action for r in report.orderBy("idx").collect()] == ["updated", "updated", "resurrected"]
    held.append(events)
    assert held.cards().count() == 3 and {r.status for r in held.cards().filter("front_original = 'odd'").collect()} == {"aprobada"}
    skipped, none = curation.ingest(rows.limit(1), held.cards(), RULES, TAX, Settings(), "b3", "2024-01-03", mode="skip")
    assert [r.action for r in skipped.collect()] == ["skipped"] and none.count() == 0
    # a near duplicate is listed for review, and settled
    report, events = curation.ingest(batch(spark, ("Define DNS", "other words", [])), held.cards(), RULES, TAX, Settings(), "b4", "2024-01-04")
    assert report.first().action == "possible_duplicate" and report.first().match_ids == [dns.id]
    held.append(events)
    waiting = curation.review_list(held.cards()).collect()
    assert [r.front for r in waiting] == ["Define DNS", "Define a queue"] and waiting[0].id_short == waiting[0].id[:8]
    outcome, events, shown = curation.resolve(held.cards(), waiting[0].id[:8], "approve", 0)
    assert outcome == "found" and shown.first().status == "aprobada"
    held.append(events)
    assert held.cards().filter(F.col("id") == waiting[0].id).first().status == "aprobada"
    assert curation.resolve(held.cards(), "zz", "reject", 0)[0] == "missing"
    # a correction is audited again, without itself
    done, events = curation.correct(held.cards(), waiting[1].id, "What is a message bus?", "a shared line", ["topic::queues"], RULES, TAX, Settings(), 0)
    assert done.first().action == "insert"
    held.append(events)
    new = held.cards().filter(F.col("id") == waiting[1].id).first()
    assert (new.front_original, new.tags_resolved, new.status, new.created_at) == ("What is a message bus?", "topic::queues type::definition", "aprobada", "2024-01-01")
    # batches are taken back
    kind, events, _ = curation.undo(held.cards(), "b1", 0)
    assert kind == "ingest" and curation.undo(held.cards(), "none", 0)[0] == "none"
    held.append(events)
    assert {r.ingest_batch for r in held.cards().collect()} == {"b4"}
    outcome, events, _ = curation.resolve(held.cards(), waiting[0].id, "purge", 0)
    held.append(events)
    assert held.cards().count() == 0


def test_sync_reconcile_and_undo(spark, tmp_path):
    held, notes = log(spark, tmp_path), SharedNotes(str(tmp_path / "notes.json"))
    _, events = curation.ingest(batch(spark, ("What is DNS?", "names", []), ("Define a queue", "a line", [])), held.cards(), RULES, TAX, Settings(), "b1", "2024-01-01")
    held.append(events)
    plan = audits.sync_plan(held.cards(), ["Basic"], Settings(), ["D"])
    assert audits.sync(held.cards(), plan, None, "s1", tsv=str(tmp_path / "tsv"))[0].count() == 0 and files.read_tsv(spark, str(tmp_path / "tsv")).count() == 2
    for _ in range(2):  # a task that runs twice finds the note that it added
        done, errors = audits.sync(held.cards(), plan, notes, "s1", backup=str(tmp_path / "backup"), stamp=str(_))
        assert errors.count() == 0 and done.count() == 2 and len(notes.read()) == 2
    assert spark.read.parquet(str(tmp_path / "backup/registry-0")).count() == 2
    up = done.select("record_id", F.lit(0).cast("bigint").alias("seq"), "event", "anki_note_id", "status", "sync_batch", F.lit("insert").alias("action_taken"))
    for c in curation.COLUMNS:
        if c not in up.columns:
            up = up.withColumn(c, F.lit(None).cast("string"))
    held.append(up)
    assert {r.status for r in held.cards().collect()} == {"subida"}
    ids = [r.anki_note_id for r in held.cards().collect()]
    gone = curation.reconcile(held.cards(), spark.createDataFrame([(ids[0],)], "note_id bigint"), 0)
    assert [r.status for r in gone.collect()] == ["borrada-en-anki"]
    kind, events, deleted = curation.undo(held.cards(), "s1", 0, notes)
    assert kind == "sync" and sorted(deleted) == sorted(ids) and notes.read() == {}
    held.append(events)
    assert {(r.status, r.anki_note_id, r.sync_batch) for r in held.cards().collect()} == {("aprobada", None, None)}


class SharedNotes(services.MemoryNotes):
    """Notes in a file, so that tasks in other processes see the same ones."""

    def __init__(self, path):
        self.path = path
        super().__init__({}, ["D"])

    def read(self):
        try:
            with open(self.path) as f:
                return {int(k): v for k, v in json.load(f).items()}
        except FileNotFoundError:
            return {}

    def _locked(self, change):
        import fcntl

        with open(self.path + ".lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            self.held = self.read()
            out = change()
            with open(self.path, "w") as f:
                json.dump(self.held, f)
            return out

    def find(self, query):
        self.held = self.read()
        return super().find(query)

    def add(self, note):
        return self._locked(lambda: services.MemoryNotes.add(self, note))

    def delete(self, ids):
        self._locked(lambda: services.MemoryNotes.delete(self, ids))

    def add_tags(self, ids, tags):
        self._locked(lambda: services.MemoryNotes.add_tags(self, ids, tags))


def test_tags_for_notes_and_cards(spark, tmp_path):
    notes = services.MemoryNotes({5: {"tags": ["old"]}})
    given = files.read_assignments(spark, inline=json.dumps([{"note_id": 5, "tags": ["topic::dns", "topic::nope"]}, {"card": {"front": "What is DNS?", "back": "names"}, "tags": ["topic::dns"]}, {"note_id": 6, "tags": ["malformed"]}]))
    checked, decisions, events = curation.apply_tags(given, log(spark, tmp_path).cards(), RULES, TAX, Settings(), "b", "2024", notes)
    assert notes.held[5]["tags"] == ["old", "topic::dns"] and [r.error for r in checked.orderBy("note_id").collect()].count(None) == 2
    assert [r.action for r in decisions.collect()] == ["insert"] and events.filter("event = 'inserted'").first().tags_resolved == "topic::dns type::definition"


def test_reorganize_classify_and_dispatch(spark):
    df = spark.createDataFrame([(1, "What is DNS?", "names"), (2, "Define DNS", "names too"), (3, "odd words", "here")], "id bigint, f string, b string")
    rows = audits.records(df, "id", "f", "b", None, None, None, normalized=False).withColumn("suggested_tags", F.array().cast("array<string>"))
    notes = services.MemoryNotes({1: {}, 2: {}, 3: {}})
    health, tags = curation.reorganize(rows, ["topic"], RULES, TAX, Settings(), notes)
    assert health.first().asDict() == {"scanned": 3, "untagged": 3, "clusters": 1, "clustered": 2, "leeches": 0} and "tags" not in notes.held[1]
    curation.reorganize(rows, ["topic"], RULES, TAX, Settings(), notes, apply=True)
    assert notes.held[1]["tags"] == ["topic::dns", "type::definition"] and "tags" not in notes.held[3]
    settled, rest, summary = curation.auto_classify(rows.drop("scope", "vendor").withColumn("deck", F.lit("D")), RULES, TAX)
    assert settled.count() == 2 and rest.first().missing == ["topic"] and summary.first().asDict() == {"total": 3, "auto_classified": 2, "needs_review": 1, "saved_pct": 67}
    assert curation.audit_collection(" Health ", health=lambda: health, other=None).count() == 1
    assert curation.categories(["b", "a"], ["a", "c"]) == ["b", "a", "c"]
    assert spark.range(1).select(curation.stamp(F.to_timestamp(F.lit("2024-03-01 10:00:00")))).first()[0] == "20240301T100000Z"


def test_report_shapes(spark):
    df = spark.createDataFrame([(i, "the same front", f"back {i} " + "x" * 300) for i in range(4)] + [(9, "other", "b")], "id bigint, f string, b string")
    rows = storage.Scratch(spark, "t").cut(audits.records(df, "id", "f", "b", None, None, None), "r")
    _, members, clusters = audits.duplicate_clusters(rows, Settings())
    shown = reports.clusters_with_members(clusters, members, rows, sample=3).first()
    assert shown.size == 4 and [m.id for m in shown.members] == [0, 1, 2] and shown.representative.id == 0 and len(shown.members[0].back_excerpt) == 160
    found = spark.createDataFrame([(9, 0, 0.9, ["x"], 1, "keep_existing"), (9, 1, 0.8, ["x"], 2, "replace_old_with_new"), (9, 2, 0.8, ["x"], 3, None)], "q bigint, r bigint, score double, reasons array<string>, rank int, version string")
    (short,) = reports.matches(found, rows).collect()
    assert [(m.id, m.version) for m in short.matches] == [(0, None), (1, "replace_old_with_new")]
    assert len(reports.matches(found, rows, verbose=True).first().matches) == 3
    assert json.loads(reports.as_json(clusters).first().json)["size"] == 4


class Says:
    def answer(self, prompt):
        return None if "silent" in prompt else 'I think {"topic": "queues", "type": "nonsense", "vendor": "x"}'


def test_model_fallback_and_vectors(spark):
    df = spark.createDataFrame([("a", "f", "b", {"topic": "dns"}), ("b", "f", "b", {"type": "definition"}), ("c", "silent", "b", {})], "record_id string, front string, back string, scope map<string,string>")
    got = {r.record_id: r.model_scope for r in services.model_facets(df, ["topic", "type"], TAX.categories, Says()).collect()}
    assert got == {"a": {}, "b": {"topic": "queues"}, "c": {}}
    assert services.HttpModel("http://127.0.0.1:9", "m").answer("x") is None and not services.HttpEmbedder("http://127.0.0.1:9", "m").available()

    class Lengths:
        def embed(self, texts):
            return [[float(len(t))] for t in texts]

    recs = spark.createDataFrame([("1", "p", "abc"), ("2", "q", "de")], "record_id string, fingerprint string, text string")
    cache = spark.createDataFrame([("q", "m", 1, [9.0], "1"), ("p", "other", 1, [7.0], "1")], "fingerprint string, model string, dim int, vector array<double>, created_at string")
    vectors, new = services.embedded(recs, cache, Lengths(), "m", "2")
    assert {r.record_id: r.vector for r in vectors.collect()} == {"1": [3.0], "2": [9.0]}
    held = registry.cache_upsert(cache, new)
    assert {(r.fingerprint, r.model, r.vector[0]) for r in held.collect()} == {("q", "m", 9.0), ("p", "other", 7.0), ("p", "m", 3.0)}
    assert services.embeddings_used(recs, None).first().embeddings_used is False and services.embeddings_used(recs, Lengths()).first().embeddings_used


def test_index_refresh(spark):
    field = lambda k, v: {"name": k, "value": v}
    notes = spark.createDataFrame([(1, "A", "Basic", [], [field("Front", "New <b>front</b>"), field("Back", "b")]), (2, "A::B", "Basic", [], [field("Front", " ")]), (3, "C", "Basic", [], [field("Front", "other")])], services.NOTE)
    index = spark.createDataFrame([(7, "A::B", "old", "x"), (8, "C", "kept", "y")], "note_id bigint, deck_name string, front_normalized string, indexed_at string")
    decks = spark.createDataFrame([("A", 1, None, 5), ("C", 1, None, 1)], "deck_name string, include_subdecks int, last_refreshed_at string, note_count bigint")
    now, lines = audits.refresh_index(index, decks, notes, "A", "2024")
    assert {(r.note_id, r.front_normalized) for r in now.collect()} == {(1, "new front"), (8, "kept")}
    assert {(r.deck_name, r.last_refreshed_at, r.note_count) for r in lines.collect()} == {("A", "2024", 1), ("C", None, 1)}


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "cards.json").write_text(json.dumps([{"front": "What is DNS?", "back": "names", "source": "x"}, {"front": "", "back": "b", "source": "x"}]))
    base = ["--registry", str(tmp_path / "r")]
    assert cli.main([*base, "ingest", str(tmp_path / "cards.json")], spark) == 1  # one of them is no card
    assert '"action":"insert"' in capsys.readouterr().out
    assert cli.main([*base, "similar", "Define DNS"], spark) == 0 and '"semantic_key_match"' in capsys.readouterr().out
    assert cli.main([*base, "stats"], spark) == 0 and '"total":1' in capsys.readouterr().out
    assert cli.main([*base, "reject", "zz"], spark) == 1
    assert cli.main([*base, "sync", str(tmp_path / "out")], spark) == 0 and files.read_tsv(spark, str(tmp_path / "out")).count() == 1
    assert cli.main([*base, "audit-duplicates"], spark) == cli.main([*base, "review"], spark) == 0
