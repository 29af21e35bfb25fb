import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardmill import storage
from cardmill.operators import audit, candidates, classify, cluster, features, registry, similar
from cardmill.plans import audits
from cardmill.settings import Profile, Settings, Taxonomy

WORDS = "load balancer queue cache node token replica index session request server agree waits nine layer".split()


def records(spark, rows):
    df = spark.createDataFrame([(i, f, b, d, "Basic", "{}") for i, f, b, d in rows], "id string, f string, b string, deck string, kind string, scope string")
    return audits.records(df, "id", "f", "b", "deck", "kind", "scope", normalized=False)


def made(n, seed):
    rng = random.Random(seed)
    return [(f"r{i:03}", " ".join(rng.choices(WORDS, k=rng.randrange(2, 6))), "back " + rng.choice(WORDS), "A::B") for i in range(n)]


def test_jaccard_join_is_complete(spark):
    r = records(spark, made(150, 1))
    sets = {x.record_id: set(x.content) for x in r.collect() if x.content}
    first = {}
    for k in sorted(sets):
        first.setdefault(tuple(sorted(sets[k])), k)
    want = {(a, b) for a in first.values() for b in first.values() if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert {(x.a, x.b) for x in candidates.jaccard_join(r).collect()} == want
    grouped = candidates.expand_equal_sets(candidates.jaccard_join(r), r)
    assert {(x.a, x.b) for x in grouped.collect()} == want | {(first[tuple(sorted(s))], k) for k, s in sets.items() if first[tuple(sorted(s))] != k}


def test_vector_join_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 8)]
    df = spark.createDataFrame(rows, "record_id bigint, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.5}
    assert {(r.a, r.b) for r in candidates.vector_join(df, 0.5, block=16).collect()} == want
    assert {(r.a, r.b) for r in candidates.vector_join(df.filter("record_id < 20"), 0.5, block=16, other=df).collect() if r.a != r.b} == {(i, j) for i in range(20) for j in range(90) if i != j and s[i, j] >= 0.5}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(70)] + [(200, 201 + i) for i in range(40)] + [(500, 500)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.id: r.root for r in cluster.components(df, storage.Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(71)} | {i: 200 for i in range(200, 241)}
    assert cluster.components(df.limit(0), storage.Scratch(spark, "t")).count() == 0


def test_clusters_of_paraphrases_do_not_bridge(spark):
    rows = [("a", "What is a CDN?", "x", "D"), ("b", "Define CDN", "y", "D"), ("c", "¿Qué es un CDN?", "z", "D"), ("d", "Advantages of a CDN for static sites", "w", "D"), ("e", "Guide to CDN setup", "v", "D")]
    _, members, found = audits.duplicate_clusters(records(spark, rows), Settings())
    assert [(r.representative, r.size, r.score_floor) for r in found.collect()] == [("a", 3, 0.95)]
    assert sorted(r.id for r in members.collect()) == ["a", "b", "c"] and {r.cluster_id for r in members.collect()} == {found.first().cluster_id}


def test_cluster_ids_follow_from_the_ids_as_text(spark):
    import hashlib

    edges = spark.createDataFrame([(i, i + 1) for i in range(8, 120)] + [(500, 1000)], "a bigint, b bigint")
    scratch = storage.Scratch(spark, "t")
    got = {(r.root, r.size): r.cluster_id for r in cluster.members(cluster.components(edges, scratch), scratch).collect()}
    want = {(min(m), len(m)): hashlib.sha1("||".join(sorted(map(str, m))).encode()).hexdigest()[:12] for m in ([*range(8, 121)], [500, 1000])}
    assert got == want


def test_vectors_alone_never_link_two_vendors(spark):
    rows = [("a", "alpha bravo", "x", "aws"), ("b", "charlie delta", "y", "azure"), ("c", "echo foxtrot", "z", "aws"), ("d", "golf hotel", "w", None)]
    df = spark.createDataFrame([(*r[:3], f'{{"vendor": "{r[3]}"}}' if r[3] else None) for r in rows], "id string, f string, b string, s string")
    recs = audits.records(df, "id", "f", "b", None, None, "s")
    vectors = spark.createDataFrame([(i, [1.0, 0.01 * k]) for k, i in enumerate("abcd")], "record_id string, vector array<double>")
    edges, _, _ = audits.duplicate_clusters(recs, Settings(), vectors)
    assert {(r.a, r.b) for r in edges.collect()} == {("a", "c"), ("a", "d"), ("b", "d"), ("c", "d")}
    with pytest.raises(Exception, match="vendor"):
        cluster.score_pairs(edges.select("a", "b"), recs.drop("vendor"), 0.9).collect()


def test_representative_is_first_in_record_order(spark):
    df = spark.createDataFrame([("x1", "same front", "b", None, "2024-02"), ("x2", "same front", "c", None, "2024-01"), ("anki:9", "same front", "d", 9, "2025"), ("y1", "two words", "b", None, "2024-03"), ("y2", "two words", "c", None, "2024-01")], "id string, f string, b string, note bigint, made string")
    place = df.select(F.col("id").alias("record_id"), features.record_place(F.col("note"), F.col("made")).alias("place"))
    recs = audits.records(df, "id", "f", "b", None, None, None).join(place, "record_id")
    assert sorted(r.representative for r in audits.duplicate_clusters(recs, Settings())[2].collect()) == ["anki:9", "y2"]


def test_lookup_is_complete(spark):
    rows = [(f"r{i:03}", f, b, d) for i, (_, f, b, d) in enumerate(made(120, 9))] + [("r900", "the of", "same", "D"), ("r901", "the of", "other", "D")]
    r = storage.Scratch(spark, "t").cut(records(spark, rows), "r")
    asked = r.filter("record_id LIKE '%0'")
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(k[0], (rng.normal(size=4) + 3).tolist()) for k in rows], "record_id string, vector array<double>")
    for least, held in ((0.75, None), (0.6, None), (0.75, vectors)):
        every = asked.select(F.col("record_id").alias("q")).join(r.select(F.col("record_id").alias("r"))).filter("q <> r").withColumn("cosine", F.lit(None).cast("double"))
        if held is not None:
            every = candidates.with_cosine(every.withColumnsRenamed({"q": "a", "r": "b"}), held).withColumnsRenamed({"a": "q", "b": "r"})
        want, got = ({(x.q, x.r, x.score) for x in similar.top_similar(p, asked, r, least).collect()} for p in (every, similar.lookup_pairs(asked, r, least, held)))
        assert got == want and len(want) > 10


def test_complete_covers_blocked(spark):
    r = storage.Scratch(spark, "t").cut(audits.with_blocks(records(spark, made(80, 2))), "r")
    roots = []
    for pairs in (candidates.blocked(r), candidates.complete(r).select("a", "b")):
        edges = cluster.score_pairs(pairs, r, 0.9)
        roots.append({(x.id, x.root) for x in cluster.components(edges, storage.Scratch(spark, "t")).collect()})
    assert roots[0] <= roots[1] or {x for x, _ in roots[0]} <= {x for x, _ in roots[1]}


def test_rare_tokens_are_anchors(spark):
    rows = [(f"r{i}", "common words here", "b", None) for i in range(10)] + [("z", "common zyxw here", "b", None)]
    r = records(spark, rows)
    got = {x.record_id: x.anchors for x in features.anchors(r, features.idf(r)).collect()}
    assert got["z"][0] == "zyxw"


def test_block_keys(spark):
    r = audits.with_blocks(records(spark, [("a", "What is DNS?", "b", "Top::Sub")])).first()
    assert "deck:top sub:basic" in r.block_keys and "semantic:definition::dns" in r.block_keys and r.block_keys == sorted(set(r.block_keys))


TAX = Taxonomy.of({"vendor": ["aws", "azure"], "topic": ["storage", "network"], "type": ["definition", "comparison"]})
RULES = Profile(keyword_rules={"vendor": {"azure": ["azure"], "aws": ["aws", "s3"]}}, topic_keywords={"storage": ["s3", "bucket"], "unknown": ["dns"], "network": ["dns"]}, deck_tag_rules={"Cloud::AWS": {"vendor": "aws", "cert": "clf"}})


def test_classify(spark):
    rows = [
        ("a", "What is S3?", "a bucket", "X::Cloud::AWS", ["vendor::azure", "topic::nope", "bad", "topic::nope"]),
        ("b", "What is DNS?", "azure names", None, None),
        ("c", "nothing", "at all", "", []),
    ]
    df = spark.createDataFrame(rows, "record_id string, front string, back string, deck string, suggested_tags array<string>")
    got = {r.record_id: r for r in classify.classify(df, RULES, TAX).collect()}
    assert got["a"].scope == {"vendor": "azure", "cert": "clf", "topic": "storage", "type": "definition"}  # a valid tag comes before the deck
    assert got["a"].tags_unresolved == ["_unresolved::topic::nope", "_unresolved::bad", "_unresolved::topic::nope"]
    assert got["a"].tags_resolved == ["vendor::azure", "topic::storage", "type::definition"] and got["a"].confidence == "medium"
    assert got["b"].scope == {"vendor": "azure", "topic": "network", "type": "definition"} and got["b"].confidence == "high"
    assert got["c"].scope == {} and got["c"].confidence == "low"


def test_routing(spark):
    cards = spark.createDataFrame([("a", {"cert": "Clf"}), ("b", {"vendor": "az"}), ("c", {"vendor": "none"}), ("d", {})], "record_id string, scope map<string,string>")
    decks = spark.createDataFrame([("R", 0), ("R::Azure", 1), ("R::X::CLF", 2), ("Other::CLF", 3)], "deck_name string, ordinal int")
    got = {r.record_id: r.deck for r in classify.route_decks(cards, decks, ["cert", "vendor"], "R").collect()}
    assert got == {"a": "R::X::CLF", "b": "R::Azure", "c": "R", "d": "R"}


def test_vote(spark):
    m = spark.createDataFrame([("q", "x", 0.90, 1), ("q", "y", 0.85, 2), ("q", "z", 0.80, 3), ("q", "w", 0.60, 4), ("p", "x", 0.9, 1)], "q string, r string, score double, rank int")
    f = spark.createDataFrame([("x", "vendor", "aws"), ("y", "vendor", "aws"), ("z", "vendor", "azure"), ("z", "topic", "invalid"), ("w", "topic", "storage")], "r string, category string, value string")
    t = spark.createDataFrame([(c, v) for c, vs in TAX.categories.items() for v in vs], "category string, value string")
    got = {(r.q, r.category): (r.value, r.confidence, r.votes) for r in similar.facet_vote(m, f, t).collect()}
    assert got == {("q", "vendor"): ("aws", 0.686, 2), ("p", "vendor"): ("aws", 1.0, 1)}
    scopes = spark.createDataFrame([("q", {}), ("p", {})], "q string, scope map<string,string>")
    assert all(r.applied == [] for r in similar.apply_votes(scopes, similar.facet_vote(m, f, t)).collect())  # .686 and one vote: not sure


def test_status_and_queues(spark):
    rows = [("1", "insert", None, False, "aprobada"), ("2", "insert", 5, True, "subida"), ("3", "insert", None, True, "en-revision"), ("4", "possible_duplicate", 5, False, "en-revision"), ("5", "reject", None, False, "descartada")]
    df = spark.createDataFrame(rows, "id string, action string, note bigint, bad boolean, want string")
    assert all(r.want == r.got for r in df.withColumn("got", registry.derive_status(F.col("action"), F.col("note"), F.col("bad"))).collect())
    cards = spark.createDataFrame([("a", "aprobada", None, "2"), ("b", "en-revision", None, "1"), ("c", "en-revision", None, "3"), ("d", "subida", 4, "1")], "id string, status string, anki_note_id bigint, created_at string")
    assert [r.id for r in registry.review_queue(cards).collect()] == ["c", "b"]
    assert [r.id for r in registry.sync_queue(cards).collect()] == ["a"]
    assert [r.id for r in registry.orphans(cards, spark.createDataFrame([(5,)], "note_id bigint")).collect()] == ["d"]


def test_fold(spark):
    rows = [
        ("a", 1, "inserted", "aprobada", None, "x"), ("a", 2, "uploaded", "subida", 9, None), ("a", 3, "fields_updated", None, None, "y"), ("a", 4, "deleted_in_anki", "borrada-en-anki", None, None),
        ("b", 1, "inserted", "aprobada", None, "x"), ("b", 2, "purged", None, None, None), ("c", 1, "purged", None, None, None), ("c", 2, "inserted", "en-revision", None, "z"), ("d", 1, "action", "aprobada", None, None),
    ]
    df = spark.createDataFrame(rows, "record_id string, seq bigint, event string, status string, anki_note_id bigint, target_deck string")
    got = {r.record_id: (r.status, r.anki_note_id, r.target_deck) for r in registry.fold(df, ["status", "anki_note_id", "target_deck"]).collect()}
    assert got == {"a": ("borrada-en-anki", 9, "y"), "c": ("en-revision", None, "z")}


def test_upsert_undo_prefix(spark):
    kind = "id string, fingerprint string, status string, created_at string, ingest_batch string, sync_batch string, anki_note_id bigint"
    held = spark.createDataFrame([("h1", "p", "aprobada", "1", "i", None, None), ("h2", "q", "descartada", "1", "i", None, None)], kind)
    batch = spark.createDataFrame([("n1", "p", None, "2", "j", None, None), ("n2", "q", None, "2", "j", None, None), ("n3", "r", None, "2", "j", None, None), ("n4", "r", None, "3", "j", None, None)], kind)
    assert {r.id: r.outcome for r in registry.upsert(batch, held).collect()} == {"n1": "updated", "n2": "resurrected", "n3": "new", "n4": "updated"}
    cards = spark.createDataFrame([("a1", "p", "subida", "1", "i", "s", 3), ("a2", "q", "aprobada", "1", "i", None, None), ("b", "r", "aprobada", "1", "j", None, None)], kind)
    kept, counts = registry.undo_ingest(cards, "i")
    assert {r.id for r in kept.collect()} == {"a1", "b"} and tuple(counts.first()) == (1, 1)
    assert [(r.status, r.anki_note_id) for r in registry.undo_sync(cards, "s").filter("id = 'a1'").collect()] == [("aprobada", None)]
    for prefix, want in (("a", "ambiguous"), ("a1", "found"), ("b", "found"), ("z", "missing")):
        assert registry.by_prefix(cards, prefix).first().outcome == want


def test_decide(spark):
    cards = spark.createDataFrame([("a", ["x", "y"], ["x", "y"]), ("b", ["x", "y"], ["x"]), ("c", ["x"], ["x"]), ("d", [], [])], "record_id string, suggested_tags array<string>, tags_unresolved array<string>")
    m = spark.createDataFrame([("a", "p", 0.95, 1, ["exact_front"], False), ("b", "s", 0.99, 1, ["exact_front"], True), ("d", "p", 0.89, 1, ["token_overlap"], False)], "q string, r string, score double, rank int, reasons array<string>, sibling boolean")
    got = {r.record_id: (r.action, r.status) for r in audit.decide(cards, m, Settings()).collect()}
    assert got == {"a": ("possible_duplicate", "en-revision"), "b": ("insert", "en-revision"), "c": ("reject", "descartada"), "d": ("insert", "aprobada")}
    assert "(exact_front, score=0.95)" in audit.decide(cards, m, Settings()).filter("record_id = 'a'").first().reason


def test_batch_siblings_never_are_duplicates(spark):
    held = audits.with_blocks(records(spark, [("p", "What is a queue?", "a line", "D"), ("o", "unrelated words", "b", "D")]))
    batch = audits.with_blocks(records(spark, [("n1", "What is DNS?", "names", "D"), ("n2", "Define DNS", "names again", "D"), ("n3", "Define a queue", "x", "D")])).drop("scope")
    batch = batch.withColumn("suggested_tags", F.array().cast("array<string>")).withColumn("idx", F.substring("record_id", 2, 1).cast("int"))
    out = audit.audit_batch(batch, held, RULES, TAX, Settings(), storage.Scratch(spark, "t"))
    got = {r.record_id: (r.action, r.match_ids) for r in out.collect()}
    assert got["n1"][0] == got["n2"][0] == "insert" and got["n3"] == ("possible_duplicate", ["p"])
    assert {r.record_id for r in audit.annotate(out, held).collect()} == {"n1", "n2", "n3"}


def test_page(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    rows = audit.page(df, ["k"], 2, 3).collect()
    assert [(r.k, r.total, r.next_offset) for r in rows] == [(2, 7, 5), (3, 7, 5), (4, 7, 5)]
    assert audit.page(df, ["k"], 5, 3).first().next_offset is None
    with pytest.raises(ValueError):
        audit.page(df, ["k"], -1, 3)


def test_decks_and_proposals(spark):
    df = spark.createDataFrame([("A::B::C",), ("A::B",), ("A",), ("AB",), (None,)], "deck_name string")
    assert {r.deck_name: r.note_count for r in registry.deck_counts(df).collect()} == {"A": 3, "A::B": 2, "A::B::C": 1, "AB": 1}
    assert df.filter(registry.in_deck(F.col("deck_name"), "A")).count() == 3
    rows = [(f"k{i}", f"What is kubernetes part {w}?", "b", "D") for i, w in enumerate(["one", "one", "one"])]
    found = audits.taxonomy_proposals(records(spark, rows), ["topic"], TAX, Settings()).collect()
    assert [(r.label, r.size, r.is_new) for r in found] == [("kubernetes", 3, True)]


def test_settings():
    with pytest.raises(ValueError):
        Taxonomy.of({"a": "text"})
    assert Taxonomy.of({" a ": [" x ", "x", "", None, "y"]}).categories == {"a": ("x", "y")}
    assert TAX.add("vendor", "gcp").categories["vendor"][-1] == "gcp" and TAX.add("vendor", "aws") is TAX
    p = RULES.merged({"topic_keywords": {"storage": ["disk"]}, "required_categories": []})
    assert p.topic_keywords["storage"] == ["disk"] and "network" in p.topic_keywords and p.required_categories == RULES.required_categories
