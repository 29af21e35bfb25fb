"""Results are whole: compared with all pairs, or with the order that they stand for."""

import json

from pyspark.sql import functions as F

from cardmill import catalog, storage
from cardmill.functions import scores
from cardmill.operators import audit, candidates, cluster, registry, tiles
from cardmill.plans import audits
from cardmill.settings import Settings


def records(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, f string, b string")
    return audits.records(df, "id", "f", "b", None, None, None, normalized=False)


def test_cosine_raises_lexical_pairs(spark):
    # token Jaccard 3/5, so 0.80 at most without vectors; a cosine of 0.6 is calibrated to more than 0.90
    rows = records(spark, [(1, "alpha bravo charlie delta", "x"), (2, "alpha bravo charlie echo", "y"), (3, "golf hotel india juliet", "z"), (4, "kilo lima mike november", "w")])
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, -1.0]), (4, None)], "record_id bigint, vector array<double>")
    edges, members, _ = audits.duplicate_clusters(rows, Settings(), vectors)
    got = {(r.a, r.b): (r.score, "embedding_match" in r.reasons) for r in edges.collect()}
    assert got == {(1, 2): (0.9269, True)}
    assert sorted(r.id for r in members.collect()) == [1, 2]


def test_own_vectors_come_before_cached(spark):
    good = [0.5] * 64
    rows = [(1, "p", json.dumps(good)), (2, "p", "[1, 2"), (3, "p", json.dumps(good[:32])), (4, "q", None), (5, "p", "[" + ", ".join(["NaN"] * 64) + "]")]
    notes = spark.createDataFrame(rows, "note_id bigint, fingerprint string, embedding_vector string")
    cache = spark.createDataFrame([("p", "m:64", [1.0] * 64, "1")], "fingerprint string, model string, vector array<double>, created_at string")
    got = {r.note_id: r.vector and r.vector[0] for r in registry.own_or_cached(notes, cache, "m:64").collect()}
    assert got == {1: 0.5, 2: 1.0, 3: 1.0, 4: None, 5: 1.0}


def test_blocks_of_any_size_give_all_pairs(spark):
    keys = {i: ["every"] * (i < 130) + [f"m{i % 3}"] + [f"s{i // 2}"] for i in range(140)}
    df = spark.createDataFrame(list(keys.items()), "record_id bigint, block_keys array<string>")
    want = sorted((a, b) for a in keys for b in keys if a < b and set(keys[a]) & set(keys[b]))
    assert len(want) > 8385  # the block of 130 alone
    for cell in (1000, 7):
        assert sorted((r.a, r.b) for r in candidates.blocked(df, cell=cell).collect()) == want


def test_large_blocks_are_not_copied_to_cells(spark):
    keys = {i: ["every", f"m{i % 3}", f"s{i // 2}"] if i % 5 else [f"m{i % 3}", f"s{i // 2}"] for i in range(200)}
    df = spark.createDataFrame(list(keys.items()), "record_id bigint, block_keys array<string>")
    pairs = candidates.blocked(df, cell=20)
    assert "sequence(" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((a, b) for a in keys for b in keys if a < b and set(keys[a]) & set(keys[b]))
    assert sorted((r.a, r.b) for r in candidates.blocked(df, cell=20, tile=30).collect()) == want


def test_pairs_of_large_blocks_take_little_space(spark, tmp_path):
    # by the key that records share, not by their ids: rows and columns then come in runs
    held = {i * 7919 % 3001: [i % 3, 10 + i % 4, 20 + i % 7] for i in range(1200)}
    df = spark.createDataFrame(list(held.items()), "id bigint, keys array<bigint>")
    tiles.sharing(df, storage.Scratch(spark, "t"), tile=700).write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs").collect()
    want = {(a, b) for a in held for b in held if a < b and set(held[a]) & set(held[b])}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 0.5 * len(want)


def test_tiles_of_text_ids_give_the_smaller_first(spark):
    names = [chr(c) + tail for c in (65, 97, 233, 0x4E00, 0xFF21, 0x1F600) for tail in ("", "1", "2")]  # by code point, as Spark orders text
    df = spark.createDataFrame([(n, [k % 2, 5 + k % 3]) for k, n in enumerate(names)], "id string, keys array<bigint>")
    want = sorted((a, b) for k, a in enumerate(names) for m, b in enumerate(names) if a < b and (k % 2 == m % 2 or k % 3 == m % 3))
    assert sorted((r.a, r.b) for r in tiles.sharing(df, storage.Scratch(spark, "t"), tile=5).collect()) == want


def test_blocked_pairs_of_a_large_block(spark, tmp_path):
    rows = [(i, f"word{i}q", f"back {i}", "Deck", "Basic", None, "2025") for i in range(60)]
    spark.createDataFrame(rows, "note_id bigint, front_normalized string, back_normalized string, deck_name string, note_type string, scope_json string, indexed_at string").write.parquet(f"{tmp_path}/indexed_notes.parquet")
    got = [(r.a, r.b) for r in catalog.queries()["blocked_pairs"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(a, b) for a in range(60) for b in range(a + 1, 60)]


def test_candidates_are_counted_without_forming_them(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=6 if i % 7 else 3).tolist() if i % 5 else None for i in range(90)}
    keys = {i: [i % 4, 100 + i // 3] if i % 9 else None for i in range(90)}
    df = spark.createDataFrame([(i, keys[i], vectors[i]) for i in range(90)], "id bigint, keys array<bigint>, vector array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items() if v}
    near = lambda a, b: a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.4
    want = sum(bool(set(keys[a] or []) & set(keys[b] or [])) or bool(near(a, b)) for b in range(90) for a in range(b))
    assert [r.pairs for r in tiles.count_met(df, 0.4, storage.Scratch(spark, "t"), tile=20).collect()] == [want]
    assert (scores.least_overlap(0.9, False), scores.least_overlap(0.9, True), scores.least_overlap(0.8, False)) == (0.69, 0.5, 0.5)


def test_vectors_meet_without_copies(spark):
    import numpy as np

    base = np.random.default_rng(5).normal(size=(12, 64))
    vectors = [(base[i % 12] + np.random.default_rng(i).normal(size=64) * 0.15).tolist() for i in range(90)]
    vectors[3:5] = [[1.0, 2.0], [2.0, 4.0]]  # of another width than the rest
    df = spark.createDataFrame(list(enumerate(vectors)), "record_id bigint, vector array<double>")
    unit = [np.array(v) / np.linalg.norm(v) for v in vectors]
    for least in (0.4, 0.96):
        want = {(a, b): unit[a] @ unit[b] for b in range(90) for a in range(b) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least}
        found = candidates.vector_join(df, least, block=20)
        assert "CoGroup" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.a, r.b): r.cosine for r in found.collect()}
        assert got.keys() == want.keys() and (3, 4) in got
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_members_of_equal_sets_keep_their_pairs(spark, tmp_path):
    # 1 and 2 have equal token sets; only 2 is close enough to 3 in trigrams for 0.80. 4 and 5 are copies without tokens, 6 and 7 share a question
    texts = ["abk cdm efn ghp", "efn cdm abk ghp", "efn cdm abk vqr", "the", "the", "What is DNS?", "Define DNS"]
    notes = [(i, f.lower(), "same" if i in (4, 5) else f"back {i}", "D", "Basic", None, "2025") for i, f in enumerate(texts, 1)]
    spark.createDataFrame(notes, "note_id bigint, front_normalized string, back_normalized string, deck_name string, note_type string, scope_json string, indexed_at string").withColumns({"fingerprint": F.lit("p"), "embedding_vector": F.lit(None).cast("string")}).write.parquet(f"{tmp_path}/indexed_notes.parquet")
    spark.createDataFrame([], "fingerprint string, model string, vector array<double>, created_at string").write.parquet(f"{tmp_path}/embedding_cache.parquet")
    got = {n: catalog.queries()[n](spark, str(tmp_path)).collect() for n in ("jaccard_pairs", "scored_edges", "pair_metrics")}
    rows = records(spark, [(i, f, b) for i, f, b, *_ in notes])
    every = rows.select(F.col("record_id").alias("a")).join(rows.select(F.col("record_id").alias("b"))).filter("a < b")
    scored = {(r.a, r.b): r.score for r in cluster.score_pairs(every, rows, 0.75).collect()}
    assert {(1, 2), (2, 3), (4, 5), (6, 7)} <= set(scored) and (1, 3) not in scored
    assert {(r.a, r.b): r.score for r in got["scored_edges"]} == scored and len(got["scored_edges"]) == len(scored)
    sets = {r.record_id: set(r.content) for r in rows.collect() if r.content}
    near = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert {(r.a, r.b, r.shared) for r in got["jaccard_pairs"]} == near and (2, 3, 3) in near
    assert len(got["jaccard_pairs"]) == len(near)
    # the metrics count the candidates of blocks, equal values and near vectors: here all share their deck's block
    assert got["pair_metrics"][0].pairs == 21 and got["pair_metrics"][0].reduction_pct == 0.0


def test_proposals_link_all_members(spark):
    rows = records(spark, [(1, "abk cdm efn ghp", "x"), (2, "efn cdm abk ghp", "y"), (3, "efn cdm abk vqr", "z")])
    _, members, _ = audits.duplicate_clusters(rows, Settings(cluster_threshold=0.75))
    assert sorted((r.root, r.id) for r in members.collect()) == [(1, 1), (1, 2), (1, 3)]


def test_votes_reach_the_end_of_a_chain(spark):
    # a card is similar to the two before it only, and the first two have the facet
    matches = spark.createDataFrame([(f"n{i}", f"n{i - k}", 0.9, k) for i in range(9) for k in (1, 2) if i >= k], "q string, r string, score double, rank int")
    scopes = spark.createDataFrame([(f"n{i}", {"topic": "storage"} if i < 2 else {}) for i in range(9)], "q string, scope map<string,string>")
    terms = spark.createDataFrame([("topic", "storage")], "category string, value string")
    out = audit.settle_votes(scopes, matches, terms.select(F.lit("other").alias("r"), "category", "value"), terms, storage.Scratch(spark, "t"))
    assert {r.q: r.scope for r in out.collect()} == {f"n{i}": {"topic": "storage"} for i in range(9)}
