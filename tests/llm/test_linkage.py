import itertools
import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from cardmill import storage
from cardmill.llm import linkage, shingles
from tests.llm.helpers import cards, pairs
from tests.llm.test_neardup import WORDS, edited, tri


def brute(rows):
    kept, out = {}, set()
    for id_, front, _, more in rows:
        if id_ is not None and more.get("ingest_batch") is not None:
            kept[id_] = (front, more)
    for i, (f, m) in kept.items():
        for j, (g, k) in kept.items():
            if k["ingest_batch"] < m["ingest_batch"] and k.get("status", "aprobada") in linkage.ACCEPTED:
                s, t = tri(f or ""), tri(g or "")
                same = m.get("fingerprint") is not None and m.get("fingerprint") == k.get("fingerprint")
                if same or (s | t and 5 * len(s & t) >= 4 * len(s | t)):
                    out.add((i,))
    return out


def fixture(seed, n=260):
    rng, rows = random.Random(seed), []
    for i in range(n):
        if rows and rng.random() < 0.5:
            f = edited(rng, rng.choice(rows)[1] or "abc")
        else:
            f = " ".join(rng.choices(WORDS, k=8)) + f" {rng.randrange(10**6)}"
        rows.append((f"{i:04}", f, "b", {"front_normalized": f, "ingest_batch": f"b{rng.randrange(9)}", "status": rng.choice(["aprobada", "subida", "descartada", "en-revision"]), "fingerprint": rng.choice([None, f"p{rng.randrange(200)}"])}))
    return rows


def test_against_all_pairs(spark):
    rows = fixture(1)
    assert pairs(linkage.repeated_cards(cards(spark, rows))) == brute(rows)


def test_batch_by_batch_in_sessions_of_their_own(spark):
    """Every batch by a new object that knows the folder only; buckets and merged parts as in a long history."""
    rows = fixture(2, 90)
    df = linkage._batched(cards(spark, rows)).cache()
    path, got = storage.Scratch(spark, "t").path("history"), set()
    for b in sorted({m["ingest_batch"] for *_, m in rows}):
        history = linkage.History(spark, path, bucket_rows=200)
        got |= pairs(history.process(df.filter(df.batch == b)))
    assert got == brute(rows)
    history = linkage.History(spark, path)
    assert history.state["epoch"] == 9 and all(len(p) <= 6 for p in history.state["tables"].values())
    assert max(p["buckets"] for p in history.state["tables"]["bands"]) > 4
    # the representatives are the components of all links
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in history.table("links").collect():
        a, b = sorted((find(r.tid), find(r.other)))
        parent[b] = a
    reps = {r.tid: r.rep for r in history.find(history.table("texts"), 100).collect()}
    assert len(reps) == history.table("texts").count()
    for x in list(parent):
        assert reps[x] == reps[find(x)]
    assert len({reps[x] for x in reps}) == len({find(x) for x in reps})


def test_a_batch_reads_its_own_buckets(spark):
    rows = [(f"{i:04}", f, "b", {"front_normalized": f}) for i in range(60) for f in [f"card number {i * 7919} about {WORDS[i % len(WORDS)]}"]]
    history = linkage.History(spark, storage.Scratch(spark, "t").path("h"), bucket_rows=8)
    history.process(linkage._batched(cards(spark, rows)))
    part = history.state["tables"]["bands"][0]
    read = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    keys = history.table("bands").select("key").limit(2)
    assert part["buckets"] >= 200 and len(read(history._probed("bands", part, keys, 2))) <= 2 < len(read(history.table("bands")))
    assert history.probe("bands", keys, 2).count() >= 2


def test_the_weights_decide(spark):
    rows = fixture(4, 120)
    df = linkage._batched(cards(spark, rows)).cache()
    history = linkage.History(spark, storage.Scratch(spark, "t").path("h"))
    history.state["weights"], history.state["cutoff"] = [[0.0] * n for n in linkage.FIELDS.values()], 1.0  # nothing reaches the cutoff
    fewer = pairs(history.process(df))
    assert fewer < brute(rows) and not history.table("links").count() and not history.table("parents").count()


def test_nulls_ties_empty(spark):
    m = lambda **k: {"ingest_batch": "b2", "fingerprint": None} | k
    rows = [
        ("a", "some front text", "b", m(ingest_batch="b1")),
        ("b", "some front text", "b", m()),
        ("c", "some front text", "b", m(ingest_batch="b1")),  # same batch as a
        ("d", "some front text", "b", m(ingest_batch=None)),
        ("e", None, "b", m(fingerprint="p")),
        ("f", None, "b", m(fingerprint="p", ingest_batch="b3")),
        ("g", "ab", "b", m(ingest_batch="b1")),
        ("h", "ab", "b", m()),  # no substrings of three characters
        ("b", "some front text", "b", m()),
        ("i", "z" * 50000, "b", m(ingest_batch="b0")),
        ("j", "z" * 50000, "b", m()),
    ]
    assert pairs(linkage.repeated_cards(cards(spark, rows))) == {("b",), ("f",), ("j",)} == brute(rows)
    assert pairs(linkage.repeated_cards(cards(spark, []))) == set()


def test_hot_front(spark):
    rows = [(f"{i:04}", "one and the same front", "b", {"ingest_batch": f"b{i % 7}", "front_normalized": "one and the same front"}) for i in range(1500)]
    assert len(pairs(linkage.repeated_cards(cards(spark, rows)))) == sum(i % 7 > 0 for i in range(1500))


def test_weights_tell_matches_apart_and_keep_the_rule():
    counts = {(3, 1, 1, 1): 500, (2, 1, 1, 0): 120, (2, 0, 1, 1): 30, (0, 0, 0, 0): 900, (0, 1, 0, 1): 60, (1, 1, 1, 1): 40}
    raw = linkage.learn_weights(counts)
    assert raw[0][3] > 0 > raw[0][0] and raw[1][1] > raw[1][0] and raw[2][1] > raw[2][0]
    for given in (counts, {}, {(0, 0, 0, 0): 3}, {(3, 0, 0, 0): 1, (0, 1, 1, 1): 100}):
        weights, cutoff = linkage.calibrated(linkage.learn_weights(given))
        for p in itertools.product(*map(range, linkage.FIELDS.values())):
            assert (sum(w[v] for w, v in zip(weights, p, strict=True)) >= cutoff) == (p[0] >= 2)


def test_front_clusters(spark):
    one = "some front text one"
    rows = [("a", one, "b"), ("b", one + "!", "b", {"ingest_batch": "b2"}), ("c", "other words altogether", "b"), ("d", one, "b", {"ingest_batch": "b2"}), ("e", one, "b")]
    got = {r.front: (r.cluster_front, r.n_cards) for r in linkage.front_clusters(cards(spark, rows)).collect()}
    assert got == {one: (one, 3), one + "!": (one, 1), "other words altogether": ("other words altogether", 1)}


def test_an_epoch_gives_its_disk_back_step_by_step(spark, monkeypatch):
    """Before texts are joined to the candidates, sketches, probes and all shuffle files up to then are gone; at the end all are."""
    rows = fixture(5, 120)
    df = linkage._batched(cards(spark, rows)).coalesce(2).cache()
    df.count()
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    files = lambda: {f.name for d in dirs for f in Path(d.getPath()).rglob("shuffle_*")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    earlier, given, compare, seen = files(), spark.conf.get(setting), shingles.compare, []
    history = linkage.History(spark, storage.Scratch(spark, "t").path("h"))

    def left():
        for _ in range(30):  # removal isn't waited for
            if not files() - earlier:
                break
            time.sleep(0.1)
        return files() - earlier

    def watched(*args, **named):
        epoch = history.state["epoch"] + 1
        held = [n for n in ("signed", "probed", "hot", "pairs") if storage.exists(spark, history.work.path(f"{n}-{epoch}"))]
        seen.append((held, left()))
        return compare(*args, **named)

    monkeypatch.setattr(shingles, "compare", watched)
    got = pairs(history.process(df.filter("batch < 'b5'"))) | pairs(history.process(df.filter("batch >= 'b5'")))
    assert seen == [(["pairs"], set())] * 2
    assert got == brute(rows)
    earlier = files()
    history.process(df.filter("batch >= 'b5'"))
    assert not left() and spark.conf.get(setting) == given
