import random

from cardmill.llm import packing


def check(rows, sizes, capacity):
    """Every item once and whole (or cut at the capacity), no container overfull."""
    room, pieces = {}, {}
    for r in rows:
        room[r.container] = room.get(r.container, 0) + r.tokens
        pieces.setdefault(r.doc_id, []).append((r.token_start, r.tokens))
    assert max(room.values(), default=0) <= capacity
    for doc, n in sizes.items():
        if n == 0:
            assert doc not in pieces
            continue
        at = 0
        for start, size in sorted(pieces[doc]):
            assert start == at
            at += size
        assert at == n and (n > capacity or len(pieces[doc]) == 1)
    assert set(pieces) == {d for d, n in sizes.items() if n}
    return len(room)


def test_whole_and_tight(spark):
    rng = random.Random(4)
    sizes = {i: rng.choice([0, 1, 5, rng.randrange(1, 300), rng.randrange(200, 2500)]) for i in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n bigint")
    placed = packing.pack(df, [("a", 256), ("b", 1024)], tokens_per_run=400_000)
    rows = placed.collect()
    for name, capacity in (("a", 256), ("b", 1024)):
        n = check([r for r in rows if r.target_name == name], sizes, capacity)
        assert n <= 1.06 * sum(sizes.values()) / capacity + 2


def test_same_on_any_partitioning(spark):
    df = spark.createDataFrame([(i, i % 97 + 1) for i in range(800)], "doc_id bigint, n bigint")
    one = {tuple(r) for r in packing.pack(df, [("a", 128)], tokens_per_run=9000).collect()}
    two = {tuple(r) for r in packing.pack(df.repartition(7), [("a", 128)], tokens_per_run=9000).collect()}
    assert one == two


def test_best_fit_and_closing():
    bins = packing.OpenBins(10, 2)
    assert list(bins.add(("a",), 6)) == [] and list(bins.add(("b",), 7)) == []
    assert list(bins.add(("c",), 3)) == [[("b",), ("c",)]]  # the least room that takes it, and full
    assert list(bins.add(("d",), 9)) == [] and list(bins.add(("e",), 8)) == [[("d",)]]  # the fullest closes
    assert sorted(map(len, bins.rest())) == [1, 1]


def test_space_is_bounded_and_nothing_is_packed_twice(monkeypatch, spark):
    rng = random.Random(9)
    bins, closed = packing.OpenBins(100, 8), 0
    for i in range(2000):
        closed += len(list(bins.add((i,), rng.randrange(1, 101))))
        assert bins.open <= 8 and bins.open == sum(map(len, bins.by_room.values())) and bin(bins.bits).count("1") == len(bins.by_room)
    assert closed + len(list(bins.rest())) <= 2000
    sizes = {i: rng.randrange(1, 100) for i in range(2000)}
    rows = packing.pack(spark.createDataFrame(list(sizes.items()), "doc_id bigint, n bigint"), [("a", 100)], slots=8, tokens_per_run=20_000).collect()
    # replayed without the engine: the same containers
    from pyspark.sql import functions as F

    order = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n bigint").withColumn("at", F.xxhash64("doc_id")).orderBy("at").collect()
    runs = -(-sum(sizes.values()) // 20_000)
    want = set()
    for run in range(runs):
        bins = packing.OpenBins(100, 8)
        done = [c for r in order if r.at % runs == run for c in bins.add((r.doc_id,), r.n)] + list(bins.rest())
        want |= {frozenset(d for (d,) in c) for c in done}
    got = {}
    for r in rows:
        got.setdefault(r.container, set()).add(r.doc_id)
    assert {frozenset(x) for x in got.values()} == want


def test_texts_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "word " * 700), (2, None), (3, ""), (4, "short"), (4, "short")], "doc_id bigint, text string").selectExpr("*", "'x' AS task", "1 AS n")
    targets = spark.createDataFrame([("s", 256), ("s", 256), ("zero", 0)], "target_name string, capacity_tokens int")
    rows = packing.pack_texts(docs, targets).collect()
    assert {r.target_name for r in rows} == {"s"} and sum(r.doc_id == 4 for r in rows) == 2 and not [r for r in rows if r.doc_id in (2, 3)]
    assert packing.pack_texts(docs.limit(0), targets).count() == 0
    assert packing.fill(packing.pack_texts(docs, targets), targets).first().containers == 3
