import random

import pytest

from cardmill import storage
from cardmill.llm import components
from tests.llm.helpers import pairs


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b and a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {(x, find(x)) for x in list(parent)}


@pytest.mark.parametrize("hub", [20, storage.HUB])
def test_against_union_find(spark, hub):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]  # many components
    links += [(1000 + i, 1001 + i) for i in range(120)]  # a chain
    links += [(5000, 5001 + i) for i in range(300)]  # a star
    links += [(b, a) for a, b in links[:50]] + [(7, 7), (9999, 9999)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert pairs(components.components(df, hub=hub)) == brute(links)


def test_the_recursion_runs_to_the_end(spark, monkeypatch):
    levels = []
    whole = components.decompose
    monkeypatch.setattr(components, "decompose", lambda links, level, *a: levels.append(level) or whole(links, level, *a))
    links = [(i, i + 1) for i in range(200)]
    assert pairs(components.components(spark.createDataFrame(links, "a bigint, b bigint"))) == {(i, 0) for i in range(201)}
    assert levels == list(range(len(levels))) and len(levels) >= 3


def test_nothing(spark):
    df = spark.createDataFrame([("a", "a"), (None, "b")], "a string, b string")
    assert pairs(components.components(df)) == set()
    assert pairs(components.components(df.limit(0))) == set()


def test_linked_records(spark):
    rows = [
        ("A ", "b", 0.95, ["x"]),
        ("B", " c ", 0.90, None),
        ("b", "a", 0.99, []),  # the other order
        ("d", "e", float("nan"), []),
        ("d", "f", None, []),
        ("g", "G", 1.0, []),
        ("h", "i", 0.89999, []),
        (None, "j", 1.0, []),
        ("", "k", 1.0, []),
        ("z", "y", 0.9, []),
    ]
    df = spark.createDataFrame(rows, "left_id string, right_id string, score double, reason_codes array<string>").selectExpr("*", "'x' AS v", "'y' AS a")
    assert pairs(components.linked_records(df)) == {("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")}
    assert pairs(components.linked_records(df.limit(0))) == set()


def test_one_decomposition_contracts_connected_parts(spark):
    links = [(i, i + 1) for i in range(60)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.v: r.c for r in components.decompose(df).collect()}
    assert set(got) == set(range(61)) and len(set(got.values())) < 61
    for v, c in got.items():  # on a path a cluster is an interval around its centre
        assert all(got[x] == c for x in range(min(v, c), max(v, c) + 1)) and abs(v - c) <= 6
