import json

import numpy as np
import pytest

from cardmill import storage
from cardmill.llm import vectors
from cardmill.llm.hnsw import Hnsw
from tests.llm.helpers import notes, pairs


def planted(rng, n, dim=64):
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 2):
        j = rng.integers(0, n)
        x[i] = x[j] / np.linalg.norm(x[j]) + rng.uniform(0.05, 0.6) * rng.normal(size=dim) / 8
    return x


def brute(ids, x, k=5, least=0.9):
    """Ties by the smaller id."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (x.astype(np.float32).astype(float)) @ x.astype(np.float32).astype(float).T
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 6), ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if s[i, j] >= least - 1e-7}
    return out


def cache(spark, rows):
    return spark.createDataFrame(rows, "fingerprint string, model string, dim int, vector array<double>, created_at string")


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = planted(rng, 3000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    graph = Hnsw(x, 12, 24)
    ids, sims = graph.neighbours(5)
    near = [(i, j) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9]
    assert np.mean([j in ids[i] for i, j in near]) > 0.99
    assert np.all(np.diff(sims, axis=1) <= 0) and not (ids == np.arange(len(x))[:, None]).any()
    found, _ = graph.search(x[:200], 1)
    assert np.mean(found[:, 0] == np.arange(200)) > 0.95
    assert all(layer.links.shape[1] == d for layer, d in zip(graph.layers, [24, 12, 12, 12, 12, 12, 12], strict=False)) and len(graph.layers) >= 2
    again = Hnsw(x, 12, 24)
    assert all((a.links == b.links).all() for a, b in zip(graph.layers, again.layers, strict=True))


def test_tiny_graphs():
    for n in (0, 1, 2, 5):
        g = Hnsw(np.eye(max(n, 1), 8)[:n])
        ids, _ = g.neighbours(3)
        assert ids.shape == (n, 3) and ((ids >= 0).sum(1) == min(3, max(n - 1, 0))).all()


def test_exact_on_small_tables(spark):
    rng = np.random.default_rng(2)
    x = planted(rng, 300)
    x[10] = x[11] = x[12]  # the same vector
    ids = rng.permutation(5000)[:300].tolist()
    df = notes(spark, [(i, "f", "b", {"embedding_vector": json.dumps(v.tolist())}) for i, v in zip(ids, x, strict=True)])
    assert pairs(vectors.similar_notes(df, cache(spark, []))) == brute(ids, x)


def test_hot_vector_costs_k_pairs_a_note(spark):
    v, w = json.dumps([1.0] * 64), json.dumps([1.0] * 63 + [0.9])
    df = notes(spark, [(i, "f", "b", {"embedding_vector": v}) for i in range(400)] + [(1000, "f", "b", {"embedding_vector": w})])
    got = pairs(vectors.similar_notes(df, cache(spark, [])))
    want = {(min(i, j), max(i, j)) for i in range(400) for j in [x for x in range(6) if x != i][:5]} | {(i, 1000) for i in range(5)}
    assert got == want


def test_usable_vectors(spark):
    good, two = [0.5] * 64, [0.25] * 63 + [0.26]
    rows = [
        (1, "f", "b", {"embedding_vector": json.dumps(good)}),
        (2, "f", "b", {"embedding_vector": "[1, 2", "fingerprint": "p"}),  # broken: from the cache
        (3, "f", "b", {"embedding_vector": None, "fingerprint": "p"}),
        (4, "f", "b", {"embedding_vector": json.dumps([0.0] * 64), "fingerprint": "p"}),  # all zero: left out
        (5, "f", "b", {"embedding_vector": json.dumps(good[:32]), "fingerprint": "q"}),  # other length, cached null
        (6, "f", "b", {"embedding_vector": "NaN", "fingerprint": "r"}),  # cached for another model
        (7, "f", "b", {"embedding_vector": "[" + ", ".join(["NaN"] * 64) + "]"}),
        (8, "f", "b", {"embedding_vector": json.dumps([True] * 64)}),
        (1, "f", "b", {"embedding_vector": json.dumps(good), "indexed_at": "2025-01-01"}),
        (None, "f", "b", {"embedding_vector": json.dumps(good)}),
    ]
    held = [("p", vectors.MODEL, 64, two, "1"), ("p", vectors.MODEL, 64, two, "2"), ("q", vectors.MODEL, 64, None, "1"), ("r", "old", 64, good, "1"), ("s", vectors.MODEL, 64, [0.0] * 64, "1")]
    got = {r.note_id: r.u for r in vectors.note_vectors(notes(spark, rows), cache(spark, held)).collect()}
    assert set(got) == {1, 2, 3} and got[2] == got[3]
    assert pairs(vectors.similar_notes(notes(spark, rows), cache(spark, held))) == {(1, 2), (1, 3), (2, 3)}
    assert pairs(vectors.similar_notes(notes(spark, []), cache(spark, []))) == set()


@pytest.mark.parametrize("shard_rows", [150, 400])
def test_shards_and_cut_shards(spark, shard_rows):
    rng = np.random.default_rng(3)
    x = planted(rng, 1200)
    x[:500] = x[0] + 0.02 * rng.normal(size=(500, 64))  # one dense region: its shard is cut into parts
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.astype(np.float32).tobytes()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vid bigint, u binary")
    got = {}
    for r in vectors.nearest(df, storage.Scratch(spark, "t"), shard_rows=shard_rows).collect():
        got.setdefault(r.vid, {})[r.other] = r.sim
    s = x @ x.T
    np.fill_diagonal(s, -1)
    hit = total = 0
    for i in range(len(x)):
        for j in np.argsort(-s[i])[:5]:
            if s[i, j] >= 0.9:
                total += 1
                hit += j in got.get(i, {})
    assert hit / total > 0.9 and all(len(v) <= 5 for v in got.values())
