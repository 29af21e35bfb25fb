import random

import numpy as np
import pytest

from cardmill.llm import neardup, shingles
from tests.llm.helpers import notes, pairs

WORDS = "the load balancer keeps open sessions when a replica server restarts and every request waits for its cache layer until nine nodes agree".split()


def tri(s):
    return {s[i : i + 3] for i in range(len(s) - 2)}


def edited(rng, text):
    c = list(text)
    for _ in range(rng.randrange(1, 6)):
        k = rng.randrange(len(c))
        c[k : k + rng.randrange(2)] = rng.choice(["", "x", "qu", " "])
    return "".join(c)


def fixture(rng, n):
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            _, f, b = rng.choice(rows)
            f, b = (edited(rng, f), b) if rng.random() < 0.5 else (f, edited(rng, b))
        else:
            f, b = (" ".join(rng.choices(WORDS, k=k)) + f" {rng.randrange(10**6)}" for k in (7, 14))
        rows.append((1000 + i, f, b))
    return rows


def brute(rows):
    out, sets = set(), [(i, tri(f + " " + b)) for i, f, b in rows if f and b]
    texts = {i: f + " " + b for i, f, b in rows if f and b}
    for x, (i, s) in enumerate(sets):
        for j, t in sets[x + 1 :]:
            u = len(s | t)
            if (u and 5 * len(s & t) >= 4 * u) or texts[i] == texts[j]:
                out.add((min(i, j), max(i, j)))
    return out


def test_against_all_pairs(spark):
    rows = fixture(random.Random(5), 400)
    assert pairs(neardup.near_pairs(notes(spark, rows))) == brute(rows)


def test_groups(spark):
    rows = fixture(random.Random(6), 150) + [(9000 + i, "same front", "same back") for i in range(5)]
    got = {r.note_id: r.group_id for r in neardup.near_groups(notes(spark, rows)).collect()}
    parent = {i: i for i, *_ in rows}
    for _ in range(len(rows)):
        for a, b in brute(rows):
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_nulls_repeats_short_long(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "x", ""), (4, "abc", "def"), (5, "abc", "def"), (4, "abc", "def"), (6, "k" * 60000, "m"), (7, "k" * 60001, "m"), (8, "a", "b"), (9, "a", "b"), (None, "abc", "def")]
    later = [(4, "abc", "other text", {"indexed_at": "2023-01-01"})]  # an older row of a note doesn't count
    assert pairs(neardup.near_pairs(notes(spark, rows + later))) == {(4, 5), (6, 7), (8, 9)}
    assert pairs(neardup.near_pairs(notes(spark, []))) == set()
    assert neardup.near_groups(notes(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [10, 20_000])
def test_large_blocks_are_cut_without_loss(spark, monkeypatch, limit):
    monkeypatch.setattr(shingles, "BLOCK_ROWS", limit)
    rng = random.Random(7)
    base = " ".join(rng.choices(WORDS, k=40))
    rows = [(i, base, edited(rng, "some back text that is the same for all of them")) for i in range(120)]
    assert pairs(neardup.near_pairs(notes(spark, rows))) == brute(rows)


def test_blocks_in_tiles():
    """Blocks of every size, compared in tiles of sketches of different widths, give what all their pairs give."""
    rng = np.random.default_rng(1)
    lengths = [1, 2, 1, 3, 4, 7, 40, 65, 64, 1, 700, 2, 1]
    key = np.repeat(np.arange(len(lengths)), lengths)
    sets = [np.unique(rng.integers(0, 1 << 60, int(rng.integers(1, 500)))) for _ in range(40)]
    mine = []
    for _ in key:
        s = sets[rng.integers(len(sets))]
        mine.append(np.unique(np.r_[s[rng.random(len(s)) < 0.97], rng.integers(0, 1 << 60, int(rng.integers(1, 4)))]))
    n = np.array([len(s) for s in mine], np.int32)
    order = np.lexsort((n, key))
    key, n, mine = key[order], n[order], [mine[i] for i in order]
    raw = shingles.sketches(mine)
    words, flat = np.array([len(x) // 8 for x in raw]), np.frombuffer(b"".join(raw), np.uint64)
    assert len(set(words.tolist())) > 3
    part = np.zeros(len(key), np.int8)
    part[key == 6] = np.arange(40) % 2 + 1
    found = [(int(a), int(b)) for i, j in shingles.block_pairs(key, part, n, words, flat) for a, b in zip(i, j, strict=True)]
    assert len(found) == len(set(found))
    must, may = set(), set()
    for i in range(len(key)):
        for j in range(i + 1, len(key)):
            if key[i] == key[j] and (part[i] != part[j] or part[i] == 0):
                shared = len(np.intersect1d(mine[i], mine[j]))
                if 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]):
                    may.add((i, j))
                if 5 * shared >= 4 * (n[i] + n[j] - shared):
                    must.add((i, j))
    assert must <= set(found) <= may and len(must) > 1000 and len(found) < 1.1 * len(must) + 200


def test_tiles_beyond_the_radius_are_skipped():
    n = np.sort(np.random.default_rng(2).integers(10, 1000, 640))
    first = np.arange(0, 640, 64)
    met = [(a, b) for i, j in shingles._tile_pairs(first, first + 64, np.zeros(10, int), n) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    near = {(a, b) for a in range(10) for b in range(a, 10) if 4 * n[64 * b] <= 5 * n[64 * a + 63]}
    assert set(met) == near and len(met) == len(near) < 55


def test_sketches_never_exceed_the_sets_difference():
    rng = random.Random(8)
    for _ in range(200):
        a = " ".join(rng.choices(WORDS, k=rng.choice([2, 8, 30, 200])))
        b = edited(rng, a) + "z" * rng.choice([0, 1, 60])
        s, t = shingles.trigrams(a), shingles.trigrams(b)
        assert len(s) == len(tri(a))
        raw = shingles.sketches([s, t])
        words, flat = np.array([len(x) // 8 for x in raw]), np.frombuffer(b"".join(raw), np.uint64)
        held = shingles.Sketches(words, flat).at[int(words.min())]
        assert sum(int(np.bitwise_count(x ^ y)) for x, y in zip(held[0], held[1], strict=True)) <= len(np.setxor1d(s, t))
