import os
import random

import pytest

from cardmill.llm import encode

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

TEXTS = [
    "", " ", "a", "Hello world, it's 2024!", "naïve façade — ½ m²", "学習カードの復習 🎓📚 ​", "tab\tand\n\n\nlines  ", "<|endoftext|> is text", "x" * 3000, "0123456789" * 200, "  　 ", "áé", "for i in range(10): print(i)", "it's we'll they've I'd",
    "mixed   spaces     here", "\x00\x01\x7f", "é" * 50, "aaab" * 40,
]


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    import base64

    enc = encode.encoder(request.param)
    with open(public.path(request.param), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return enc, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_and_round_trip(both):
    enc, other = both
    rng = random.Random(1)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 900), 32, 10])) for _ in range(rng.randrange(80))) for _ in range(300)]
    for t in texts:
        ids = enc.encode(t)
        assert ids == other.encode_ordinary(t)
        assert b"".join(enc.tokens[i] for i in ids).decode() == t
        assert enc.count(t) == len(ids)
    assert enc.encode(None) == []


def test_append_is_exact(both):
    enc, _ = both
    for t in TEXTS:
        table = encode.PrefixTable(enc)
        data = t.encode()
        for i in range(0, min(len(data), 200), 3):
            table.extend(data[i : min(i + 3, 200)])
        assert table.ids() == encode.PrefixTable(enc, data[:200]).ids()


def test_edits_are_exact_and_local(both):
    enc, other = both
    rng = random.Random(2)
    base = " ".join(TEXTS[3:7]) * 4
    held = encode.EncodedText(enc, base)
    for _ in range(150):
        a = rng.randrange(len(held.text) + 1)
        b = min(len(held.text), a + rng.randrange(6))
        held.replace(a, b, rng.choice(["", " ", "\n", "word", " two words", "é", "  ", "'s", "9"]))
        assert held.ids == other.encode_ordinary(held.text)
    long = encode.EncodedText(enc, "plain words " * 3000)
    assert long.replace(18000, 18003, "xyz") < 8
    assert long.append(" and more") <= 4
    assert long.ids == other.encode_ordinary(long.text)


def test_edits_among_white_space_digits_and_apostrophes(both):
    enc, other = both
    rng = random.Random(11)
    letters = [" ", " ", "\n", "\n", "\t", "\u00a0", "1", "22", ".", "'", "'s", "r", "e", "l", "v", "a", "é", "I"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randrange(0, 14)))
        held = encode.EncodedText(enc, text)
        for _ in range(2):
            a = rng.randrange(len(held.text) + 1)
            b = min(len(held.text), a + rng.randrange(4))
            new = "".join(rng.choices(letters, k=rng.randrange(0, 3)))
            before = held.text
            held.replace(a, b, new)
            assert held.text == before[:a] + new + before[b:]
            assert held.ids == other.encode_ordinary(held.text), (before, a, b, new)
            assert held.starts == encode.EncodedText(enc, held.text).starts


def test_stores_are_bounded(both, monkeypatch):
    enc, other = both
    monkeypatch.setattr(enc, "_store", {})
    monkeypatch.setattr(enc, "_pairs", {})
    monkeypatch.setattr(encode, "STORE", 5)
    monkeypatch.setattr(encode, "PAIRS", 20)
    for t in TEXTS:
        assert enc.encode(t) == other.encode_ordinary(t)
        assert len(enc._store) <= 5 and len(enc._pairs) <= 20


def test_corpus(spark):
    rows = [(1, "Hello", "a"), (2, "", "b"), (3, None, "c"), (1, "Hello", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode.encode_texts(df).collect())
    assert got == [(1, [15496]), (1, [15496]), (2, []), (3, [])]
    assert encode.encode_texts(df.limit(0)).count() == 0
    assert sorted((r.doc_id, r.n) for r in encode.count_tokens(df).collect()) == [(1, 1), (1, 1), (2, 0), (3, 0)]


def test_vocabulary_by_path():
    assert encode.vocabulary_path("/x/y") == "/x/y" and os.path.exists(encode.vocabulary_path("byte_bpe_50k.tiktoken"))
