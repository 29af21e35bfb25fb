from cardmill import storage
from cardmill.llm import ledger
from tests.llm.helpers import cards, pairs


def found(spark, rows):
    return pairs(ledger.copies_found(cards(spark, rows)))


def test_formats_lists_and_swaps(spark):
    rows = [
        ("a", "What is X?", "An answer."),
        ("b", "WHAT IS x", "an - answer"),  # case, punctuation
        ("c", "An answer", "What​ is X"),  # sides exchanged, zero-width space
        ("d", "What is Y?", "An answer."),  # another letter
        ("e", "Case: A B; Theme: t; Unit: 1", "z"),
        ("f", "unit = 1\ntheme - t\nCASE: a b", "Z!"),  # other order of entries
        ("g", "Theme: a b; Case: t; Unit: 1", "z"),  # other content
        ("h", "What is х?", "An answer."),  # Cyrillic: another character
    ]
    assert found(spark, rows) == {("a", "b"), ("a", "c"), ("e", "f")}


def test_what_is_dropped_does_not_count_within_labels(spark):
    rows = [
        ("a", "Case: A B; Theme: the me; Unit: 1", "z"),
        ("b", "Cas:e A B; The me -- the me; Uni:t 1", "z"),  # the same letters
        ("c", "Unit: 1; Case: A B; Theme: the me", "z"),  # other order
        ("d", "Case: A B; Theme: the me; Unit: 12", "z"),
        ("e", "Caseload A B; Theme: x", "z"),  # no list
        ("f", "Theme: x. Caseload A B", "z"),
    ]
    assert found(spark, rows) == {("a", "b"), ("a", "c")}


def test_nulls_repeats_and_empty(spark):
    rows = [("a", None, "x y"), ("b", "xy", None), ("a", None, "x y"), (None, "x", "y"), ("c", None, None), ("d", "?!", ""), ("e", "long " * 20000, "q"), ("f", "LONG " * 20000, "q", {"ingest_batch": None})]
    assert found(spark, rows) == {("a", "b"), ("c", "d"), ("e", "f")}
    assert found(spark, []) == set()


def test_ledger_adds_batches(spark):
    scratch = storage.Scratch(spark, "test")
    book = ledger.CopyLedger(spark, scratch.path("ledger"), bucket_keys=16)
    first = [(f"{i:03}", f"front {i % 40}", "b", {"created_at": f"2024-01-{i % 28 + 1:02}"}) for i in range(100)]
    second = [(f"{i:03}", f"front {i % 50}", "b", {"created_at": "2023-12-31"}) for i in range(100, 130)]
    for name, part in (("one", first), ("two", second), ("one", first)):  # the first comes again
        assert book.fold(ledger.keyed_cards(cards(spark, part)), name) == (part is second or not book.manifest()["version"] > 1)
    assert book.manifest()["number"] == 8 and book.manifest()["folded"] == ["one", "two"]
    whole = {}
    for i, front, _, more in first + second:
        whole.setdefault(front, []).append((more["created_at"], i))
    want = {(len(v), min(v)[1], min(i for _, i in v)) for v in whole.values()}
    got = [(r.n, r.first_id, r.keep_id) for r in book.read().collect()]
    assert sorted(got) == sorted((len(v), min(v)[1], min(i for _, i in v)) for v in whole.values()) and set(got) == want


def test_untouched_buckets_stay_and_replaced_versions_go(spark):
    path = storage.Scratch(spark, "test").path("ledger")
    book = ledger.CopyLedger(spark, path, bucket_keys=8)
    book.fold(ledger.keyed_cards(cards(spark, [(str(i), f"f{i}", "b") for i in range(300)])), "a")
    before = book.manifest()["buckets"]
    ledger.CopyLedger(spark, path, bucket_keys=8).fold(ledger.keyed_cards(cards(spark, [("x", "f1", "b")])), "b")  # by another object
    after = book.manifest()["buckets"]
    (changed,) = [b for b in before if before[b] != after[b]]
    assert len(before) > 30 and not storage.exists(spark, f"{path}/v=1/bucket={changed}") and storage.exists(spark, f"{path}/v=2/bucket={changed}")
    assert book.read().filter("n = 2").count() == 1 and book.read().count() == 300


def test_hot_key(spark):
    rows = [(f"{i:05}", "Same!", "card") for i in range(3000)] + [(f"x{i}", f"other {i}", "card") for i in range(3000)]
    got = found(spark, rows)
    assert len(got) == 2999 and all(a == "00000" for a, _ in got)
