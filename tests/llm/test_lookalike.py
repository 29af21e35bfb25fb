from cardmill.llm import lookalike
from tests.llm.helpers import cards, pairs


def found(spark, rows):
    return pairs(lookalike.alike_pairs(cards(spark, rows)))


def test_forms(spark):
    rows = [
        ("a", "café uno", "back-end"),
        ("b", "café uno", "back-end"),  # separate accent
        ("c", "café unо", "back‐end"),  # space, Cyrillic o, hyphen
        ("d", "ｃａｆé uno", "back-end"),  # full width
        ("e", "caf​é uno", "back-end"),  # zero width
        ("f", "cafe uno", "back-end"),  # missing accent: visible
        ("g", "Café uno", "back-end"),  # case: visible
        ("h", " café \t uno\n", "back-end"),  # plain spaces: no difference at all from a
        ("i", "café uno", "back end"),  # other punctuation
    ]
    want = {tuple(sorted((x, y))) for x in "abcdeh" for y in "abcdeh" if x < y} - {("a", "h")}
    assert found(spark, rows) == want


def test_nulls_repeats_empty(spark):
    rows = [("a", None, "x"), ("b", "", "x"), ("c", "​", "x"), ("a", None, "x"), (None, "​", "x"), ("d", "o" * 100000, "y"), ("e", "о" + "o" * 99999, "y")]
    assert found(spark, rows) == {("a", "c"), ("b", "c"), ("d", "e")}
    assert found(spark, []) == set()


def test_canonical_is_one_per_class(spark):
    rows = [("a", "one", "x"), ("b", "оne", "x"), ("c", "one", "x"), ("d", "two", "x")]
    got = dict(pairs(lookalike.canonical_cards(cards(spark, rows))))
    assert got["a"] == got["b"] == got["c"] and got["d"] == "d"


def test_collation_is_accent_and_case_sensitive(spark):
    row = spark.sql("SELECT 'é' COLLATE UNICODE = 'é' COLLATE UNICODE a, 'e' COLLATE UNICODE = 'é' COLLATE UNICODE b, 'E' COLLATE UNICODE = 'e' COLLATE UNICODE c").first()
    assert tuple(row) == (True, False, False)


def test_hot_variant(spark):
    rows = [(f"{i:05}", "same", "card") for i in range(2000)] + [("z", "sаme", "card")]
    assert len(found(spark, rows)) == 2000
