import random

import numpy as np

from cardmill.llm import reading

FORMS = {
    1: ["Look at the dog.", "I see a cat.", "We go on.", "She has a red bag."],
    2: ["A simple way to remember the lesson is to write it down many times.", "After the break, each group draws the picture and explains it to the others."],
    3: ["Although the subject is introduced early in the course, its relation to the other chapters becomes clear only when several worked examples have been compared in detail.", "Several explanations have been proposed for the phenomenon, of which the most convincing assumes that the process develops gradually rather than all at once."],
    4: ["Notwithstanding the apparent commensurability of the phenomenon, its systematic characterisation presupposes a dichotomization whose methodological ramifications, insofar as they bear upon the constitutive indeterminacy, remain insufficiently theorised within the prevailing interpretive literature."],
}


def text(rng, level):
    own = [rng.choice(FORMS[level]) for _ in range(rng.randrange(4, 12))]
    if rng.random() < 0.4:
        own.insert(rng.randrange(len(own)), rng.choice(FORMS[rng.choice([x for x in FORMS if abs(x - level) == 1])]))
    return ("# Title here\n\n" if rng.random() < 0.3 else "") + " ".join(own) + ("\nfor i in range(9): print(i)" if rng.random() < 0.2 else "")


def tables(spark, rng, n, labelled):
    rows = [(i, text(rng, 1 + i % 4), rng.choice(["a", "b", "c", None])) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'x' AS m", "1 AS level")
    return docs, spark.createDataFrame([(i, 1 + i % 4) for i in range(labelled)], "doc_id bigint, reading_level int")


def test_held_out_levels(spark):
    docs, labels = tables(spark, random.Random(12), 800, 240)
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(docs, labels).collect()}
    assert np.mean([got[i] == 1 + i % 4 for i in range(240, 800)]) > 0.97
    row = reading.held_out_accuracy(docs, labels).first()
    assert row.labelled == 240 and row.held_out > 0.95


def test_what_is_no_prose(spark):
    rows = [
        (1, None), (2, ""), (3, " 　​"), (4, "GET https://a.b.invalid/v1/decks\nexport A=/srv/1"), (5, "one\ttwo\tthree\nfour\tfive"), (6, "🎓📚 repaso"), (7, "x" * 5000), (8, "# Only a heading"),
        (9, "Look at the dog. I see a cat. We go on."), (10, "<p>Look at the dog.</p>\n<p>I see a cat.</p>"), (9, "Look at the dog. I see a cat. We go on."), (11, "Look at the dog. " * 5000),
    ]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string")
    more, labels = tables(spark, random.Random(13), 80, 80)
    docs = docs.unionByName(more.select("doc_id", "text", "source").withColumn("doc_id", more.doc_id + 1000))
    labels = labels.withColumn("doc_id", labels.doc_id + 1000)
    got = sorted((r.doc_id, r.reading_level) for r in reading.reading_levels(docs, labels).collect() if r.doc_id < 1000)
    assert got == [(9, 1), (9, 1), (10, 1), (11, 1)]
    assert reading.reading_levels(docs, labels.limit(0)).count() == 0
    assert reading.reading_levels(docs.limit(0), labels).count() == 0


def test_trees_fit_a_step_and_are_flat():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = np.where(x[:, 1] > 0.5, 3.0, 1.0)
    t = reading.boost(x, y)
    assert np.abs(t.predict(x) - y).mean() < 0.05
    assert (reading.boost(x[:1], y[:1]).predict(x) == y[0]).all()


def test_folds_share_no_source():
    x, y = np.arange(40.0)[:, None], np.arange(40) % 4 + 1.0
    group = np.array([f"s{i % 4}" for i in range(40)])  # the source gives the level away
    held = reading.cross_validated(x, y, group)
    assert np.abs(held - y).mean() > 0.5


def test_few_labels():
    assert reading.fit(np.ones((1, reading.WIDTH)), np.array([2.0]), np.array(["a"])).grade(np.ones((2, reading.WIDTH))).tolist() == [2, 2]


def test_variety_over_all_windows():
    import random

    rng = random.Random(3)
    words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 9) for _ in range(1500)]
    want = sum(len(set(words[i : i + 400])) / 400 for i in range(1101)) / 1101
    assert abs(reading.variety(words) - want) < 1e-12
    assert reading.variety(["a", "b", "a"]) == 2 / 3 and reading.variety([]) == 0
    assert reading.variety(["a"] * 400 + list(map(str, range(4000)))) > 0.9  # an opening doesn't decide
