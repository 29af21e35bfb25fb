import random

from cardmill import storage
from cardmill.llm import subjects
from tests.llm.helpers import cards, pairs

TERMS = {"law": ["court order", "notary deed", "lease clause"], "sport": ["goal keeper", "penalty kick", "relay baton"], "music": ["flute solo", "minor scale", "organ pedal"]}
FORMS = {"law": "The judge reviewed the {} before the ruling.", "sport": "Players rehearse the {} every week.", "music": "The orchestra tunes before the {}."}


def fixture(rng, n):
    rows, truth = [], {}
    for i in range(n):
        own = rng.sample(sorted(TERMS), 1 if rng.random() < 0.85 else 2) if rng.random() < 0.9 else []
        other = rng.choice([s for s in TERMS if s not in own])
        front = f"What is the {rng.choice(TERMS[own[0]])} in Abc{i}?" if own else f"Placeholder number {i}"
        back = " ".join(FORMS[s].format(rng.choice(TERMS[s])) for s in own) or "Nothing to learn here today."
        if rng.random() < 0.4:
            back += f" As a picture, imagine a {rng.choice(TERMS[other])} and forget the rest."
        tag = f"topic::{rng.choice(own or [other])}" if rng.random() < 0.6 else f"topic::{other}"
        rows.append((f"{i:05}", front, back, {"tags_resolved": tag}))
        truth[f"{i:05}"] = own
    return rows, truth


def tables(spark, truth, ids):
    areas = spark.createDataFrame([(s, "d") for s in TERMS], "subject string, description string")
    labels = [(i, s) for i in ids for s in (truth[i] or [None])]
    return areas, spark.createDataFrame(labels, "id string, subject string").selectExpr("*", "'x' AS tags")


def test_held_out_cards(spark):
    rows, truth = fixture(random.Random(9), 900)
    areas, labels = tables(spark, truth, [r[0] for r in rows[:300]])
    got = pairs(subjects.card_subjects(cards(spark, rows), areas, labels))
    held = {r[0] for r in rows[300:]}
    a, b = {x for x in got if x[0] in held}, {(i, s) for i in held for s in truth[i]}
    assert 2 * len(a & b) / (len(a) + len(b)) > 0.97


def test_nulls_repeats_empty(spark):
    rows, truth = fixture(random.Random(10), 200)
    more = [("n1", None, None), ("n2", "", "​"), (rows[0][0], *rows[0][1:]), (None, "f", "b"), ("n3", "The judge reviewed the court order. " * 4000, None, {"tags_resolved": None})]
    areas, labels = tables(spark, truth, list(truth)[:120])
    got = pairs(subjects.card_subjects(cards(spark, rows + more), areas, labels))
    assert ("n3", "law") in got and not {x for x in got if x[0] in ("n1", "n2", None)}
    assert subjects.card_subjects(cards(spark, []), areas, labels).count() == 0
    assert subjects.card_subjects(cards(spark, rows), areas, labels.limit(0)).count() == 0
    assert subjects.card_subjects(cards(spark, rows), areas.limit(0), labels).count() == 0


def test_posteriors_are_calibrated(spark):
    rows, truth = fixture(random.Random(11), 600)
    areas, labels = tables(spark, truth, list(truth)[:300])
    model, reduced = subjects.train(cards(spark, rows), areas, labels, storage.Scratch(spark, "t"))
    held = [r for r in reduced.collect() if r.id not in list(truth)[:300]]
    p = subjects.posteriors(model, subjects._card_evidence(model, held))
    y = [[s in truth[r.id] for s in model.subjects] for r in held]
    assert abs(p.mean() - sum(map(sum, y)) / p.size) < 0.05


def test_sentences():
    assert subjects.plain_sentences("Unidad: tеst <b>ok</b>. Otra línea; fin") == [["unidad", "test", "ok"], ["otra", "linea"], ["fin"]]
    assert subjects.plain_sentences(None) == [] and subjects.plain_sentences("12 34!") == []
