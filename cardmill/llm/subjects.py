"""Subject areas of every card.

A card is read sentence by sentence. Each subject has a naive Bayes model of its sentences against their complement
(all other sentences). Labelled cards name the subjects that their sentences may teach; which of them teaches what,
and which teaches nothing (an aside, a comparison, a memory picture), is a hidden class that expectation-maximization
settles, first on the labelled cards and then with all unlabelled ones. A card's evidence for each subject becomes an
independent posterior through a logistic calibration on labelled cards; the evidence for it comes from models that lack these labels
and were refined over the unlabelled cards in the same way.

Words go to a fixed number of places by a hash, and a place is kept if a few sentences have a word of it; that bounds
the model at every size of the collection and drops no word for being a small share of it. Sentences are reduced to these places and counted once each, so that the passes over the collection work on
distinct sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill import storage
from cardmill.llm.lookalike import printed_form

#: Words share so many places; a place is kept from LEAST_COUNT sentences on.
PLACES, LEAST_COUNT = 1 << 20, 5
#: Pairs of neighbouring words share so many places.
PAIRS = 1 << 16
_TAG = re.compile(r"<[^<>]*>|&[a-zA-Z#0-9]{1,8};")
_BREAK = re.compile(r"[.!?;\n|•()\[\]\"»«“”]+|(?:^|\s)[-–—](?:\s|$)")
_WORD = re.compile(r"[^\W\d_]+")


def plain_sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, in printed form, lower case, without accents. Null gives none."""
    if not text:
        return []
    text = printed_form(_TAG.sub(" ", text).replace("\n", " \n "))
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return [w for s in _BREAK.split(text.lower()) if (w := _WORD.findall(s))]


@dataclass
class Model:
    """Counts by feature and class; the last class is "teaches nothing"."""

    subjects: list[str]
    index: np.ndarray  # the number of every place that is kept, else -1
    odds: np.ndarray | None = None  # (features, classes): log ratio of a class to its complement
    prior: np.ndarray | None = None
    bias: np.ndarray | None = None  # calibration: (subjects,)
    slope: np.ndarray | None = None  # (evidence,)
    hints: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def classes(self) -> int:
        return len(self.subjects) + 1

    @cached_property
    def kept(self) -> int:
        return int(self.index.max(initial=-1)) + 1

    @property
    def features(self) -> int:
        return self.kept + PAIRS

    def reduce(self, sentence: list[str]) -> str:
        index = self.index
        return " ".join(str(i) for w in sentence if (i := index[crc32(w.encode()) % PLACES]) >= 0)

    def places(self, key: str) -> np.ndarray:
        """Feature numbers of a reduced sentence: its words, and its neighbouring words in pairs; each once."""
        w = np.array(key.split(), np.int64)
        pairs = (w[:-1] * 1_000_003 + w[1:] * 7_919) % PAIRS + self.kept
        return np.unique(np.concatenate([w, pairs]))

    def set_counts(self, counts: np.ndarray, mass: np.ndarray, smooth: float = 0.3) -> None:
        whole = counts.sum(1, keepdims=True)
        inside, outside = counts + smooth, whole - counts + smooth
        self.odds = (np.log(inside / inside.sum(0)) - np.log(outside / outside.sum(0))).astype(np.float32)
        share = (mass + 1) / (mass.sum() + len(mass))
        self.prior = np.log(share / (1 - share)).astype(np.float32)

    def score(self, places: np.ndarray) -> np.ndarray:
        return self.prior + self.odds[places].sum(0)


def _posterior(scores: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    if allowed is not None:
        scores = np.where(allowed, scores, -np.inf)
    p = np.exp(scores - scores.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Sentences:
    """Reduced, non-empty sentences in flat arrays, cut into chunks for matrix passes of bounded size."""

    CHUNK = 10_000

    def __init__(self, model: Model, keys: list[str]):
        self.n, self.chunks = len(keys), []
        for at in range(0, len(keys), self.CHUNK):
            places = [model.places(k) for k in keys[at : at + self.CHUNK]]
            lengths = np.array([len(p) for p in places])
            flat = np.concatenate(places).astype(np.int32)
            order = np.argsort(flat, kind="stable")
            found, first = np.unique(flat[order], return_index=True)
            owner = np.repeat(np.arange(len(places), dtype=np.int32), lengths)[order]
            self.chunks.append((at, flat, np.cumsum(lengths) - lengths, owner, found, first))

    def scores(self, model: Model) -> np.ndarray:
        out = np.empty((self.n, model.classes), np.float32)
        for at, flat, starts, *_ in self.chunks:
            out[at : at + len(starts)] = np.add.reduceat(model.odds[flat], starts, axis=0)
        return out + model.prior

    def counts(self, model: Model, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((model.features, model.classes))
        for at, _, starts, owner, found, first in self.chunks:
            out[found] += np.add.reduceat(weight[at : at + len(starts)][owner], first, axis=0)
        return out


def fit_labelled(model: Model, held: Sentences, allowed: np.ndarray, weight: np.ndarray, rounds: int = 6, more: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximization over labelled sentences, each limited to ``allowed`` classes; gives their counts and mass.

    ``weight``: how often each sentence occurs, 0 for those that the model must not see; ``more``: counts and mass of
    unlabelled sentences that are added in every round.
    """
    share = allowed / allowed.sum(1, keepdims=True)
    single = allowed.sum(1) == 2  # one subject, or nothing
    share = np.where(single[:, None], np.where(np.arange(model.classes) == model.classes - 1, 0.25, 0.75) * allowed, share)
    for _ in range(rounds):
        w = share * weight[:, None]
        counts, mass = held.counts(model, w), w.sum(0)
        model.set_counts(*((counts, mass) if more is None else (counts + more[0], mass + more[1])))
        share = _posterior(held.scores(model), allowed)
    return counts, mass


def evidence(model: Model, scores: np.ndarray, front: np.ndarray, hint: np.ndarray) -> np.ndarray:
    """(subjects, evidence) of one card from the scores of its sentences: how many teach the subject, how surely, where, and its tags."""
    k = len(model.subjects)
    out = np.zeros((k, 5), np.float32)
    if len(scores):
        p = _posterior(scores)[:, :k]
        best = p.max(0)
        out[:, 0] = np.clip(np.log((best + 1e-4) / (1 - best + 1e-4)), -8, 8)
        out[:, 1] = np.minimum(p.sum(0), 3)
        out[:, 2] = p[front].max(0) if front.any() else 0
        out[:, 3] = p[~front].max(0) if (~front).any() else 0
    out[:, 4] = hint
    return out


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Logistic calibration: x (cards, subjects, evidence), y (cards, subjects); a bias per subject, common slopes."""
    n, k, e = x.shape
    design = np.concatenate([np.tile(np.eye(k), (n, 1)), x.reshape(n * k, e)], 1)
    target, beta = y.reshape(-1).astype(float), np.zeros(k + e)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (target - p) - ridge * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(k + e)
        beta = beta + np.linalg.solve(hess, grad)
    return beta[:k], beta[k:]


def posteriors(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.bias + x @ model.slope, -30, 30)))


def topics(tags: str | None) -> list[str]:
    return sorted({t for t in (tags or "").lower().split() if "::" in t})


def _hint(model: Model, tags: str | None) -> np.ndarray:
    known = [model.hints[t] for t in topics(tags) if t in model.hints]
    return np.max(known, axis=0) if known else np.full(len(model.subjects), 1 / len(model.subjects))


def _learn_hints(model: Model, rows: list, subjects_of: dict) -> None:
    seen: dict[str, np.ndarray] = {}
    k = len(model.subjects)
    for r in rows:
        mask = subjects_of[r.id]
        for t in topics(r.tags):
            c = seen.setdefault(t, np.full(k + 1, 0.5))
            c[:k] += mask
            c[k] += 1
    model.hints = {t: c[:k] / (c[k] + 4) for t, c in seen.items()}


def _card_evidence(model: Model, rows: list) -> np.ndarray:
    cache: dict[str, np.ndarray] = {}
    out = np.zeros((len(rows), len(model.subjects), 5), np.float32)
    for n, r in enumerate(rows):
        scores = []
        for key in r.sentences:
            if key not in cache:
                cache[key] = model.score(model.places(key))
            scores.append(cache[key])
        out[n] = evidence(model, np.array(scores), np.arange(len(scores)) < r.fronts, _hint(model, r.tags))
    return out


def _labelled_sentences(model: Model, rows: list, subjects_of: dict, folds: int) -> tuple[Sentences, np.ndarray, np.ndarray]:
    """Distinct (sentence, allowed classes) of labelled cards, and how often each occurs in every fold (rows by turns)."""
    seen: dict[tuple[str, bytes], int] = {}
    at, fold = [], []
    for i, r in enumerate(rows):
        mask = subjects_of[r.id].astype(bool).tobytes()
        for key in r.sentences:
            at.append(seen.setdefault((key, mask), len(seen)))
            fold.append(i % folds)
    allowed = np.stack([np.frombuffer(m, bool) for _, m in seen]) if seen else np.zeros((0, len(model.subjects)), bool)
    allowed = np.concatenate([allowed, np.ones((len(seen), 1), bool)], 1)
    counts = np.bincount(np.array(fold, int) * len(seen) + np.array(at, int), minlength=folds * len(seen)).reshape(folds, len(seen)).astype(float)
    return Sentences(model, [k for k, _ in seen]), allowed, counts


def _unlabelled_counts(models: list[Model], distinct: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The expectation step over all distinct sentences (``key, n``), for several models at once: counts by feature and class, and mass by class.

    What comes back is one row per feature, a number bounded by PLACES + PAIRS.
    """
    held = distinct.sparkSession.sparkContext.broadcast(models)
    k, features = models[0].classes, models[0].features
    columns = [f"c{c}" for c in range(k)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros((features + 1, k)) for _ in held.value]
        for f in frames:
            if len(f):
                s = Sentences(held.value[0], f.key.tolist())
                for m, own in zip(held.value, total, strict=True):
                    w = _posterior(s.scores(m)) * f.n.to_numpy(float)[:, None]
                    own[:-1] += s.counts(m, w)
                    own[-1] += w.sum(0)
        for i, own in enumerate(total):
            rows = np.flatnonzero(own.any(1))
            yield pd.DataFrame({"m": i, "place": rows} | {c: own[rows, j].astype(np.float32) for j, c in enumerate(columns)})

    sums = distinct.mapInPandas(run, "m int, place int, " + ", ".join(f"{c} float" for c in columns))
    rows = sums.groupBy("m", "place").agg(*[F.sum(c).cast("float").alias(c) for c in columns]).toArrow()
    held.destroy()  # its files go from all disks
    model, place = rows.column("m").to_numpy(), rows.column("place").to_numpy()
    out = [np.zeros((features + 1, k), np.float32) for _ in models]
    for i, own in enumerate(out):
        mine = model == i
        for c in range(k):
            own[place[mine], c] = rows.column(columns[c]).to_numpy()[mine]
    return [(own[:-1], own[-1]) for own in out]


def _read(cards: DataFrame) -> DataFrame:
    """``id, fronts, backs, tags``: sentences as words joined by spaces; one row per id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f.id, "fronts": [[" ".join(s) for s in plain_sentences(t)] for t in f.front_original], "backs": [[" ".join(s) for s in plain_sentences(t)] for t in f.back_original], "tags": f.tags_resolved})

    one = cards.filter("id IS NOT NULL").select("id", "front_original", "back_original", "tags_resolved").dropDuplicates(["id"])
    return one.mapInPandas(run, "id string, fronts array<string>, backs array<string>, tags string")


def train(cards: DataFrame, areas: DataFrame, labels: DataFrame, scratch: storage.Scratch, most_labelled: int = 20_000, rounds: int = 2, folds: int = 4) -> tuple[Model | None, DataFrame]:
    """A model, and ``id, sentences, fronts, tags`` of all cards. At most ``most_labelled`` labelled cards are used (by a hash of their id)."""
    spark = cards.sparkSession
    read = scratch.cut(_read(cards), "read")
    ids = labels.filter("id IS NOT NULL").groupBy("id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    places = F.transform(F.split("s", " "), lambda w: (F.crc32(w.cast("binary")) % PLACES).cast("int"))
    seen = read.select(F.explode(F.concat("fronts", "backs")).alias("s")).select(F.explode(F.array_distinct(places)).alias("place")).groupBy("place").agg(F.count("*").alias("n"))
    kept = np.sort(seen.filter(F.col("n") >= LEAST_COUNT).select("place").toPandas().place.to_numpy(np.int64))  # at most PLACES numbers
    index = np.full(PLACES, -1, np.int32)
    index[kept] = np.arange(len(kept))
    model = Model(sorted(r[0] for r in areas.select("subject").distinct().collect()), index)
    held = spark.sparkContext.broadcast(model)

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for f in frames:
            fronts = [[k for s in x if (k := m.reduce(s.split(" ")))] for x in f.fronts]
            backs = [[k for s in x if (k := m.reduce(s.split(" ")))] for x in f.backs]
            yield pd.DataFrame({"id": f.id, "sentences": [a + b for a, b in zip(fronts, backs, strict=True)], "fronts": [len(a) for a in fronts], "tags": f.tags})

    reduced = scratch.cut(read.mapInPandas(reduce, "id string, sentences array<string>, fronts int, tags string"), "reduced")
    held.destroy()
    scratch.drop("read")
    k = len(model.subjects)
    number = {s: i for i, s in enumerate(model.subjects)}
    rows = reduced.join(F.broadcast(ids), "id").collect()  # at most most_labelled cards
    rows.sort(key=lambda r: r.id)
    if not rows or not k:
        return None, reduced
    subjects_of = {r.id: np.isin(np.arange(k), [number[s] for s in r.subjects if s in number]).astype(float) for r in rows}
    # models of all labels but a fold give that fold's evidence for calibration; all of them are refined alike
    y = np.stack([subjects_of[r.id] for r in rows])
    folds = min(folds, len(rows))
    held_sentences, allowed, counts = _labelled_sentences(model, rows, subjects_of, folds)
    models = [*(Model(model.subjects, index) for _ in range(folds if folds > 1 else 0)), model]
    weights = [*(counts.sum(0) - counts[f] for f in range(len(models) - 1)), counts.sum(0)]
    for f, (m, w) in enumerate(zip(models, weights, strict=True)):
        fit_labelled(m, held_sentences, allowed, w)
        _learn_hints(m, [r for i, r in enumerate(rows) if m is model or i % folds != f], subjects_of)
    distinct = scratch.cut(reduced.select(F.explode("sentences").alias("key")).groupBy("key").agg(F.count("*").alias("n")), "distinct")
    for _ in range(rounds):
        for m, w, more in zip(models, weights, _unlabelled_counts(models, distinct), strict=True):
            fit_labelled(m, held_sentences, allowed, w, rounds=2, more=more)
    x = np.zeros((len(rows), k, 5), np.float32)
    for f, m in enumerate(models[:-1]):
        x[f::folds] = _card_evidence(m, rows[f::folds])
    model.bias, model.slope = calibrate(x, y)
    return model, reduced


def card_subjects(cards: DataFrame, areas: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``id, subject``: every card with each subject whose posterior is at least ``least``.

    Null and empty sides have no sentences; without labels, or without areas, there are no rows.
    """
    model, reduced = train(cards, areas, labels, storage.Scratch(cards.sparkSession, "subjects"))
    if model is None:
        return reduced.limit(0).select("id", F.lit("").alias("subject"))
    held = cards.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for f in frames:
            p = posteriors(m, _card_evidence(m, list(f.itertuples(index=False))))
            i, c = np.nonzero(p >= least)
            yield pd.DataFrame({"id": f.id.to_numpy()[i], "subject": np.array(m.subjects, object)[c]})

    return reduced.mapInPandas(run, "id string, subject string")


def composition(found: DataFrame) -> DataFrame:
    """``subject, cards``: the collection counted by subject."""
    return found.groupBy("subject").agg(F.count("*").alias("cards"))
