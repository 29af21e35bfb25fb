"""Reading level of prose documents: boosted regression trees over distributions of sentence and word measures.

A document is prose if at least half of its words stand in sentences (a run that ends in a full stop, question or
exclamation mark). Headings, markup, footers without such a mark, commands, lists and loose scraps are none. Its
measures are distributions over its sentences, weighted by words, so that a few sentences of another level don't
decide. Trees are fitted on a bounded number of labelled documents; the limits between levels are set on predictions
of folds that share no source with their training rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill import storage

_TAG = re.compile(r"<[^<>]*>")
_SENTENCE = re.compile(r"[^.!?…\n]*(?:[.!?…](?![\s\"'»”)\]]|$)[^.!?…\n]*)*[.!?…]+[\"'»”)\]]*(?=\s|$)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LENGTH_CUTS = np.array([4, 8, 12, 16, 20, 25, 30, 36, 43, 52])
_QUANTILES = (10, 25, 50, 75, 90)
#: Words of the windows in which variety is measured.
_WINDOW = 400

#: Levels, from the least demanding.
LEVELS = (1, 2, 3, 4)


def measures(text: str | None) -> list[float] | None:
    """The measures of a prose document; None for a text that isn't mainly prose (null, blank, commands, lists, scraps)."""
    if not text:
        return None
    text = _TAG.sub(" ", text)
    total = sum(1 for t in text.split() if any(c.isalnum() for c in t))
    sentences = []
    for line in text.split("\n"):
        if line.lstrip().startswith("#"):
            continue
        for m in _SENTENCE.finditer(line):
            words = _WORD.findall(m.group())
            if words:
                sentences.append((words, m.group().count(",") + m.group().count(";")))
    inside = sum(len(w) for w, _ in sentences)
    if not inside or 2 * inside < total:
        return None
    lengths = np.array([len(w) for w, _ in sentences], float)
    letters = np.array([sum(map(len, w)) / len(w) for w, _ in sentences])
    long_share = np.array([sum(len(x) >= 10 for x in w) / len(w) for w, _ in sentences])
    commas = np.array([c / len(w) for w, c in sentences])
    out: list[float] = []
    for values in (lengths, letters, long_share):
        order = np.argsort(values, kind="stable")
        weight = np.cumsum(lengths[order]) / inside
        out += [float(values[order][min(len(order) - 1, int(np.searchsorted(weight, q / 100)))]) for q in _QUANTILES]
    place = np.searchsorted(_LENGTH_CUTS, lengths, "left")
    out += (np.bincount(place, lengths, len(_LENGTH_CUTS) + 1) / inside).tolist()
    flat = [x.lower() for w, _ in sentences for x in w]
    out += [float(np.average(commas, weights=lengths)), sum(map(len, flat)) / inside, sum(len(x) >= 13 for x in flat) / inside, sum(len(x) <= 3 for x in flat) / inside]
    out.append(variety(flat))
    before: set = set()
    shared = []
    for w, _ in sentences:
        now = {x.lower() for x in w if len(x) >= 5}
        if now and before:
            shared.append(len(now & before) / len(now))
        before = now
    out.append(float(np.mean(shared)) if shared else 0.0)
    return out


def variety(words: list[str], window: int = _WINDOW) -> float:
    """The mean share of different words over all windows of so many words; a shorter text is one window."""
    if len(words) <= window:
        return len(set(words)) / max(1, len(words))
    held, total = Counter(words[:window]), 0
    total = different = len(held)
    for gone, come in zip(words, words[window:], strict=False):
        held[come] += 1
        different += held[come] == 1
        held[gone] -= 1
        different -= held[gone] == 0
        total += different
    return total / (window * (len(words) - window + 1))


WIDTH = 3 * len(_QUANTILES) + len(_LENGTH_CUTS) + 1 + 6


@dataclass
class Trees:
    """Regression trees of fixed depth as flat arrays: feature and limit of every inner node, value of every leaf."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    limit: np.ndarray
    value: np.ndarray  # (trees, 2**depth)

    def predict(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.value.shape[1]))
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.12, bins: int = 32, ridge: float = 3.0) -> Trees:
    """Gradient boosting for squared error with histogram splits."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    place = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    inner, leaves = 2**depth - 1, 2**depth
    feature, limit, value = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    base = float(y.mean())
    guess = np.full(n, base)
    offsets = np.arange(width) * bins
    for t in range(trees):
        rest, node = y - guess, np.zeros(n, int)
        for level in range(depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == k)
                if len(rows) < 4:
                    continue
                flat = (place[rows] + offsets).ravel()
                sums = np.bincount(flat, np.repeat(rest[rows], width), width * bins).reshape(width, bins).cumsum(1)
                counts = np.bincount(flat, minlength=width * bins).reshape(width, bins).cumsum(1)
                all_sum, all_count = sums[:, -1:], counts[:, -1:]
                gain = sums**2 / (counts + ridge) + (all_sum - sums) ** 2 / (all_count - counts + ridge)
                gain[(counts < 2) | (all_count - counts < 2)] = -np.inf
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] > all_sum[0, 0] ** 2 / (all_count[0, 0] + ridge) + 1e-9 and b < len(cuts[f]):
                    feature[t, k], limit[t, k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > limit[t][node])
        leaf = node - inner
        sums, counts = np.bincount(leaf, rest, leaves), np.bincount(leaf, minlength=leaves)
        value[t] = rate * sums / (counts + ridge)
        guess += value[t][leaf]
    return Trees(base, feature, limit, value)


def limits(guess: np.ndarray, level: np.ndarray) -> list[float]:
    """The limit between each two neighbouring levels that misplaces the fewest held-out predictions; halfway in a gap."""
    out = []
    for a, b in zip(LEVELS, LEVELS[1:], strict=False):
        near = (level == a) | (level == b)
        low, high = np.sort(guess[level <= a]), np.sort(guess[level >= b])
        if not near.any() or not len(low) or not len(high):
            out.append((a + b) / 2)
            continue
        tries = np.unique(np.r_[(a + b) / 2, guess[near]])
        tries = np.unique(np.r_[tries, (tries[1:] + tries[:-1]) / 2])
        wrong = np.array([(low > t).sum() + (high <= t).sum() for t in tries])
        best = tries[wrong == wrong.min()]
        out.append(float(best[len(best) // 2]))
    return list(np.maximum.accumulate(out))


def cross_validated(x: np.ndarray, y: np.ndarray, group: np.ndarray, folds: int = 5) -> np.ndarray:
    """Predictions of every row by trees that saw no row of its group (source)."""
    names = np.unique(group)
    fold_of = {g: i % folds for i, g in enumerate(names)}
    fold = np.array([fold_of[g] for g in group]) if len(names) > 1 else np.arange(len(y)) % folds
    out = np.full(len(y), y.mean())
    for k in np.unique(fold):
        train, test = fold != k, fold == k
        if train.any():
            out[test] = boost(x[train], y[train]).predict(x[test])
    return out


@dataclass
class Grader:
    trees: Trees
    limits: list[float]
    held_out: float  # share of labelled documents placed right by folds without their source

    def grade(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.limits, self.trees.predict(x), "left") + 1


def fit(x: np.ndarray, y: np.ndarray, source: np.ndarray) -> Grader:
    held = cross_validated(x, y, source)
    cuts = limits(held, y)
    return Grader(boost(x, y), cuts, float((np.searchsorted(cuts, held, "left") + 1 == y).mean()))


def _measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, m in enumerate(found) if m is not None]
            flat = pa.array(np.array([found[i] for i in keep], np.float32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(keep) + 1) * WIDTH, WIDTH, dtype=np.int32)), flat)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), lists], names=["doc_id", "source", "m"])

    return docs.select("doc_id", "text", "source").mapInArrow(run, "doc_id bigint, source string, m array<float>")


def train(measured: DataFrame, labels: DataFrame, most: int = 20_000) -> Grader | None:
    """A grader from at most ``most`` labelled documents (the first by a hash of their id); None without any."""
    chosen = labels.filter(F.col("reading_level").isin(*LEVELS)).groupBy("doc_id").agg(F.max("reading_level").alias("level")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = measured.join(F.broadcast(chosen), "doc_id").select("doc_id", "source", "m", "level").toPandas().sort_values("doc_id")
    if rows.empty:
        return None
    return fit(np.stack(rows.m.tolist()).astype(float), rows.level.to_numpy(float), rows.source.fillna("").to_numpy(str))


def reading_levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, reading_level``: one row for every prose document. Without labels there are no rows."""
    scratch = storage.Scratch(docs.sparkSession, "reading")
    measured = scratch.cut(_measured(docs), "measured")
    grader = train(measured, labels)
    if grader is None:
        return measured.limit(0).select("doc_id", F.lit(0).alias("reading_level"))
    held = docs.sparkSession.sparkContext.broadcast(grader)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"doc_id": f.doc_id, "reading_level": held.value.grade(np.stack(f.m.tolist()).astype(float)).astype(np.int32)})

    return measured.select("doc_id", "m").mapInPandas(run, "doc_id bigint, reading_level int")


def held_out_accuracy(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``labelled, held_out``: what the folds without a document's source place right."""
    measured = _measured(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"))
    grader = train(measured, labels)
    n = labels.select("doc_id").distinct().count()
    return docs.sparkSession.createDataFrame([(n, grader.held_out if grader else None)], "labelled bigint, held_out double")
