"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= j) = sigmoid(threshold_j - w x): one weight for each word, shared by all
ordered thresholds.  x holds the square roots of the counts of the words and beginnings of
words that mark toxic documents most clearly in a bounded sample of labelled rows (``SAMPLE``
of each label): those in so many toxic ones that chance alone would seldom do it
(``CHANCE``, an exact test, so small tables and rare languages get words too).  Labels say only whether a document is toxic; a toxic document's
grade, 1 to ``GRADES`` - 1, is the quantile of its amount of tell-tale words among
the toxic ones.  Every text is scored whole.

Nulls, empties, ties: a null or wordless text has no features and gets the grade
that the thresholds alone give, 0 unless nearly all labels are toxic.  Labels that
are null or of unknown documents don't count; several labels of a document count
as toxic if one is.  Without both labels there is no model, and all scores are 0.
Repeated rows give a row each; further columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.shared import NOT_LETTER, by_batch, record, word_hashes

#: Labelled documents learned from, of each label (half as many again at most).
SAMPLE = 2500
#: Words with a weight, the documents that must hold one, and grades.
WORDS, LEAST, GRADES = 1500, 3, 4
#: Probability, at most, that a word without a say is in so many toxic documents; beginnings of words that count, in bytes.
CHANCE, BEGINNINGS = 0.01, (4, 6)
STEPS, RATE, RIDGE = 500, 0.05, 3e-4


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of every word and of its beginnings, by text."""
    found = [word_hashes(texts, NOT_LETTER), *(word_hashes(texts, NOT_LETTER, n) for n in BEGINNINGS)]
    hashes = np.concatenate([h + np.uint64(i) for i, (h, _) in enumerate(found)])
    of = np.concatenate([o for _, o in found])
    order = np.argsort(of, kind="stable")
    return hashes[order], of[order]


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.keys, self.weights, self.thresholds = keys, weights, thresholds

    def linear(self, hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """w x for each of n texts."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == hashes)
        pairs, counts = np.unique(of[hit] * len(self.keys) + at[hit], return_counts=True)
        return np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)] * np.sqrt(counts), n)

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """[text, j]: P(grade > j)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -40, 40)))


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the likelihood, by Adam; classes weigh alike in sum."""
    levels = int(grades.max()) if len(grades) else 0
    share = np.bincount(grades, minlength=levels + 1) / len(grades)
    weight = (1 / np.maximum(share, 1e-9))[grades]
    weight = np.sqrt(weight) / np.sqrt(weight).mean()
    state = np.concatenate([np.zeros(width), [1.0], np.zeros(levels - 1)])  # later thresholds: logs of the gaps
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        w, first, gaps = state[:width], state[width], np.exp(state[width + 1 :])
        cuts = first + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(rows, w[columns] * values, len(grades))
        below = np.c_[np.zeros(len(grades)), 1 / (1 + np.exp(np.clip(score[:, None] - cuts, -40, 40))), np.ones(len(grades))]
        here = np.maximum(below[np.arange(len(grades)), grades + 1] - below[np.arange(len(grades)), grades], 1e-9)
        slope = below * (1 - below)
        upper, lower = slope[np.arange(len(grades)), grades + 1], slope[np.arange(len(grades)), grades]
        by_score = weight * (upper - lower) / here / len(grades)  # of the negative log likelihood
        by_cut = np.zeros(levels)
        for j in range(levels):
            by_cut[j] = -(weight * ((grades == j) * upper - (grades == j + 1) * lower) / here).sum() / len(grades)
        grad = np.concatenate([np.bincount(columns, by_score[rows] * values, width) + RIDGE * w, [by_cut.sum()], [by_cut[j + 1 :].sum() * gaps[j] for j in range(levels - 1)]])
        mean += 0.1 * (grad - mean)
        square += 0.001 * (grad * grad - square)
        state = state - RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return state[:width], state[width] + np.concatenate([[0], np.cumsum(np.exp(state[width + 1 :]))])


def log_chance(bad: np.ndarray, good: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log of the probability that of bad + good documents drawn from toxic + clean ones ``bad`` or more are toxic (Fisher's exact test)."""
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, toxic + clean + 1)))])
    ways = lambda n, k: log[n] - log[k] - log[n - k]
    pairs, of = np.unique(np.c_[bad, bad + good].astype(np.int64), axis=0, return_inverse=True)
    out = np.empty(len(pairs))
    for i, (least, n) in enumerate(pairs.tolist()):
        k = np.arange(max(least, n - clean), min(n, toxic) + 1)
        terms = ways(toxic, k) + ways(clean, n - k) - ways(toxic + clean, n)
        out[i] = terms.max() + np.log(np.exp(terms - terms.max()).sum())
    return out[of.ravel()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal | None:
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = dict(known.groupBy("toxic").count().collect())  # two rows
    if not (sizes.get(0) and sizes.get(1)):
        return None
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    limit = F.when(F.col("toxic") == 1, int(1e6 * sample / sizes[1]) + 1).otherwise(int(1e6 * sample / sizes[0]) + 1)
    picked = known.filter(chance < limit).limit(3 * sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, of = _features(batch.column("text"))
        ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
        found = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return record({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "words": [h.tobytes() for h, _ in found], "counts": [c.astype("<u4").tobytes() for _, c in found]}, {"words": pa.binary(), "counts": pa.binary()})

    joined = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")  # 3 * sample rows of two numbers
    table = by_batch(joined, counts, "doc_id long, toxic int, words binary, counts binary").toPandas().sort_values("doc_id").drop_duplicates(["words", "counts"])  # copies count once
    toxic = table["toxic"].to_numpy(int)
    if toxic.min(initial=1) >= toxic.max(initial=0):
        return None
    words = [np.frombuffer(x, np.uint64) for x in table["words"]]
    times = [np.frombuffer(x, "<u4").astype(float) for x in table["counts"]]
    doc = np.repeat(np.arange(len(words)), [len(x) for x in words])
    keys, column = np.unique(np.concatenate(words), return_inverse=True)
    bad, good = np.bincount(column, toxic[doc], len(keys)), np.bincount(column, 1 - toxic[doc], len(keys))
    odds = np.log((bad + 0.5) / (toxic.sum() - bad + 0.5)) - np.log((good + 0.5) / ((1 - toxic).sum() - good + 0.5))
    share = toxic.mean()
    due = (bad + good) * share  # if the word had nothing to do with the label
    strength, likely = np.zeros(len(keys)), np.flatnonzero((bad + good >= LEAST) & (bad > due))
    chance = log_chance(bad[likely], good[likely], int(toxic.sum()), int((1 - toxic).sum()))
    strength[likely] = np.where(chance <= np.log(CHANCE), -chance, 0)
    chosen = np.sort(np.argsort(-strength, kind="stable")[: min(WORDS, int((strength > 0).sum()))])
    if not len(chosen):
        return None
    place = np.full(len(keys), -1)
    place[chosen] = np.arange(len(chosen))
    value = np.concatenate(times)
    use = place[column] >= 0
    telling = use & (odds[column] > 2)
    evidence = np.bincount(doc, telling * np.sqrt(value), len(words))
    cuts = np.quantile(evidence[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    grades = np.where(toxic == 1, 1 + np.searchsorted(cuts, evidence, side="left"), 0)
    grades = np.unique(grades, return_inverse=True)[1]  # no empty grade between
    weights, thresholds = fit(doc[use], place[column[use]], np.sqrt(value[use]), grades, len(chosen))
    return Ordinal(keys[chosen], weights, thresholds)


def scores(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """(doc_id, toxic, grade, severity, p_toxic): severity is the expected grade."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        over = np.zeros((n, 1))
        if model is not None and len(model.keys):
            over = model.at_least(model.linear(*_features(batch.column("text")), n))
        return record({"doc_id": batch.column("doc_id"), "toxic": over[:, 0] >= 0.5, "grade": (over >= 0.5).sum(axis=1).astype(np.int32), "severity": over.sum(axis=1), "p_toxic": over[:, 0]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_batch(rows, run, "doc_id long, toxic boolean, grade int, severity double, p_toxic double")


def op5(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, train(docs, labels))
