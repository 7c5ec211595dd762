"""Operator 9, quality classifier: positive-unlabelled learning with the non-negative unbiased risk.

Features are shape statistics of the whole text (byte classes, word lengths, repetition of words, word runs and lines).
A small network is trained by Adam on ``prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])`` with the logistic
loss (Kiryo et al. 2017), on a bounded sample: at most ``POSITIVES`` trusted positives of the training fold (label 1) and
at most ``UNLABELLED`` texts of the training fold as they come, whose labels, if any, are not looked at. No label 0 is used.

The class prior is estimated from these two samples alone: the share of positives in a mixture is at most the unlabelled
share of any set over its positive share, and about that for a set that no negative reaches. The sets are the texts above
thresholds of a classifier of positives against unlabelled texts, fitted on one half of both and read on the other
(mixture proportion estimation after Scott 2015). Features are computed on the executors; no text reaches the driver.
Labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts have all-zero shape statistics and get the score of such a text; a null id is in
neither fold (``held_out`` null) and is scored like any other; without positives or texts the score is 0.5; an empty table gives no rows. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import learn
from quillspan.llm import textvec as tv
from quillspan.llm.memory import release

POSITIVES, UNLABELLED, HIDDEN, STEPS = 4000, 5000, 24, 500
FOLDS, THRESHOLD = 5, 0.3

_CLASS = np.full(256, 7)
_CLASS[65:91] = 0  # upper case
_CLASS[97:123] = 1  # lower case
_CLASS[128:] = 1
_CLASS[48:58] = 2  # digits
_CLASS[[9, 10, 11, 12, 13, 32]] = 3  # space
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 4  # ordinary punctuation
_CLASS[ord("!")] = 5
_CLASS[ord("|")] = 6
N_FEATURES = 8 + 11

_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the largest count of one value, by row."""
    r, _, c = tv.multiset(row, value)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, r, c)
    return np.bincount(r, minlength=n), top


def features(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of ``N_FEATURES`` statistics for each text."""
    out = []
    for first, last, data, offsets in tv.chunks(column):
        n, size = last - first, np.diff(offsets)
        doc = np.repeat(np.arange(n), size)
        kinds = np.bincount(doc * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8)
        starts, ends, row = tv.words(data, offsets)
        sums = tv.prefix_sums(data)
        word = tv.span_hash(sums, starts, ends)
        n_words = np.bincount(row, minlength=n)
        some, top = _distinct(row, word, n)
        same = np.zeros(n)
        if len(row) > 1:
            again = (row[1:] == row[:-1]) & (word[1:] == word[:-1])
            same = np.bincount(row[1:][again], minlength=n)
        runs, gram = tv.shingles(data, offsets, 5)
        n_runs = np.bincount(runs, minlength=n)
        some_runs, _ = _distinct(runs, gram, n)
        a, b, line_row = tv.words(data, offsets, _NOT_NEWLINE)
        some_lines, _ = _distinct(line_row, tv.span_hash(sums, a, b), n)
        n_lines = np.bincount(line_row, minlength=n)
        odd_end = np.bincount(row[_CLASS[data[ends - 1]] >= 5], minlength=n) if len(row) else np.zeros(n)
        capital = np.bincount(row[_CLASS[data[starts]] == 0], minlength=n) if len(row) else np.zeros(n)
        length = np.bincount(row, ends - starts, minlength=n) if len(row) else np.zeros(n)
        columns = [_share(kinds[:, k], size) for k in range(8)]
        columns += [_share(length, n_words) / 10, _share(some, n_words), _share(top, n_words), _share(same, n_words), _share(some_runs, n_runs), _share(some_lines, n_lines), _share(odd_end, n_words), _share(capital, n_words), _share(n_lines, n_words), np.log1p(n_words) / 10, np.log1p(_share(n_words, n_lines)) / 10]
        out.append(np.stack(columns, 1))
    return np.concatenate(out) if out else np.zeros((0, N_FEATURES))


@dataclass
class Model:
    """Standardisation and the two layers; ``constant`` is the score where nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ w1 + b1) @ w2 + b2

    def score(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        return 1 / (1 + np.exp(-self.logits(features(column)).clip(-40, 40)))


def nn_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk of logits on positives and on unlabelled rows."""
    loss = lambda z: np.logaddexp(0, -z).mean()
    return prior * loss(positive) + max(0.0, loss(-unlabelled) - prior * loss(-positive))


def fit_model(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, seed: int = 1, plain: bool = False) -> Model:
    """Adam on the non-negative risk; where its second part is negative, the step raises that part alone. ``plain``: on the
    risk of telling the two samples apart."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 0.3, (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    p, u = ((x - mean) / scale for x in (positive, unlabelled))
    x, n_p = np.concatenate([p, u]).clip(-8, 8), len(p)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        w1, b1, w2, b2 = weights
        hidden = np.tanh(x @ w1 + b1)
        z = hidden @ w2 + b2
        sig = 1 / (1 + np.exp(-z.clip(-40, 40)))
        negative = np.logaddexp(0, z[n_p:]).mean() - prior * np.logaddexp(0, z[:n_p]).mean()
        grad = np.empty_like(z)
        if plain:
            grad[:n_p], grad[n_p:] = (sig[:n_p] - 1) / n_p, sig[n_p:] / len(u)
        elif negative >= 0:
            grad[:n_p] = prior * (sig[:n_p] - 1 - sig[:n_p]) / n_p
            grad[n_p:] = sig[n_p:] / len(u)
        else:
            grad[:n_p] = prior * sig[:n_p] / n_p
            grad[n_p:] = -sig[n_p:] / len(u)
        back = grad[:, None] * w2 * (1 - hidden**2)
        grads = [x.T @ back + 1e-4 * w1, back.sum(0), hidden.T @ grad + 1e-4 * w2, grad.sum(keepdims=True)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, weights)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 2) -> float:
    """The share of positives among unlabelled rows, from features of both."""
    if min(len(positive), len(unlabelled)) < 2 * folds:
        return 0.5
    p_score, u_score = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for k in range(folds):
        p_in, u_in = np.arange(len(positive)) % folds != k, np.arange(len(unlabelled)) % folds != k
        # With a prior of 1/2 and the plain loss this is a classifier of one sample against the other.
        model = fit_model(positive[p_in], unlabelled[u_in], 0.5, steps=200, seed=2 + k, plain=True)
        p_score[~p_in], u_score[~u_in] = model.logits(positive[~p_in]), model.logits(unlabelled[~u_in])
    cut = np.quantile(p_score, np.linspace(0.05, 0.9, 60))
    p_share = 1 - np.searchsorted(np.sort(p_score), cut) / len(p_score)
    u_share = 1 - np.searchsorted(np.sort(u_score), cut) / len(u_score)
    noise = np.sqrt(np.maximum(u_share * (1 - u_share), 1e-9) / len(u_score)) / p_share
    return float(np.clip((u_share / p_share + noise).min(), 0.02, 0.98))


def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    try:
        for texts in batches:
            found = features(texts)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * N_FEATURES, pa.int32()), pa.array(found.ravel()))
    finally:
        release()


def features_of(texts: DataFrame) -> np.ndarray:
    """Features of a bounded sample, in the order of ids, computed where the texts are."""
    rows = texts.select("doc_id", F.arrow_udf(_features, "array<double>")("text").alias("x")).toArrow().sort_by("doc_id")["x"].combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    train = learn.fold("doc_id", FOLDS) != 0
    positive = features_of(learn.texts_of(docs, learn.labelled_ids(labels, "quality", 1, POSITIVES, train)))
    if not len(positive):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), [], 0.5)
    unlabelled = features_of(learn.any_texts(docs, UNLABELLED, train))
    return fit_model(positive, unlabelled, class_prior(positive, unlabelled))


def score_column(model: Model, text: Column) -> Column:
    """The score of whole texts, by an Arrow function."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield pa.array(model.score(texts))
        finally:
            release()

    return score(text)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    model = fit(spark, docs, labels)
    scored = docs.select("doc_id", (learn.fold("doc_id", FOLDS) == 0).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    model = fit(spark, docs, labels)
    return docs.where(score_column(model, F.col("text")) >= THRESHOLD)
