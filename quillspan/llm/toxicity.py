"""Operator 1, toxicity: weak supervision by many lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters. A fixed lexicon of insults gives one voter a word. Pattern voters are beginnings of words (4 to 8 bytes) and
   whole words that occur far oftener in toxic than in clean training texts; the ``VOTERS`` with the best record vote. A
   voter fires or abstains.
2. Label model. Expectation-maximisation estimates how often each voter fires on toxic and on clean texts, and the
   correlation of voters given the class; a voter's evidence is divided by 1 + the sum of its correlations, so that nested
   patterns do not count several times. Abstention counts as evidence likewise. The training label is one more voter, whose
   accuracy on either class is estimated like the others' within ``LABEL_TRUST``.
   (Without it, the votes of this lexicon and these patterns alone settle on other classes of texts than toxic ones: held-out
   recall on the small check table falls from 0.99 to 0.69.)
3. Classifier. A logistic regression on presence of up to ``PATTERNS`` patterns is trained on the posteriors and scores
   whole texts.

It learns from a bounded sample: at most ``TOXIC`` and ``CLEAN`` labelled rows of the training fold, whole texts. Patterns are
counted and matched on the executors; the driver gets counts and, for each text, the numbers of the patterns it has.
Labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts score the classifier's intercept; a null id has ``held_out`` null and is scored
like any other; without usable labels the lexicon alone scores; an empty table gives no rows; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import learn
from quillspan.llm import textvec as tv
from quillspan.llm.memory import release, tidy
from quillspan.sources.shared import materialise

TOXIC, CLEAN = 3000, 5000
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Bytes of a word's beginning that make a pattern; 0: the whole word.
LENGTHS = (0, 4, 5, 6, 7, 8)
#: Size of the model, as in any classifier of fixed size: patterns that vote, and patterns the classifier weighs.
VOTERS, PATTERNS = 256, 1200
#: Bounds of the label voter's accuracy.
LABEL_TRUST = 0.9, 0.97
#: Toxic sample texts that must hold a pattern.
SUPPORT = 3
#: Correlations of voters below this, given the class, are taken for noise.
TIED = 0.2

LEXICON = (
    "idiot stupid moron loser scum trash pathetic worthless disgusting clown dumb fool jerk garbage filth filthy vermin creep "
    "imbecile coward liar pig freak ugly hateful nasty vile parasite degenerate brainless useless crap"
).split()

_SALT = tv.mix(np.arange(1, 17, dtype=np.uint64))


def pattern_hits(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """``first, n`` of a row range and, for each pattern length, ``row, hash`` of every word that has it."""
    for first, last, data, offsets in tv.chunks(column):
        low = tv.lower(data)
        starts, ends, row = tv.words(low, offsets, tv.ALNUM)
        sums = tv.prefix_sums(low)
        found = []
        for k, length in enumerate(LENGTHS):
            long = ends - starts >= length
            stop = ends if not length else starts[long] + length
            found.append((row[long], tv.span_hash(sums, starts[long], stop) ^ _SALT[k]))
        yield first, last - first, found


def _hash_of(words: list[str]) -> np.ndarray:
    (_, _, found), = pattern_hits(pa.array([" ".join(words)]))
    return found[0][1]


@dataclass
class Model:
    """Sorted pattern hashes with their weights (none while it only matches)."""

    keys: np.ndarray
    weights: np.ndarray
    intercept: float

    def matches(self, column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``first, n`` of a row range, and the distinct pairs of row and number of a pattern that it has."""
        seen = np.zeros(1 << 18, bool)
        seen[(self.keys >> np.uint64(46)).astype(np.int64)] = True
        for first, n, found in pattern_hits(column):
            pairs = []
            for row, key in found:
                maybe = seen[(key >> np.uint64(46)).astype(np.int64)]
                row, key = row[maybe], key[maybe]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                pairs.append(row[hit] * len(self.keys) + at[hit])
            both = np.unique(np.concatenate(pairs))
            yield first, n, both // len(self.keys), both % len(self.keys)

    def score(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        z = np.full(len(column), self.intercept)
        for first, n, row, at in self.matches(column):
            z[first : first + n] += np.bincount(row, self.weights[at], minlength=n)
        return 1 / (1 + np.exp(-z.clip(-40, 40)))


@tidy
def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each class of a batch have each pattern."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for first, n, found in pattern_hits(batch.column("text")):
            row, key, _ = tv.multiset(*(np.concatenate(x) for x in zip(*found, strict=True)))
            kind, place = np.unique(key, return_inverse=True)
            of = toxic[first : first + n][row]
            counts = [np.bincount(place, of == v, minlength=len(kind)).astype(np.int64) for v in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(kind.view(np.int64)), *map(pa.array, counts)], ["pattern", "on_toxic", "on_clean"])


def _matched(keys: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    matcher = Model(keys, np.zeros(0), 0.0)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, at in matcher.matches(batch.column("text")):
                cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("toxic").slice(first, n), lists], ["doc_id", "toxic", "has"])

    return run


@dataclass
class Votes:
    """What the label model learned: posteriors, how often each voter fires on toxic and on clean texts, the correlations
    of voters given the class, and the label voter's accuracy on either class."""

    posterior: np.ndarray
    on_toxic: np.ndarray
    on_clean: np.ndarray
    tied: np.ndarray
    label_toxic: float
    label_clean: float


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 25) -> Votes:
    """The generative model of a 0/1 matrix of votes (texts x voters) and the label voter."""
    prior = float(np.clip(gold.mean(), 0.01, 0.99)) if len(gold) else 0.5
    q = np.clip(gold.astype(float), 0.05, 0.95)
    for _ in range(rounds):
        on = (q @ votes + 1) / (q.sum() + 10)
        off = ((1 - q) @ votes + 0.02) / ((1 - q).sum() + 10)
        expected = np.outer(q, on) + np.outer(1 - q, off)
        residue = votes - expected
        scale = np.sqrt((residue**2).mean(0)) + 1e-9
        tied = (residue.T @ residue) / len(votes) / np.outer(scale, scale)
        np.fill_diagonal(tied, 0)
        share = 1 / (1 + np.where(tied > TIED, tied, 0).sum(0))
        says = [float(np.clip(x, *LABEL_TRUST)) for x in ((q @ gold) / max(q.sum(), 1e-9), ((1 - q) @ (1 - gold)) / max((1 - q).sum(), 1e-9))]
        label = np.where(gold == 1, np.log(says[0] / (1 - says[1])), np.log((1 - says[0]) / says[1]))
        z = np.log(prior / (1 - prior)) + votes @ (np.log(on / off) * share) + (1 - votes) @ (np.log((1 - on) / (1 - off)) * share) + label
        q = 1 / (1 + np.exp(-z.clip(-30, 30)))
    return Votes(q, on, off, tied, *says)


def rank_patterns(seen: np.ndarray, other: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Places of the usable patterns, best first: by the lower end of their log odds times their count."""
    odds = np.log((seen + 0.5) / n1) - np.log((other + 0.5) / n0)
    # The lower end of the log odds' spread, so that rare patterns need a cleaner record.
    sure = odds - np.sqrt(1 / (seen + 0.5) + 1 / (other + 0.5))
    best = np.flatnonzero(sure > 0.7)
    return best[np.argsort(-(sure[best] * seen[best]), kind="stable")]


def fit_model(spark: SparkSession, sample: DataFrame) -> Model:
    """Voters, label model and classifier from a bounded sample of whole texts (``doc_id, text, toxic``)."""
    lexicon = np.unique(_hash_of(LEXICON))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(lexicon, np.full(len(lexicon), 5.0), -4.0)
    counts = sample.mapInArrow(_patterns, "pattern long, on_toxic long, on_clean long").groupBy("pattern").agg(F.sum("on_toxic").alias("on_toxic"), F.sum("on_clean").alias("on_clean"))
    # Of what a bounded sample holds, only patterns that are commoner in its toxic part can be chosen.
    counts = counts.where((F.col("on_toxic") >= SUPPORT) & (F.col("on_toxic") * n0 > 2 * F.col("on_clean") * n1)).toArrow().sort_by("pattern")
    keys = counts["pattern"].to_numpy().view(np.uint64)
    best = rank_patterns(counts["on_toxic"].to_numpy(), counts["on_clean"].to_numpy(), n1, n0)[:PATTERNS]
    chosen = np.unique(np.concatenate([keys[best], lexicon]))
    found = sample.mapInArrow(_matched(chosen), "doc_id long, toxic int, has array<int>").toArrow().sort_by("doc_id")
    has = found["has"].combine_chunks()
    gold = found["toxic"].to_numpy().astype(float)
    x = np.zeros((len(gold), len(chosen)), np.float32)
    x[np.repeat(np.arange(len(gold)), np.diff(has.offsets.to_numpy())), has.flatten().to_numpy()] = 1
    voters = np.searchsorted(chosen, np.unique(np.concatenate([keys[best[:VOTERS]], lexicon])))
    votes = x[:, voters]
    learned = label_model(votes.astype(float), gold)
    return Model(chosen, *_logistic(x, learned.posterior))


def _logistic(x: np.ndarray, q: np.ndarray, steps: int = 400, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft labels, by Adam on the whole sample."""
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log((q.mean() + 1e-6) / (1 - q.mean() + 1e-6)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    rare = np.where(q > 0.5, 0.5 / max((q > 0.5).mean(), 1e-6), 0.5 / max((q <= 0.5).mean(), 1e-6))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ w + b).clip(-30, 30)))
        slope = ((p - q) * rare / len(q)).astype(np.float32)
        g = np.append(slope @ x + decay * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
    return w.astype(float), float(b)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    train = learn.fold("doc_id", FOLDS) != HELD_OUT
    parts = [learn.texts_of(docs, learn.labelled_ids(labels, "toxic", value, rows, train)).withColumn("toxic", F.lit(value)) for value, rows in ((1, TOXIC), (0, CLEAN))]
    return fit_model(spark, materialise(spark, parts[0].unionByName(parts[1]).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic"), "labelled"))


def score_column(model: Model, text: Column) -> Column:
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
    scored = docs.select("doc_id", (learn.fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
