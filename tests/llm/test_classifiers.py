"""Operators 1 and 9: held-out accuracy, folds, and edge rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import quality, toxicity

MEDIUM = "/root/testdata/sf0.1"
CASES = {"quality": (quality, 5, 0), "toxic": (toxicity, 3, 1)}


def auc(score: np.ndarray, label: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[label == 1].mean() - rank[label == 0].mean()) / len(score) + 0.5


@pytest.mark.parametrize("label", list(CASES))
def test_held_out(spark, label):
    module, parts, held = CASES[label]
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    rows = module.classify(spark, docs, labels).join(labels, "doc_id").toPandas()
    assert all((zlib.crc32(str(i).encode()) % parts == held) == h for i, h in zip(rows["doc_id"], rows["held_out"], strict=True))
    test = rows[rows["held_out"]]
    assert test["score"].between(0, 1).all()
    assert auc(test["score"].to_numpy(), test[label].to_numpy()) > 0.93
    assert (test["predicted"] == test[label]).mean() > 0.95
    assert ((test["predicted"] == 1) == (test["score"] >= module.THRESHOLD)).all()


@pytest.mark.parametrize("label", list(CASES))
def test_edge_rows_and_no_labels(spark, edges, label):
    module = CASES[label][0]
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (3, None, None), (5, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = module.classify(spark, edges, known).collect()
        assert len(rows) == edges.count()
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] is None for r in rows if r["doc_id"] is None)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 4)}) == 1
    assert module.classify(spark, edges.limit(0), labels).count() == 0


def test_labels_do_not_leak(spark, small_docs):
    """Flipping the held-out labels changes no score."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.classify(spark, small_docs, x).orderBy("doc_id").toPandas()["score"] for x in (labels, flipped))
    assert np.array_equal(one, two)


def test_risk_is_not_negative_in_its_second_part():
    assert quality.nn_risk(np.array([9.0]), np.array([-9.0]), 0.5) >= 0
    assert quality.nn_risk(np.array([-9.0]), np.array([-30.0]), 0.9) == pytest.approx(0.9 * np.log1p(np.exp(9.0)), rel=1e-6)


def test_label_model_learns_voters_and_corrects_labels():
    """Voters of known rates, one copied voter, and labels of which 7 in 100 are wrong: rates and accuracies are found, the
    copy is seen as correlated, and the posteriors are nearer to the truth than the labels."""
    rng = np.random.default_rng(0)
    n = 6000
    y = (rng.random(n) < 0.4).astype(int)
    on, off = np.array([0.7, 0.6, 0.5, 0.4, 0.65, 0.3]), np.array([0.02, 0.05, 0.01, 0.03, 0.1, 0.3])
    votes = (rng.random((n, 6)) < np.where(y[:, None] == 1, on, off)).astype(float)
    copy = np.where(rng.random(n) < 0.95, votes[:, 5], 0)
    labels = np.where(rng.random(n) < 0.07, 1 - y, y)
    found = toxicity.label_model(np.hstack([votes, copy[:, None]]), labels.astype(float))
    assert np.abs(found.on_toxic[:6] - on).max() < 0.05
    assert np.abs(found.on_clean[:6] - off).max() < 0.05
    assert found.tied[5, 6] > 0.8
    assert np.abs(found.tied[:5, :5]).max() < toxicity.TIED
    assert abs(found.label_toxic - 0.93) < 0.03
    assert abs(found.label_clean - 0.93) < 0.03
    assert ((found.posterior > 0.5) == y).mean() > (labels == y).mean() + 0.02


def test_class_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    for prior in (0.3, 0.6, 0.85):
        positive = rng.normal(1.5, 1, (1500, 4))
        mixed = np.where(rng.random((3000, 1)) < prior, rng.normal(1.5, 1, (3000, 4)), rng.normal(-1.5, 1, (3000, 4)))
        assert abs(quality.class_prior(positive, mixed) - prior) < 0.06


def test_very_long_texts_are_learned_from(spark):
    """A text of over two million bytes is a training text like any other."""
    long = "dreadful vermin wording " * 90_000
    rows = [(k, (long if k == 0 else f"vermin wording here {k}") if k % 2 else f"good plain words {k}") for k in range(60)] + [(1001, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(1001,), (2,)], "doc_id long")
    from quillspan.llm import learn

    assert {r["doc_id"]: len(r["text"]) for r in learn.texts_of(docs, ids).collect()} == {1001: len(long), 2: len(rows[2][1])}
    assert quality.features_of(learn.texts_of(docs, ids)).shape == (2, quality.N_FEATURES)
    labels = docs.select("doc_id", (F.col("text").contains("vermin")).cast("int").alias("toxic"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.classify(spark, docs, labels).collect()}
    assert scores[1001] > scores[2]


def test_keep_good_keeps_columns(spark, edges):
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    assert quality.keep_good(spark, edges, labels).columns == edges.columns
