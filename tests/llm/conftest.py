from __future__ import annotations

import random

import pytest

SMALL = "/root/testdata/sf0.001"


def edge_rows() -> list[tuple]:
    """Null ids, null and empty texts, ties, repeated rows and a very long text."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return [(1, "a b c d e f g"), (2, None), (3, ""), (4, "a b c d e f g"), (4, "a b c d e f g"), (None, "x y"), (None, None), (5, "one"), (6, long), (7, "é😀 ñ " * 40), (8, "De " * 3000)]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows with extra columns whose names clash with what operators use inside."""
    rows = [(i, t, "en", "src0", len(t or ""), "k", 1.0, [1], "z") for i, t in edge_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double, bands array<int>, row string")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def words():
    rng = random.Random(4)
    return lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
