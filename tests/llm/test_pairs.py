"""Operators 6 and 10, and the pipeline's stages."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quillspan.llm import ann, bpe, near_dup
from quillspan.llm import textvec as tv
from quillspan.sources.shared import table

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def shingles(text: str | None) -> Counter:
    w = (text or "").split()
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def overlap(a: Counter, b: Counter) -> float:
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 0.0


def brute_groups(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """Least id of each group of rows joined by equal texts or an overlap of at least 0.8."""
    parent = {i: i for i, _ in rows}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    held = [(i, t or "", shingles(t)) for i, t in rows]
    for k, (i, t, s) in enumerate(held):
        for j, u, v in held[:k]:
            if t == u or (min(sum(s.values()), sum(v.values())) >= 0.8 * max(sum(s.values()), sum(v.values()), 1) and overlap(s, v) >= 0.8):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in rows}


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(8)
    gaps = []
    for trial in range(60):
        a = [f"{trial}-{i}" for i in rng.integers(0, 25, 60)]
        b = a[:45] + [f"{trial}-{i}" for i in rng.integers(0, 25, 15)]
        for _, _, data, offsets in tv.chunks(pa.array([" ".join(a), " ".join(b)])):
            row, value, count = tv.multiset(*tv.shingles(data, offsets, 1))
            points = near_dup.bag_minhash(row, value, count, 2, 512)
        gaps.append((points[0] == points[1]).mean() - overlap(Counter(a), Counter(b)))
    assert abs(np.mean(gaps)) < 0.01
    assert np.std(gaps) < 0.035


def test_groups_against_brute_force(spark):
    rng = random.Random(9)
    base = [[f"v{rng.randrange(3000)}" for _ in range(120)] for _ in range(8)]
    rows = []
    for words in base:
        for _ in range(6):
            w = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
            rows.append(" ".join(w))
    rows += ["De " * 300, "De " * 290, "De " * 200, "", None, "a b", "a b", "a b c d e", "a b c d f", "x" * 50]
    rows = list(enumerate(rows, 1))
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
    found = {r["doc_id"]: r["group_id"] for r in near_dup.near_duplicates(spark, df).collect()}
    assert found == brute_groups(rows)
    kept = near_dup.keep_first(spark, df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(found.values()))


def test_groups_of_real_texts(spark):
    docs = table(spark, LARGER, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = {r["doc_id"]: r["group_id"] for r in near_dup.near_duplicates(spark, docs).collect()}
    assert found == brute_groups(rows)


def test_prefix_pairs_lose_no_link(spark):
    rng = random.Random(2)
    base = [f"v{i}" for i in range(100)]
    texts = []
    for _ in range(25):
        w = list(base)
        for _ in range(rng.choice([1, 3, 6])):
            w[rng.randrange(100)] = f"q{rng.randrange(50)}"
        texts.append(" ".join(w))
    ids = list(enumerate(texts))
    df = spark.createDataFrame(ids, "node long, text string")
    left = spark.createDataFrame([(i, i) for i, _ in ids], "node long, component long")
    named = {(r["lead"], r["node"]) for r in near_dup.prefix_pairs(spark, df, left, 0.8).collect()}
    linked = {(i, j) for i, t in ids for j, u in ids if i < j and overlap(shingles(t), shingles(u)) >= 0.8}
    assert linked
    assert linked <= named


@pytest.mark.parametrize("members", [512, 3])
def test_leaders_of_many_members(spark, monkeypatch, members):
    """A large group of near copies costs about one comparison a member, however its leader's text is dealt out."""
    monkeypatch.setattr(near_dup, "MEMBERS", members)
    rng = random.Random(11)
    base = [f"v{i}" for i in range(150)]
    rows = [(k, " ".join(w if rng.random() > 0.01 else f"q{rng.randrange(9999)}" for w in base)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in near_dup.near_duplicates(spark, df).collect()} == brute_groups(rows)
    texts = df.withColumnRenamed("doc_id", "node")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(7, 3), (8, 3)], "lead long, node long")
    found = {(r["a"], r["b"]): r["similarity"] for r in near_dup.overlaps(spark, texts, pairs).collect()}
    assert len(found) == 61
    assert all(abs(x - overlap(shingles(rows[a][1]), shingles(rows[b][1]))) < 1e-12 for (a, b), x in found.items())


def test_group_edge_rows(spark, edges):
    rows = near_dup.near_duplicates(spark, edges).collect()
    assert len(rows) == edges.count()
    same = {r["group_id"] for r in rows if r["doc_id"] in (1, 4)}
    assert same == {1}
    assert {r["class_id"] for r in rows if r["doc_id"] in (2, 3)} == {2}
    assert near_dup.near_duplicates(spark, edges.limit(0)).count() == 0
    assert near_dup.keep_first(spark, edges).where("doc_id = 4").count() == 0


def test_null_and_repeated_ids(spark):
    """Texts are told apart by content: an id that repeats with another text loses nothing, a near copy without id is found."""
    rng = random.Random(12)
    long = [" ".join(f"{name}{rng.randrange(500)}" for _ in range(100)) for name in "abcd"]
    near = [t.rsplit(" ", 2)[0] + f" x{k}" for k, t in enumerate(long)]
    rows = [(1, long[0]), (1, long[1]), (1, long[1]), (None, near[1]), (2, near[0]), (None, long[2]), (None, near[2]), (None, near[2]), (3, long[3]), (None, long[3]), (None, None), (4, "")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, `odd.name` int")
    found = [(r["doc_id"], r["group_id"]) for r in near_dup.near_duplicates(spark, df).collect()]
    assert len(found) == len(rows)
    assert sorted(g for d, g in found if d is None and g is not None) == [1, 3, 4]
    assert sum(g is None for _, g in found) == 3
    kept = near_dup.keep_first(spark, df)
    assert kept.columns == df.columns
    held = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(map(str, held)) == sorted(map(str, [(1, long[0]), (1, long[1]), next(h for h in held if h[0] is None), (3, long[3]), (4, "")]))
    assert next(h[1] for h in held if h[0] is None) in (long[2], near[2])


def test_nearest_recall(spark):
    vectors = table(spark, LARGER, "embeddings").toPandas()
    x, ids = np.stack(vectors["embedding"]).astype(float), vectors["vec_id"].to_numpy()
    found = ann.nearest(spark, table(spark, LARGER, "embeddings")).toPandas()
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        order = [ids[k] for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        mine = found[found["query_id"] == q].sort_values("rank")
        assert len(set(order) & set(mine["vec_id"])) >= 18
        assert np.allclose(mine["score"], [score[ids == v][0] for v in mine["vec_id"]])


def test_nearest_edge_rows(spark):
    v = [1.0, 0.0, 0.5]
    rows = [(0, v), (20, v), (20, v), (1, v), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, [1.0, 1.0]), (None, v), (40, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(spark, df).collect())
    assert found == [(0, 1, 1), (0, 2, 20), (0, 3, 20), (0, 4, 40), (20, 1, 0), (20, 2, 1), (20, 3, 40), (40, 1, 0), (40, 2, 1), (40, 3, 20), (40, 4, 20)]
    assert ann.nearest(spark, df.limit(0)).count() == 0


def test_nearest_in_double_precision_and_of_any_length(spark):
    """Double vectors keep their precision; vectors of a rare length are searched among themselves; copies are whole."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=3)]) for k in range(60)] + [(100 + k, [float(x) for x in rng.normal(size=2)]) for k in range(5)]
    rows += [(20, [0.1, 0.2, 0.3])] + [(61, [0.3, 0.7, 0.1])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(spark, df).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in {i for i, _ in rows if i % 20 == 0}:
        expected = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for j, v in rows if j == q for i, w in rows if i != q and len(v) == len(w)))[:20]
        assert [i for i, _ in found[q]] == [i for _, i in expected]
        assert np.abs(np.array([s for _, s in found[q]]) + [s for s, _ in expected]).max() < 1e-12


def test_codes_bound_inner_products():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    centre, turn = x.mean(0).astype(float), ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-9)
    bits, far, held = ann.encode(x, centre, turn)
    q = (x[0] - centre) @ turn
    guess = ann.signs(bits, 64) @ q * far / held
    true = (x - centre) @ (x[0] - centre)
    spread = np.linalg.norm(q) * far * np.sqrt(1 - held**2) / held / np.sqrt(63)
    assert (np.abs(guess - true)[1:] <= ann.BOUND * spread[1:] + 1e-3).mean() > 0.99
    assert abs(np.mean((guess - true)[1:])) < 1.0


def test_pipeline_stages(spark):
    """Each stage does to its own input what its operator says."""
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dup", "pii", "mixing", "bpe"]
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SMALL)
        docs = docs.cache()
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if name == "near_dup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in docs.collect()} == set(brute_groups(rows).values())
        if name == "pii":
            assert docs.where("text RLIKE '[a-z0-9]@[a-z0-9-]+[.][a-z]'").count() == 0
    assert sizes == sorted(sizes, reverse=True)
    assert sizes[-1] > 0
    encoder = bpe.load(open(__import__("public_tokenizers").path("word_bpe_49k.json"), encoding="utf-8").read())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(r["ids"] == encoder.encode(texts[r["doc_id"]]) for r in docs.collect())


@pytest.mark.parametrize("name", ["op1_toxicity", "op9_quality"])
def test_contract_columns(spark, name):
    from quillspan.llm.queries import QUERIES

    df = QUERIES[name](spark, SMALL)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert df.count() == table(spark, SMALL, "documents").count()
