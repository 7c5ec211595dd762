"""The linkage pipeline on a generated population: thresholds, metamorphic checks, and the wall around the truth."""

from __future__ import annotations

import gc
import inspect
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import income as X
from quillspan.operators import audit, evaluate, forest, graph, live, ranking, relational, resolve, scoring, synth
from quillspan.operators.components import connected_components
from quillspan.plans import pipeline
from quillspan.sources import registries as R
from quillspan.sources import shared

PEOPLE = 700


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("population"))
    synth.generate(spark, folder, PEOPLE)
    return folder, pipeline.run(spark, f"{folder}/observable")


def test_linkage_quality(spark, built):
    folder, out = built
    truth = spark.read.parquet(f"{folder}/truth/record_linkage.parquet")
    row = evaluate.pair_counts(out["mentions"], truth, "record_id", "entity_id", "person_id").first()
    assert row["precision"] >= 0.95
    assert row["recall"] >= 0.90
    assert row["purity"] >= 0.97
    assert PEOPLE * 0.95 <= row["entities"] <= 1.3 * PEOPLE
    assert out["mentions"].count() == truth.count()


def test_scripted_people_stay_apart(spark, built):
    folder, out = built
    truth = spark.read.parquet(f"{folder}/truth/record_linkage.parquet")
    last = PEOPLE - len(synth.EDGE_PEOPLE)
    found = out["mentions"].join(truth, "record_id").select("person_id", "entity_id").distinct().collect()
    of = lambda k: {r["entity_id"] for r in found if r["person_id"] == f"P{last + k:07d}"}
    assert of(1)
    assert not of(1) & of(2)  # father and son of one name at one address
    assert not of(3) & of(4)  # twins
    scores = {r["entity_id"]: r["deviation_score"] for r in out["scores"].collect()}
    assert max(scores[e] for e in of(0)) > max(scores[e] for e in of(5))  # the same assets, declared or not


def test_detection_quality(spark, built):
    folder, out = built
    truth, people = (spark.read.parquet(f"{folder}/truth/{t}.parquet") for t in ("record_linkage", "persons"))
    own, both, final = (evaluate.detection(out["scores"], out["mentions"], truth, people, c) for c in ("deviation_score_own", "deviation_score", "deviation_score_combined"))
    assert both["average_precision"] >= 0.55
    assert both["precision_at_25"] >= 0.55
    assert both["principal_recall_at_25"] > own["principal_recall_at_25"]
    assert final["principal_recall_at_25"] >= 0.6
    scores = out["scores"].agg(F.min("deviation_score").alias("a"), F.max("deviation_score").alias("b")).first()
    assert scores["a"] >= 0
    assert scores["b"] > 80


def test_every_entity_has_reasons_features_and_floors(built):
    _, out = built
    entities = out["mentions"].select("entity_id").distinct().count()
    assert out["features"].count() == out["scores"].count() == out["floors"].count() == entities
    assert out["scores"].where("audit_trail IS NULL OR audit_trail = '[]'").count() == 0
    gaps = out["floors"].where("band = 'high'").agg(F.min("tax_gap_pkr").alias("g")).first()["g"]
    assert gaps is None or gaps > 0


def test_notices(built):
    _, out = built
    row = out["audits"].select("entity_id", "links", "records", audit.notice().alias("text")).first()
    assert audit.URDU_TITLE in row["text"]
    assert len(row["records"]) > 0
    assert out["audits"].count() == 25


def test_single_scores(spark, built):
    _, out = built
    base = {"max_vehicle_cc": 3000.0, "total_vehicle_value": 25e6, "total_property_value": 60e6, "max_monthly_bill": 400e3, "intl_trips": 6.0}
    people = [{"person": "evader", **base, "declared_income": 0.0}, {"person": "compliant", **base, "declared_income": 40e6}, {"person": "linked", "declared_income": 0.0, "network_nonfiler_asset_value": 80e6, "network_neighbor_count": 3.0}, {"person": "alone", "declared_income": 0.0}, {"person": "extreme", **{k: 1e12 for k in base}, "declared_income": 0.0}]
    df = spark.createDataFrame([{**X.DEFAULTS, **p} for p in people])
    rows = {r["person"]: r for r in scoring.score_people(spark, df, out["bundle"]).collect()}
    assert rows["evader"]["deviation_score"] >= 60
    assert rows["evader"]["deviation_score"] - rows["compliant"]["deviation_score"] >= 30
    assert rows["linked"]["deviation_score"] > rows["alone"]["deviation_score"]
    assert all(0 <= r["deviation_score"] <= 100 for r in rows.values())
    assert rows["evader"]["audit_trail"][0] == X.NO_RETURN_REASON


def test_batch_and_single_scores_agree(spark, built):
    _, out = built
    some = ranking.every_nth(out["features"], "entity_id", 12)
    again = scoring.score_people(spark, some.withColumnRenamed("entity_id", "person").select("person", *X.DEFAULTS), out["bundle"]).select(F.col("person").alias("entity_id"), F.col("deviation_score").alias("again"))
    gaps = out["scores"].join(again, "entity_id").select(F.abs(F.col("deviation_score") - F.col("again")).alias("d")).toPandas()["d"]
    assert len(gaps) == 12
    # A filer who declared nothing is a filer in the batch, and by the same rule a filer here.
    assert gaps.max() <= 0.2


def test_live_match(spark, built):
    _, out = built
    known = out["records"].where("registry = 'utilities' AND cnic.digits IS NOT NULL").orderBy("record_id").first()
    asked = spark.createDataFrame([("q", known["raw_name"], known["cnic"]["digits"], "Lahore"), ("none", "", "", "")], "query_id string, name string, cnic string, city string")
    rows = live.match(spark, asked, out["records"], out["index"], out["mentions"], out["model"]).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in rows} == {"q"}
    assert len(rows) <= live.TOP
    found = [r["posterior"] for r in rows]
    assert found == sorted(found, reverse=True)
    assert rows[0]["posterior"] > 0.95


def test_feedback(spark, tmp_path, built):
    _, out = built
    path = str(tmp_path / "feedback")
    assert R.load_feedback(spark, path).count() == 0
    with pytest.raises(ValueError, match="label"):
        R.append_decision(spark, path, "a", "b", "maybe")
    a, b = (r["record_id"] for r in out["records"].orderBy("record_id").limit(2).collect())
    R.append_decision(spark, path, a, b, "different")
    R.append_decision(spark, path, a, " ", "same")
    assert [tuple(r) for r in R.load_feedback(spark, path).collect()] == [(a, b, "different")]
    from quillspan.operators import linkage

    model = linkage.fit(spark, out["records"], 1000, R.load_feedback(spark, path), anchors=200, randoms=500)
    assert model.stats["feedback_nonmatches"] == 1
    assert model.weights["cnic_exact"] == 8.0


def test_wall():
    for module in (scoring, live, audit, pipeline):
        assert "truth" not in inspect.getsource(module)
    assert not {"is_evader", "true_income", "role", "person_id"} & {c for s in R.SCHEMAS.values() for c in s.names}


def test_missing_bundle(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="scoring stage"):
        scoring.Bundle.load(spark, str(tmp_path))


def test_components_cases(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 5), (7, None), (None, None), (9, 8), (9, 8)], "src long, dst long")
    assert sorted(map(tuple, connected_components(spark, edges).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (8, 8), (9, 8)]
    chain = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    assert connected_components(spark, chain).select("component").distinct().collect()[0][0] == 0
    assert connected_components(spark, edges.limit(0)).count() == 0


def test_ranks_against_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 40, 300) / 4, rng.normal(size=300)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "k long, a double, b double")
    rows = ranking.align(spark, df, "a", "b", "c").orderBy("k").toPandas()
    rank = np.array([(np.sum(a < x) + (np.sum(a == x) + 1) / 2) / len(a) for x in a])
    assert np.allclose(rows["c"], np.quantile(np.sort(b), rank), atol=1e-9)


def test_forest_finds_the_odd_one():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(500, 3)), [[9.0, 9.0, 9.0]]])
    trees = [forest.grow(x[rng.choice(len(x), 256, replace=False)], rng) for _ in range(50)]
    model = forest.Forest(["a", "b", "c"], 256, trees)
    scores = model.anomaly(x)
    assert scores.argmax() == 500
    again = forest.Forest.from_json(model.to_json()).anomaly(x)
    assert np.array_equal(scores, again)


def test_empty_registries(spark):
    empty = {k: spark.createDataFrame([], s) for k, s in R.SCHEMAS.items()}
    assert R.unified(empty).count() == 0
    assert R.field_index(empty).count() == 0


def test_feedback_stream(spark, tmp_path):
    from quillspan.streaming import feedback

    path = str(tmp_path / "log")
    R.append_decision(spark, path, "a", "b", "same")
    query = feedback.label_counts(feedback.decisions(spark, path)).writeStream.outputMode("complete").format("memory").queryName("labels_seen").start()
    try:
        query.processAllAvailable()
        R.append_decision(spark, path, "a", "c", "same")
        R.append_decision(spark, path, "", "c", "different")
        query.processAllAvailable()
        assert [tuple(r) for r in spark.table("labels_seen").collect()] == [("same", 2)]
    finally:
        query.stop()


def test_shares_and_ranks_against_counting(spark):
    population = [3.0, 1.0, 1.0, None, 7.0, 1.0, 0.0]
    wanted = [-1.0, 0.0, 1.0, 2.0, 7.0, 9.0, None, 1.0]
    held = [x for x in population if x is not None]
    people = spark.createDataFrame([(k, x, x) for k, x in enumerate(wanted)], "k int, x double, name double")
    many = spark.createDataFrame([(x, x) for x in population], "x double, name double")
    rows = {r["k"]: r for r in ranking.shares_at_most(spark, many, people, {"x": "s", "name": "t"}).collect()}
    assert len(rows) == len(wanted)
    for k, x in enumerate(wanted):
        share = None if x is None else sum(v <= x for v in held) / len(held)
        assert rows[k]["s"] == rows[k]["t"] == (None if share is None else pytest.approx(share))
    none = ranking.shares_at_most(spark, many.where("false"), people, {"x": "s"})
    assert [r["s"] for r in none.collect()] == [None] * len(wanted)
    ranks = {r["x"]: r["r"] for r in ranking.percent_rank_columns(spark, many, {"x": "r", "name": "q"}).collect()}
    assert ranks == {None: None, **{v: pytest.approx((sum(w < v for w in held) + (held.count(v) + 1) / 2) / len(held)) for v in held}}


def test_tolerant_reads_and_marked_files(spark, tmp_path):
    schema = "a string, b string, c long"
    schema = spark.createDataFrame([], schema).schema
    folder = f"file://{tmp_path}"
    (tmp_path / "zero.csv").write_bytes(b"")
    (tmp_path / "head.csv").write_text("a,b\n")
    (tmp_path / "some.csv").write_text("﻿a,b\n1,x\n,y\n", encoding="utf-8")
    for name in ("absent.csv", "absent.parquet", "zero.csv", "head.csv"):
        empty = R.tolerant_read(spark, f"{folder}/{name}", schema)
        assert empty.columns == ["a", "b", "c"]
        assert empty.count() == 0
    assert [tuple(r) for r in R.tolerant_read(spark, f"{folder}/some.csv", schema).collect()] == [("1", "x", None), (None, "y", None)]
    R.write_table(spark.createDataFrame([("1", "x")], "a string, b string").coalesce(1), f"{folder}/out.csv", csv=True)
    (part,) = (tmp_path / "out.csv").glob("part-*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfa,b")
    assert [tuple(r) for r in R.tolerant_read(spark, f"{folder}/out.csv", schema).collect()] == [("1", "x", None)]


def test_population_counts_and_views(spark, built):
    _, out = built
    row = resolve.population_counts(out["mentions"], out["features"]).first()
    assert row["n_records"] == out["records"].count()
    assert row["n_entities"] == out["features"].count()
    assert row["n_non_filers"] == out["features"].where("NOT coalesce(cast(is_filer AS boolean), false)").count()
    assert spark.sql("SELECT count(*) AS n FROM quillspan_scores").first()["n"] == out["scores"].count()


def test_household_sums_against_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(rng.integers(0, 1000)), float(rng.integers(0, 1000)), float(k % 2), float(rng.integers(0, 1_200_000))) for k in range(60)]
    own = spark.createDataFrame([*rows, rows[0]], "entity_id int, total_property_value double, total_vehicle_value double, is_filer double, declared_income double")
    homes = spark.createDataFrame([(k, None if k % 13 == 0 else k % 5) for k in range(70)] + [(1, 1)], "entity_id int, dst int")
    wanted, found = (sorted(map(tuple, df.select(sorted(df.columns)).collect())) for df in (graph.network_features(own, graph.co_members(homes)), graph.household_features(own, homes)))
    assert found == wanted


def test_neighbour_means_against_pairs(spark):
    rng = np.random.default_rng(4)
    links = [(int(rng.integers(0, 45)), f"n{rng.integers(0, 15)}") for _ in range(120)] + [(k, "hub") for k in range(40)] + [(3, None), (None, "hub"), (900, "hub")]
    x = {k: float(v) for k, v in enumerate(rng.normal(size=50))}
    df = spark.createDataFrame(links, "entity_id int, dst string")
    values = spark.createDataFrame(list(x.items()), "entity_id int, x double")
    rows = {r["entity_id"]: r["x_1"] for r in relational.neighbour_means(df, values, ["x"], "_1").collect()}
    pairs = graph.projection(df).collect()
    assert rows.keys() == x.keys()
    for k in x:
        near = [x[k], *(x[r["q"]] for r in pairs if r["p"] == k and r["q"] in x)]
        assert rows[k] == pytest.approx(sum(near) / len(near))
    many = spark.range(30_000).selectExpr("CAST(id AS INT) AS entity_id", "'one' AS dst", "CAST(id AS DOUBLE) AS x")
    assert relational.neighbour_means(many, many, ["x"], "_1").where("abs(x_1 - 14999.5) < 1e-6").count() == 30_000


def test_driver_heap_is_collected_between_tables(spark, monkeypatch):
    monkeypatch.setattr(shared, "HEAP_SECONDS", 0.0)
    monkeypatch.setattr(shared, "HEAP_SHARE", 1.0)
    assert not shared.shrink_driver(spark)
    monkeypatch.setattr(shared, "HEAP_SHARE", 0.0)
    garbage = spark.sparkContext._jvm.java.lang.Object()
    seen = spark.sparkContext._jvm.java.lang.ref.WeakReference(garbage)
    del garbage
    gc.collect()
    assert shared.materialise(spark, spark.range(3), "three").count() == 3
    assert seen.get() is None


def test_driver_gives_back_what_is_free(spark, monkeypatch):
    """Memory freed outside the heap is trimmed even where the heap is small; a collection leaves little of the heap free."""
    monkeypatch.setattr(shared, "HEAP_SECONDS", 0.0)
    monkeypatch.setattr(shared, "HEAP_SHARE", 1.0)
    jvm = spark.sparkContext._jvm

    def resident() -> float:
        with open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup") as file:
            return int(re.search(r"Pss_Anon:\s+(\d+)", file.read())[1]) / 1024

    shared.shrink_driver(spark)
    held = [jvm.java.util.zip.Deflater() for _ in range(1200)]
    for one in held[:-1]:
        one.end()
    before = resident()
    assert not shared.shrink_driver(spark)
    assert resident() < before - 50
    monkeypatch.setattr(shared, "HEAP_SHARE", 0.0)
    blocks = [spark.sparkContext._gateway.new_array(jvm.long, 6 << 20) for _ in range(40)]
    del blocks[14:]
    gc.collect()
    runtime = jvm.java.lang.Runtime.getRuntime()
    assert shared.shrink_driver(spark)
    assert runtime.totalMemory() < 2 * (runtime.totalMemory() - runtime.freeMemory())
