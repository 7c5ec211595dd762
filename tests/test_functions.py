"""Literals of names, identifiers, addresses, similarity, tax and scores."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.functions import income as X
from quillspan.functions import normalize as N
from quillspan.functions import similarity as P
from quillspan.operators import linkage, synth
from quillspan.operators.split import one_document, one_edit
from quillspan.sources import registries as R


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("name", ["Muhammad", "Mohammad", "Mohammed", "Muhammed", "محمد"])
def test_one_skeleton_for_all_spellings(spark, name):
    assert one(spark, N.skeleton(F.col("t")), t=name) == "mhmd"


def test_mixed_scripts_and_honorifics(spark):
    assert one(spark, N.name_skeletons(F.col("t")), t="عمران Mughal") == one(spark, N.name_skeletons(F.col("t")), t="Imran Mughal")
    assert one(spark, N.name_tokens(F.col("t")), t="Dr. Imran Khan") == ["imran", "khan"]
    assert one(spark, N.name_tokens(F.col("t")), t="Haji Muhammad Akram") == ["muhammad", "akram"]
    assert one(spark, N.name_tokens(F.col("t")), t="Mr. Haji") == []
    assert one(spark, N.name_tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(("text", "expected"), [("12345-1234567-1", ("1234512345671", "12345", "1")), ("42101-XXXXXXX-7", (None, "42101", "7")), ("", (None, None, None)), ("N/A", (None, None, None)), ("123", (None, None, None)), ("nan", (None, None, None)), (None, (None, None, None))])
def test_identity_numbers(spark, text, expected):
    assert tuple(one(spark, N.normalize_cnic(F.lit(text).cast("string")))) == expected


def test_phones_and_addresses(spark):
    assert one(spark, N.normalize_phone(F.lit("+92 300 1234567"))) == "03001234567"
    assert one(spark, N.normalize_phone(F.lit("12"))) is None
    a = one(spark, N.normalize_address(F.lit("H.No. 12, St. 4, F-8/1, ISB")))
    assert (a["house"], a["street"], a["city"]) == (12, 4, "islamabad")
    assert "f-" in a["area_tokens"]
    empty = one(spark, N.normalize_address(F.lit(None).cast("string")))
    assert tuple(empty) == (None, None, [], None)


@pytest.mark.parametrize(("a", "b", "near"), [("1234512345671", "1234512345681", True), ("1234512345671", "1234512345617", True), ("1234512345671", "1234512345688", False), ("123", "1234", True), ("123", "12345", False)])
def test_one_edit(spark, a, b, near):
    assert one(spark, P.damerau1(F.col("a"), F.col("b")), a=a, b=b) is near
    assert one_edit(a, b) is near


def test_documents_one_typo_apart_are_one():
    assert len(set(one_document({"1234512345671", "1234512345617", "9999999999999"}).values())) == 2


def test_similarity_formula():
    assert P.jaro_winkler("same", "same") == 1.0
    assert P.jaro_winkler("", "x") == 0.0
    assert P.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert P.jaro_winkler("ab", "ba") == 0.0  # the window of two short strings admits no shifted match
    assert P.token_set_similarity(("imran",), ("imran", "khan")) == 1.0
    assert P.token_set_similarity(("a", "b"), ("b", "a")) == 1.0
    assert P.token_set_similarity((), ("x",)) == 0.0


def test_name_bands(spark):
    def band(x, y):
        rows = spark.createDataFrame([(x, y)], "x string, y string")
        score = F.greatest(P.token_similarity(N.name_skeletons(F.col("x")), N.name_skeletons(F.col("y"))), P.token_similarity(N.name_tokens(F.col("x")), N.name_tokens(F.col("y"))))
        return rows.select(P.band_name(score).alias("b")).first()["b"]

    assert band("Ayesha Qureshi", "Aisha Quraishi") in ("name_exact", "name_close")
    assert band("Imran Khan", "Bilal Malik") == "name_diff"


def test_birth_date_bands(spark):
    band = lambda a, b: one(spark, P.band_equal(F.lit(a).cast("string"), F.lit(b).cast("string"), "dob"))
    assert [band("1980-05-12", x) for x in ("1980-05-12", "1991-01-02", None)] == ["dob_match", "dob_diff", None]


def test_tax(spark):
    assert one(spark, X.annual_tax(F.lit(600_000))) == 0
    assert one(spark, X.annual_tax(F.lit(1_200_000))) == 30_000
    rows = [r["t"] for r in spark.range(0, 10_000_000, 250_000).select(X.annual_tax(F.col("id")).alias("t"), "id").orderBy("id").collect()]
    assert rows == sorted(rows)


@pytest.mark.parametrize(("values", "expected"), [
    ({"max_monthly_bill": 16190.0, "shared_address_neighbors": 1.0}, (1_619_000, 92_850, 92_850, 24, "low")),
    ({"max_monthly_bill": 370492.0, "max_vehicle_cc": 1984.0, "total_property_value": 156767174.0, "n_properties": 3.0, "intl_trips": 8.0}, (74_098_400, 25_199_440, 25_199_440, 99, "high")),
])
def test_golden_floors(spark, values, expected):
    columns = ["max_monthly_bill", "max_vehicle_cc", "total_property_value", "n_properties", "intl_trips", "n_vehicles", "shared_address_neighbors", "network_nonfiler_asset_value", "network_neighbor_count", "declared_income", "tax_paid", "is_filer"]
    row = X.with_floors(spark.range(1).select(*[F.lit(values.get(c, 0.0)).alias(c) for c in columns])).first()
    assert (row["estimated_income_pkr"], row["expected_tax_pkr"], row["tax_gap_pkr"], row["rule_deviation_score"], row["band"]) == expected
    assert row["notes"] == [X.NO_RETURN_NOTE]


def test_nothing_observed(spark):
    columns = ["max_monthly_bill", "max_vehicle_cc", "total_property_value", "n_properties", "intl_trips", "n_vehicles", "shared_address_neighbors", "network_nonfiler_asset_value", "network_neighbor_count", "declared_income", "tax_paid", "is_filer"]
    row = X.with_floors(spark.range(1).select(*[F.lit(None).cast("double").alias(c) for c in columns])).first()
    assert (row["factors"], row["estimated_income_pkr"], row["band"], row["filer_status"]) == ([], 0, "none", "absent")


def test_golden_implied_income(spark):
    rows = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {**X.DEFAULTS, "max_monthly_bill": 16190.0}.items()])
    assert X.rupees(F.lit(0)) is not None
    row = X.engineer(rows).select(X.rupees(F.col("implied_income")).alias("x")).first()
    assert row["x"] == "Rs 14.64 lakh"


def test_titles(spark):
    assert one(spark, X.title(F.lit("khan-ali o'neil"))) == "Khan-Ali O'Neil"


def test_token_similarities_against_the_plain_form():
    rng = random.Random(6)
    words = ["imran", "emran", "khan", "khaan", "khn", "", "é", "𐐀b", "malik", "zubayr"]
    lists = [[rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 9]))] if rng.random() < 0.95 else None for _ in range(4000)]
    a, b = lists[::2], lists[1::2]
    kind = pa.list_(pa.string())
    found = P.token_similarities(pa.array(a, kind), pa.array(b, kind))
    assert found.tolist() == [P.token_set_similarity(tuple(x or ()), tuple(y or ())) for x, y in zip(a, b, strict=True)]
    assert P.token_similarities(pa.array([], kind), pa.array([], kind)).tolist() == []


def test_comparing_takes_one_python_worker(spark):
    """A filter on the decision must not run the similarities again: each copy is a worker more for each task."""
    tables, _, _ = synth.registries(synth.population(spark, 20))
    records = R.unified(tables)
    pairs = records.select(F.col("record_id").alias("a")).crossJoin(records.select(F.col("record_id").alias("b")))
    model = linkage.Model({"name_exact": 3.0}, 0.0)
    scored = linkage.compare(pairs, records).withColumn("score", model.score(F.col("bands"))).withColumn("probability", model.posterior(F.col("score")))
    plan = linkage.route(scored).where("decision <> 'drop'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
