"""Deviation scores, the ensemble, the frozen bundle and scoring of single people."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import income as X
from quillspan.operators import forest as iso
from quillspan.operators.ranking import align, percent_rank_columns, shares_at_most
from quillspan.sources.registries import exists
from quillspan.sources.shared import materialise

IF_WEIGHT = 0.7
RATIOS = [f for f in X.MODEL_FEATURES if f != "is_filer"]


@dataclass
class Bundle:
    """M6: the forest over all model features, its score range, and the population it was fitted on."""

    forest: iso.Forest
    low: float
    high: float
    population: DataFrame

    def save(self, spark: SparkSession, path: str) -> None:
        self.population.write.mode("overwrite").parquet(f"{path}/population")
        text = json.dumps({"forest": self.forest.to_json(), "low": self.low, "high": self.high})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bundle:
        if not exists(spark, f"{path}/model"):
            raise FileNotFoundError(f"no model at {path}: run the scoring stage first")
        held = json.loads(spark.read.text(f"{path}/model").first()["value"])
        return Bundle(iso.Forest.from_json(held["forest"]), held["low"], held["high"], spark.read.parquet(f"{path}/population"))


def _inputs(names: list[str]) -> dict:
    return {n: X.model_input(n) for n in names}


def minmax(value: Column, low: float, high: float) -> Column:
    """X14, unrounded."""
    return 100 * (value - low) / (high - low + 1e-9)


def score(spark: SparkSession, features: DataFrame) -> tuple[DataFrame, Bundle]:
    """Deviation of own ratios and of own and network ratios, with reasons; and the bundle for later people."""
    people = materialise(spark, X.engineer(features), "engineered")
    scored, bounds = people, {}
    for name, columns in (("own", X.OWN_FEATURES), ("all", X.MODEL_FEATURES)):
        trees = iso.fit(people, _inputs(columns))
        scored = scored.withColumn(f"_{name}", iso.anomaly(trees, _inputs(columns)))
        bounds[name] = trees
    scored = materialise(spark, scored, "anomalies")
    ends = scored.agg(*[f(f"_{n}").alias(f"{n}_{k}") for n in bounds for k, f in (("low", F.min), ("high", F.max))]).first()
    for name in bounds:
        scored = scored.withColumn(f"_{name}", F.bround(minmax(F.col(f"_{name}"), ends[f"{name}_low"] or 0.0, ends[f"{name}_high"] or 0.0), 1))
    scored = percent_rank_columns(spark, scored, {r: f"_p_{r}" for r in RATIOS})
    trail = X.audit_trail({r: F.col(f"_p_{r}") for r in RATIOS})
    long = lambda c: F.col(c).cast("long")
    out = scored.select("entity_id", F.col("_all").alias("deviation_score"), F.col("_own").alias("deviation_score_own"), long("implied_income").alias("implied_income"), long("declared_income").alias("declared_income"), long("tax_paid").alias("tax_paid"), F.col("is_filer").cast("int").alias("is_filer"), long("network_nonfiler_asset_value").alias("network_nonfiler_assets"), F.col("network_neighbor_count").cast("int").alias("network_neighbors"), F.to_json(trail).alias("audit_trail"))
    return materialise(spark, out, "scores"), Bundle(bounds["all"], ends["all_low"] or 0.0, ends["all_high"] or 0.0, people.select("entity_id", *X.MODEL_FEATURES))


def score_people(spark: SparkSession, people: DataFrame, bundle: Bundle, key: str = "person") -> DataFrame:
    """M6: any number of people on the frozen model; scores are clipped to 0..100. Percentiles are shares of the population
    at most as large (W2), from cumulative counts of both; no person meets the population."""
    rows = X.engineer(X.feature_row(people))
    rows = rows.withColumn("deviation_score", F.bround(F.least(F.greatest(minmax(iso.anomaly(bundle.forest, _inputs(bundle.forest.features)), bundle.low, bundle.high), F.lit(0.0)), F.lit(100.0)), 1))
    rows = materialise(spark, rows, "people")
    rows = shares_at_most(spark, bundle.population, rows, {r: f"_p_{r}" for r in RATIOS})
    trail = X.audit_trail({r: F.col(f"_p_{r}") for r in RATIOS})
    return rows.select(key, "deviation_score", X.verdict(F.col("deviation_score")).alias("verdict"), "implied_income", "declared_income", trail.alias("audit_trail"))


def ensemble(spark: SparkSession, scores: DataFrame, relational: DataFrame | None, weight: float = IF_WEIGHT) -> DataFrame:
    """The relational score (the forest's where there is none), aligned, blended, and aligned again."""
    base = scores.drop("gnn_score", "deviation_score_combined")
    if relational is None:
        return base.withColumn("gnn_score", F.col("deviation_score")).withColumn("deviation_score_combined", F.col("deviation_score"))
    both = base.join(relational.select("entity_id", "gnn_score"), "entity_id", "left").withColumn("gnn_score", F.coalesce("gnn_score", "deviation_score"))
    both = align(spark, materialise(spark, both, "both"), "gnn_score", "deviation_score", "_aligned")
    both = both.withColumn("_blend", weight * F.col("deviation_score") + (1 - weight) * F.col("_aligned")).drop("_aligned")
    both = align(spark, materialise(spark, both, "blend"), "_blend", "deviation_score", "_final").drop("_blend")
    return both.withColumn("deviation_score_combined", F.bround("_final", 1)).drop("_final")
