"""Scorecards against ground truth. Only this module reads truth tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.ranking import at_top, average_precision


def pair_counts(found: DataFrame, truth: DataFrame, item: str, cluster: str, label: str) -> DataFrame:
    """One row: pairwise precision, recall, F1, and purity. Pairs are counted from group sizes, not built."""
    both = found.select(item, cluster).join(truth.select(item, label), item)
    cells = both.groupBy(cluster, label).agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    hits = cells.agg(F.sum(pairs(F.col("n"))).alias("tp"))
    of_cluster = cells.groupBy(cluster).agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    made = of_cluster.agg(F.sum(pairs(F.col("n"))).alias("made"), F.avg(F.col("top") / F.col("n")).alias("purity"), F.count("*").alias("entities"))
    real = cells.groupBy(label).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("real"))
    row = hits.join(made).join(real)
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0.0)), F.lit(0.0))
    row = row.withColumns({"precision": ratio("tp", "made"), "recall": ratio("tp", "real")})
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return row.select("entities", "precision", "recall", f1.alias("f1"), "purity")


def majority(found: DataFrame, truth: DataFrame) -> DataFrame:
    """The person that most records of an entity belong to (ties: the least id)."""
    counts = found.join(truth, "record_id").groupBy("entity_id", "person_id").count()
    return counts.groupBy("entity_id").agg(F.min_by("person_id", F.struct(-F.col("count"), "person_id")).alias("person_id"))


def detection(scores: DataFrame, mentions: DataFrame, linkage: DataFrame, persons: DataFrame, score: str) -> dict[str, float]:
    """Average precision, precision and recall of the top quarter, and recall of principals there."""
    truth = persons.select("person_id", F.coalesce("is_evader", F.lit(False)).alias("evader"), (F.col("role") == "principal").alias("principal"))
    rows = scores.join(majority(mentions, linkage), "entity_id", "left").join(truth, "person_id", "left").na.fill(False)
    rows = rows.select("entity_id", F.col(score).alias("score"), "evader", "principal").cache()
    top, heads = at_top(rows, "score", "evader", "entity_id").first(), at_top(rows, "score", "principal", "entity_id").first()
    ap = average_precision(rows, "score", "evader", "entity_id").first()["average_precision"]
    rows.unpersist()
    return {"average_precision": ap, "precision_at_25": top["precision"] or 0.0, "recall_at_25": top["recall"] or 0.0, "principal_recall_at_25": heads["recall"] or 0.0}
