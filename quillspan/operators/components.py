"""G1: connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.sources.shared import discard, materialise

MAX_ROUNDS = 60


def connected_components(spark: SparkSession, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node that occurs in ``edges``; the component is its smallest node.

    Nulls in either column drop the edge, self loops only register their node, repeated edges count once, and an
    empty input gives an empty result. Each round takes the least label among the neighbours (an aggregate with
    map-side combine, so a hub costs no more than its edges), then follows labels to their own label, and writes
    the labels to the shared folder. Links stay distributed; the driver sees one changed-row count a round.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(spark, both, "edges")
    labels = materialise(spark, both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    held = labels
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        far = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        new = low.join(far, "low", "left").select("node", F.least("low", "jump").alias("label"), "was")
        new = materialise(spark, new, "labels")
        moved = new.where("label <> was").limit(1).count()
        discard(spark, held)
        held, labels = new, new.select("node", "label")
        if not moved:
            discard(spark, both)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
