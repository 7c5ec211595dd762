"""The feedback log as a stream: reviewed pairs fold into running label counts as files arrive.

The engine itself is batch; this reads the same append-only log with the same rules as ``load_feedback``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.normalize import clean
from quillspan.sources.registries import FEEDBACK, LABELS


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """A stream of valid decisions: trimmed lower-case labels, both ids there."""
    rows = spark.readStream.schema(FEEDBACK).parquet(path)
    rows = rows.select(clean(F.col("record_a")).alias("record_a"), clean(F.col("record_b")).alias("record_b"), F.lower(F.trim("label")).alias("label"))
    return rows.where(F.col("label").isin(*LABELS) & (F.col("record_a") != "") & (F.col("record_b") != ""))


def label_counts(stream: DataFrame) -> DataFrame:
    """Running decisions of each label; state is one row a label."""
    return stream.groupBy("label").count()
