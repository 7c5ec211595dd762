"""Entity resolution end to end: tiers, canonical mentions and match evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.operators.linkage import Embedder, Linked, hashed_ngrams, promote, tier1, tier2
from quillspan.operators.split import split
from quillspan.sources.shared import materialise


def mentions(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row a record; entity names become contiguous numbers in the order of the names."""
    numbers = clusters.select("entity_id").distinct().withColumn("n", (F.row_number().over(Window.orderBy("entity_id")) - 1).cast("int"))
    held = records.join(clusters, "record_id").join(numbers, "entity_id")
    return held.select("record_id", F.col("registry").alias("source"), "raw_name", "norm_name", F.nullif("dob", F.lit("")).alias("dob"), F.col("cnic.digits").alias("cnic"), "city", F.col("n").alias("entity_id"), "ord")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """A13, by an aggregate and a join rather than a window, so that a large entity is summed before it moves."""
    return clusters.join(clusters.groupBy("entity_id").agg(F.count("*").cast("int").alias("cluster_size")), "entity_id").select("record_id", "entity_id", "cluster_size")


def population_counts(mentions: DataFrame, features: DataFrame) -> DataFrame:
    """One row ``n_records, n_entities, n_non_filers``; an entity without a filer flag files nothing."""
    entities = mentions.agg(F.count("*").alias("n_records"), F.count_distinct("entity_id").alias("n_entities"))
    filing = features.agg(F.count_if(F.coalesce(F.col("is_filer").cast("int"), F.lit(0)) == 0).alias("n_non_filers"))
    return entities.join(F.broadcast(filing))


def resolve(spark: SparkSession, records: DataFrame, feedback: DataFrame | None = None, embed: Embedder | None = hashed_ngrams) -> tuple[DataFrame, Linked]:
    """``mentions`` and the last tier's state; without an embedder the second tier is left out."""
    state = tier1(spark, records, feedback)
    if embed is not None:
        state = tier2(spark, records, state, embed)
    state = split(spark, records, promote(spark, records, state))
    return materialise(spark, mentions(records, state.clusters), "mentions"), state
