"""Stated records matched against the block index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.blocking import block_keys
from quillspan.operators.linkage import Model, compare
from quillspan.sources.registries import unified

TOP = 8
QUERY = "query_id string, name string, father_name string, cnic string, phone string, address string, dob string, city string"


def query_records(queries: DataFrame) -> DataFrame:
    """Ad-hoc queries as unified records; missing fields are unobserved."""
    text = lambda c: (F.col(c) if c in queries.columns else F.lit(None)).cast("string")
    row = queries.select(text("query_id").alias("account_id"), text("name").alias("consumer_name"), text("cnic").alias("consumer_cnic"), text("father_name").alias("father_name"), text("dob").alias("dob"), text("address").alias("address"), F.lit(0).cast("long").alias("avg_monthly_bill"), text("phone").alias("phone"), text("city").alias("city"))
    none = row.limit(0)
    shapes = {
        "vehicles": none.select(F.col("account_id").alias("record_id"), F.col("consumer_name").alias("owner_name"), F.col("consumer_cnic").alias("owner_cnic"), "father_name", "dob", "phone", "city"),
        "real_estate": none.select(F.col("account_id").alias("record_id"), F.col("consumer_name").alias("owner_name"), F.col("consumer_cnic").alias("owner_cnic"), "father_name", "dob", F.col("address").alias("household"), "city"),
        "utilities": row,
        "travel": none.select(F.col("account_id").alias("record_id"), F.col("consumer_name").alias("passenger_name"), F.col("consumer_cnic").alias("passport_cnic"), "father_name", "dob", "city"),
        "tax_returns": none.select(F.col("account_id").alias("return_id"), F.col("consumer_name").alias("filer_name"), F.col("consumer_cnic").alias("filer_cnic"), "father_name", "dob", "city"),
    }
    return unified(shapes)


def match(spark: SparkSession, queries: DataFrame, records: DataFrame, index: DataFrame, mentions: DataFrame, model: Model, top: int = TOP) -> DataFrame:
    """For each query the ``top`` entities by the best posterior of any of their records that share a block with it. No veto
    and no threshold; blocks have no size limit here."""
    asked = query_records(queries)
    keys = asked.select(F.col("record_id").alias("a"), F.explode(block_keys()).alias("key"))
    pairs = keys.join(index.select("key", F.col("record_id").alias("b")), "key").select("a", "b").distinct()
    both = asked.withColumn("record_id", F.concat(F.lit("query:"), F.col("record_id"))).unionByName(records.select(*asked.columns))
    scored = compare(pairs.withColumn("a", F.concat(F.lit("query:"), F.col("a"))), both)
    scored = scored.withColumn("probability", model.posterior(model.score(F.col("bands")))).join(mentions.select(F.col("record_id").alias("b"), "entity_id"), "b")
    best = scored.groupBy("a", "entity_id").agg(F.max(F.struct("probability", F.col("b").alias("record_id"), F.col("raw_name_b").alias("name"), "bands")).alias("x"))
    from pyspark.sql import Window

    order = Window.partitionBy("a").orderBy(F.desc("x.probability"), "entity_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(F.substring("a", 7, 1000).alias("query_id"), "rank", "entity_id", F.col("x.probability").alias("posterior"), F.col("x.record_id").alias("record_id"), F.col("x.name").alias("name"), F.array_join("x.bands", "|").alias("evidence"))
