"""Ranks, quantile alignment, running precision, histograms and samples.

Global order statistics avoid one-task windows: values are summed to distinct values first, positions come from a range
partitioning with offsets of its parts, and only those offsets (one a partition) meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.sources.shared import materialise


def numbered(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """``name, value, n, before, total`` of distinct ``name, value, n``: rows below the value and all rows, for each name."""
    parts = materialise(spark, counts.repartitionByRange("name", "value").withColumn("part", F.spark_partition_id()), "values")
    sums = parts.groupBy("name", "part").agg(F.sum("n").alias("held"), F.min("value").alias("least"))
    whole, below = Window.partitionBy("name"), Window.partitionBy("name").orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("name", "part", F.coalesce(F.sum("held").over(below), F.lit(0)).alias("offset"), F.sum("held").over(whole).alias("total"))
    inside = Window.partitionBy("name", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), ["name", "part"])
    return placed.select("name", "value", "n", (F.col("inner") + F.col("offset")).alias("before"), "total")


def numbered_values(spark: SparkSession, df: DataFrame, value: str) -> DataFrame:
    """``value, n, before, total``: each distinct non-null value, its rows, rows below it, and all rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return numbered(spark, counts.select(F.lit(value).alias("name"), "value", "n")).select(F.col("value").alias(value), "n", "before", "total")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``name, value, n`` of the distinct non-null values of some columns, as doubles, from one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))


def _attach(df: DataFrame, places: DataFrame, outs: dict[str, str]) -> DataFrame:
    """``df`` with the ``place`` of each column's value (``name, value, place``) under its new name."""
    for column, out in outs.items():
        own = places.where(F.col("name") == column).select(F.col("value").alias(f"_v_{out}"), F.col("place").alias(out))
        df = df.join(own, F.col(column).cast("double") == F.col(f"_v_{out}"), "left").drop(f"_v_{out}")
    return df


def percent_rank_columns(spark: SparkSession, df: DataFrame, outs: dict[str, str]) -> DataFrame:
    """W1 for several columns (column -> new column), whose values are ordered together in one shuffle."""
    place = (F.col("before") + (F.col("n") + 1) / 2) / F.col("total")
    return _attach(df, materialise(spark, numbered(spark, value_counts(df, list(outs))).select("name", "value", place.alias("place")), "places"), outs)


def percent_rank_average(spark: SparkSession, df: DataFrame, value: str, out: str) -> DataFrame:
    """Average rank over the number of rows; null values have a null rank."""
    places = numbered_values(spark, df, value).select(value, ((F.col("before") + (F.col("n") + 1) / 2) / F.col("total")).alias(out))
    return df.join(places, value, "left").select(*df.columns, out)


def shares_at_most(spark: SparkSession, population: DataFrame, people: DataFrame, outs: dict[str, str]) -> DataFrame:
    """``people`` with, for each column (column -> new column), the share of a population that is at most as large.

    Wanted values join the population's distinct values with no rows of their own, so one ordered pass places both; a null
    value and an empty population have a null share.
    """
    wanted = value_counts(people, list(outs)).select("name", "value", F.lit(0).cast("long").alias("n"))
    counts = value_counts(population, list(outs)).unionByName(wanted).groupBy("name", "value").agg(F.sum("n").alias("n"))
    place = (F.col("before") + F.col("n")) / F.nullif(F.col("total"), F.lit(0))
    return _attach(people, materialise(spark, numbered(spark, counts).select("name", "value", place.alias("place")), "places"), outs)


def align(spark: SparkSession, df: DataFrame, source: str, reference: str, out: str) -> DataFrame:
    """``source`` mapped to the reference column's quantile at its own average rank, by linear interpolation."""
    ranked = percent_rank_average(spark, df, source, "_rank")
    places = numbered_values(spark, df, reference).select(F.col(reference).alias("v"), F.col("before").alias("first"), (F.col("before") + F.col("n") - 1).alias("last"), "total")
    # A place between two neighbours needs both; runs of equal values are held by their first and last place.
    total = places.agg(F.max("total").alias("t"))
    at = ranked.join(F.broadcast(total)).withColumn("_at", F.least(F.greatest(F.col("_rank") * (F.col("t") - 1), F.lit(0.0)), (F.col("t") - 1).cast("double")))
    at = at.withColumn("_low", F.floor("_at")).withColumn("_high", F.least(F.floor("_at") + 1, F.col("t") - 1)).drop("t", "_rank")
    wanted = at.select(F.col("_low").alias("p")).union(at.select("_high")).distinct()
    # Runs are disjoint, so the last run that starts at or before a place holds it: an ordered scan by ranges of places.
    marks = places.select(F.col("first").alias("p"), "v").withColumn("mark", F.lit(0)).unionByName(wanted.select("p", F.lit(None).cast("double").alias("v"), F.lit(1).alias("mark")))
    parts = materialise(spark, marks.repartitionByRange("p").withColumn("part", F.spark_partition_id()), "marks")
    inside = Window.partitionBy("part").orderBy("p", "mark").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.groupBy("part").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("p"))).alias("end"), F.min("p").alias("least"))
    carried = ends.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    values = parts.withColumn("seen", F.last("v", ignorenulls=True).over(inside)).join(F.broadcast(carried), "part").where("mark = 1").select("p", F.coalesce("seen", "carry").alias("v"))
    low, high = values.select(F.col("p").alias("_low"), F.col("v").alias("_a")), values.select(F.col("p").alias("_high"), F.col("v").alias("_b"))
    joined = at.join(low, "_low", "left").join(high, "_high", "left")
    return joined.withColumn(out, F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_low"))).select(*df.columns, out)


def average_precision(df: DataFrame, score: str, target: str, key: str) -> DataFrame:
    """One row ``average_precision``; equal scores follow the key. At entity scale, in one ordered pass."""
    order = Window.orderBy(F.desc(score), key)
    hits = df.withColumn("_k", F.row_number().over(order)).withColumn("_hits", F.sum(F.col(target).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return hits.where(F.col(target).cast("int") == 1).agg(F.coalesce(F.avg(F.col("_hits") / F.col("_k")), F.lit(0.0)).alias("average_precision"))


def at_top(df: DataFrame, score: str, target: str, key: str, share: float = 0.25) -> DataFrame:
    """``k, precision, recall`` of the best ``share`` of rows (one row at least)."""
    ranked = df.withColumn("_k", F.row_number().over(Window.orderBy(F.desc(score), key))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    best = F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    hit = F.col(target).cast("long")
    return ranked.agg(F.sum(best.cast("long")).alias("k"), (F.sum(F.when(best, hit)) / F.sum(best.cast("long"))).alias("precision"), (F.sum(F.when(best, hit)) / F.nullif(F.sum(hit), F.lit(0))).alias("recall"))


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """``bin`` (from 0), rows; bins of equal width, closed on the right, the least value in the first."""
    range_ = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.greatest(F.ceil((F.col(value) - F.col("lo")) / width) - 1, F.lit(0))).otherwise(F.lit(0))
    return df.where(F.col(value).isNotNull()).join(F.broadcast(range_)).groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("rows"))


def sums_by_band(spark: SparkSession, df: DataFrame, score: str, amount: str, edges: tuple[int, ...] = (0, 20, 40, 60, 80, 100)) -> DataFrame:
    """``band, total`` of right-closed score bands, the lowest edge included, empty bands kept."""
    names = [f"{a}-{b}" for a, b in zip(edges, edges[1:], strict=False)]
    band = F.lit(None).cast("string")
    for name, a, b in reversed(list(zip(names, edges, edges[1:], strict=False))):
        band = F.when((F.col(score) <= b) & ((F.col(score) > a) | (F.lit(a == edges[0]) & (F.col(score) == a))), name).otherwise(band)
    sums = df.groupBy(band.alias("band")).agg(F.sum(amount).alias("total"))
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("band"))
    return listed.join(sums, "band", "left").select("band", F.coalesce("total", F.lit(0)).alias("total"))


def every_nth(df: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows at equal steps of the key's order."""
    step = max(1, df.count() // n)
    return df.withColumn("_k", F.row_number().over(Window.orderBy(key))).where((F.col("_k") - 1) % step == 0).drop("_k").limit(n)


def stratified(df: DataFrame, score: str, keep: float = 40, size: int = 8000, seed: int = 42) -> DataFrame:
    """Every row of at least ``keep``, filled up with a seeded sample of the rest."""
    high = df.where(F.col(score) >= keep)
    room = max(0, size - high.count())
    return high.union(df.where(F.col(score) < keep).orderBy(F.rand(seed)).limit(room))
