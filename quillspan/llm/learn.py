"""Bounded, repeatable training samples for the two classifiers. Rows are bounded, texts are whole and stay on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def first_by_hash(ids: DataFrame, rows: int, salt: int) -> DataFrame:
    """The ``rows`` ids of least hash. Hashes beyond twice the expected bound go before the sort, which is thereby small."""
    every = max(1, ids.count() // (2 * rows))
    near = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(-salt)), F.lit(every)) == 0)
    return near.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(rows)


def labelled_ids(labels: DataFrame, label: str, value: int, rows: int, train: Column) -> DataFrame:
    """At most ``rows`` training ids whose every non-null label is ``value``, by a hash order that ignores content."""
    agreed = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("high"))
    return first_by_hash(agreed.where((F.col("low") == value) & (F.col("high") == value)).select("doc_id"), rows, value + 1)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Whole texts of a bounded set of ids, one for each id."""
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"))


def any_texts(docs: DataFrame, rows: int, train: Column) -> DataFrame:
    """Whole texts of at most ``rows`` training-fold ids, whether labelled or not, by a hash of the id."""
    return texts_of(docs, first_by_hash(docs.select("doc_id").where(F.col("doc_id").isNotNull() & train).distinct(), rows, 7))
