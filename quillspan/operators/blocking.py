"""Block keys and candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.normalize import address_key

#: Skeletons of given-name prefixes, and the size beyond which a block is skipped.
PREFIX_SKELETONS = ["m", "mhmd", "mhd"]
MAX_BLOCK = 250


def block_keys(prefix: str = "") -> Column:
    """The block keys of a unified record, as an array without nulls."""
    c = lambda name: F.col(prefix + name)
    names = F.filter(c("name_skeletons"), lambda s: ~s.isin(PREFIX_SKELETONS))
    n, first, last = F.size(names), F.get(names, 0), F.element_at(names, -1)
    some = F.when(n > 0, last)
    city = F.nullif(c("city"), F.lit(""))
    dob = F.nullif(c("dob"), F.lit(""))
    tag = lambda t, x: F.concat(F.lit(t), x)
    keys = [
        tag("C:", c("cnic")["digits"]),
        tag("P:", c("phone")),
        F.when(n >= 2, tag("N:", F.concat_ws("|", first, last))),
        F.when((n >= 2) & city.isNotNull(), tag("NC:", F.concat_ws("|", first, last, city))),
        F.when((n == 1) & city.isNotNull(), tag("N1:", F.concat_ws("|", first, city))),
        tag("A:", address_key(c("addr"))),
        F.when(dob.isNotNull(), tag("D:", F.concat_ws("|", dob, some))),
    ]
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull()))


def block_index(records: DataFrame) -> DataFrame:
    """``key, record_id`` of every block, without the size cap."""
    return records.select(F.explode(block_keys()).alias("key"), "record_id")


def pairs_of_blocks(blocks: DataFrame, key: str = "key", member: str = "record_id", order: str | None = None, cap: int = MAX_BLOCK) -> DataFrame:
    """Distinct pairs ``a, b`` that share a block of at most ``cap`` members, the smaller by ``order`` first.

    Sizes are summed before the self join, so oversize blocks never meet themselves; AQE splits what is left.
    """
    place = order or member
    held = blocks.select(F.col(key).alias("k"), F.col(member).alias("m"), F.col(place).alias("o")).distinct()
    fits = held.groupBy("k").count().where((F.col("count") > 1) & (F.col("count") <= cap)).select("k")
    held = held.join(fits, "k")
    one, two = held.select("k", F.col("m").alias("a"), F.col("o").alias("oa")), held.select("k", F.col("m").alias("b"), F.col("o").alias("ob"))
    return one.join(two, "k").where("oa < ob").select("a", "b").distinct()


def block_stats(blocks: DataFrame, key: str = "key", member: str = "record_id", cap: int = MAX_BLOCK) -> DataFrame:
    """One row: blocks, oversize blocks, and pairs before they are made distinct."""
    sizes = blocks.select(key, member).distinct().groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_blocks"), F.count_if(F.col("n") > cap).alias("skipped_oversize_blocks"), F.coalesce(F.sum(F.when(F.col("n") <= cap, F.col("n") * (F.col("n") - 1) / 2)).cast("long"), F.lit(0)).alias("block_pairs"))
