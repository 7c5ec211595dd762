"""Every registered query with SQL equals it on the smallest tables; the others return rows with a stable schema."""

from __future__ import annotations

import pytest

import __spark_entry__
from quillspan.plans import registry
from tests.compare import oracle_rows, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns, expected = oracle_rows(registry.ORACLES[name], FOLDER)
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["audit_trails", "person_scores"])
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_one_household_of_many(spark, tmp_path):
    """30,000 customers of one household: neither pairs of them nor a second pass over the lines."""
    n = 30_000
    customer = spark.range(n).selectExpr("id * 40 AS c_custkey", "'c' AS c_name", "CAST(7 AS INT) AS c_nationkey", "CAST(IF(id % 3 = 0, -1, id % 1000) AS DOUBLE) AS c_acctbal", "'x' AS c_mktsegment")
    orders = spark.range(n).selectExpr("id AS o_orderkey", "id * 40 AS o_custkey", "CAST(100 + id % 7 AS DOUBLE) AS o_totalprice", "'1-URGENT' AS o_orderpriority")
    lines = spark.range(2 * n).selectExpr("id % 30000 AS l_orderkey", "CAST(id % 11 AS DOUBLE) AS l_extendedprice")
    for name, df in (("customer", customer), ("orders", orders), ("lineitem", lines)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    price, paid = {k: 100.0 + k % 7 for k in range(n)}, {k: float(k % 11 + (k + n) % 11) for k in range(n)}
    every = sum(price.values()) + sum(paid.values())
    rows = registry.QUERIES["customer_features"](spark, str(tmp_path)).collect()
    assert len(rows) == n
    for r in rows:
        k = r["entity_id"] // 40
        assert (r["network_neighbor_count"], r["n_properties"], r["total_property_value"], r["network_asset_value"]) == (n - 1, 2, paid[k], every - price[k] - paid[k])
    assert registry.QUERIES["key_figures"](spark, str(tmp_path)).first()["hubs"] == sum(1 for k in range(n) if k % 3)


def test_audit_trails_read_tables_once(spark):
    """What ranks and reasons are made from is stored, so the lines are not summed again for each of them."""
    assert not [f for f in registry.QUERIES["audit_trails"](spark, FOLDER).inputFiles() if "lineitem" in f]
