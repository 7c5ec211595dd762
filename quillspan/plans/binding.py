"""The engine's shapes over the driver's tables: customers as people, orders and lines as assets.

``FEATURES_SQL`` is the same binding for DuckDB; sums are rounded to two decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import graph
from quillspan.sources.shared import table

HOUSEHOLD = "c_nationkey * 1000 + c_custkey % 40"


def money(column: Column) -> Column:
    return F.round(column, 2)


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.expr(HOUSEHOLD).alias("dst"))


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A9 with the engine's own network operator: household members are customers of one nation and key class."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    # Lines are summed to their orders before they move, and orders to their customers in one aggregate.
    price, total = F.col("l_extendedprice"), F.col("o_totalprice")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum(price).alias("worth"), F.max(price).alias("most"))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)
    each = orders.select("o_orderkey", F.col("o_custkey").alias("entity_id"), "o_totalprice", urgent.alias("urgent")).join(lines, "o_orderkey", "left")
    of_orders = [F.count("*").cast("double").alias("n_vehicles"), money(F.sum(total)).alias("total_vehicle_value"), F.floor(F.max(total) / 200).cast("double").alias("max_vehicle_cc"), F.sum("urgent").alias("intl_trips"), F.max_by("o_totalprice", "o_orderkey").alias("last_price")]
    of_lines = [F.sum("lines").cast("double").alias("n_properties"), money(F.sum("worth")).alias("total_property_value"), money(F.max("most")).alias("max_monthly_bill")]
    summed = each.groupBy("entity_id").agg(*of_orders, *of_lines)
    declared = F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 1000
    own = customer.select(F.col("c_custkey").alias("entity_id"), declared.alias("declared_income"), (F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 20).alias("tax_paid"), F.when(F.col("c_acctbal") >= 0, 1.0).otherwise(0.0).alias("is_filer"))
    own = own.join(summed, "entity_id", "left").na.fill(0.0)
    out = graph.household_features(own, homes(spark, sf_dir))
    return out.withColumn("network_asset_value", money(F.col("network_asset_value"))).withColumn("network_nonfiler_asset_value", money(F.col("network_nonfiler_asset_value")))


FEATURES_SQL = """
    o1 AS (SELECT o_custkey AS entity_id, CAST(count(*) AS DOUBLE) AS n_vehicles, round(sum(o_totalprice), 2) AS total_vehicle_value, floor(max(o_totalprice) / 200) AS max_vehicle_cc,
                  CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) AS intl_trips, max_by(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1),
    l1 AS (SELECT o_custkey AS entity_id, CAST(count(*) AS DOUBLE) AS n_properties, round(sum(l_extendedprice), 2) AS total_property_value, round(max(l_extendedprice), 2) AS max_monthly_bill
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
    own AS (SELECT c_custkey AS entity_id, c_nationkey * 1000 + c_custkey % 40 AS home, greatest(c_acctbal, 0) * 1000 AS declared_income, greatest(c_acctbal, 0) * 20 AS tax_paid, CASE WHEN c_acctbal >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_filer,
                   coalesce(n_vehicles, 0) AS n_vehicles, coalesce(total_vehicle_value, 0) AS total_vehicle_value, coalesce(max_vehicle_cc, 0) AS max_vehicle_cc, coalesce(intl_trips, 0) AS intl_trips, coalesce(last_price, 0) AS last_price,
                   coalesce(n_properties, 0) AS n_properties, coalesce(total_property_value, 0) AS total_property_value, coalesce(max_monthly_bill, 0) AS max_monthly_bill
            FROM customer LEFT JOIN o1 ON o1.entity_id = c_custkey LEFT JOIN l1 ON l1.entity_id = c_custkey),
    net AS (SELECT p.entity_id, count(*) AS n, sum(q.total_property_value + q.total_vehicle_value) AS a, sum(CASE WHEN q.is_filer = 0 OR q.declared_income < 600000 THEN q.total_property_value + q.total_vehicle_value ELSE 0 END) AS h
            FROM own p JOIN own q ON p.home = q.home AND p.entity_id <> q.entity_id GROUP BY 1),
    features AS (SELECT own.* EXCLUDE (home), CAST(coalesce(n, 0) AS DOUBLE) AS network_neighbor_count, CAST(coalesce(n, 0) AS DOUBLE) AS shared_address_neighbors, round(coalesce(a, 0), 2) AS network_asset_value, round(coalesce(h, 0), 2) AS network_nonfiler_asset_value
                 FROM own LEFT JOIN net USING (entity_id))"""

TAX = "round_even(greatest(least({x}, 1200000) - 600000, 0) * 0.05::DOUBLE + greatest(least({x}, 2200000) - 1200000, 0) * 0.15::DOUBLE + greatest(least({x}, 3200000) - 2200000, 0) * 0.25::DOUBLE + greatest(least({x}, 4100000) - 3200000, 0) * 0.30::DOUBLE + greatest({x} - 4100000, 0) * 0.35::DOUBLE, 0)"
ENGINE = "CASE WHEN {x} >= 2500 THEN 15000000 WHEN {x} >= 1600 THEN 6000000 WHEN {x} >= 1200 THEN 2500000 WHEN {x} >= 1000 THEN 1500000 WHEN {x} >= 600 THEN 800000 WHEN {x} >= 0 THEN 400000 ELSE 0 END"
BAND = "CASE WHEN {x} >= 70 THEN 'high' WHEN {x} >= 40 THEN 'medium' WHEN {x} >= 15 THEN 'low' ELSE 'none' END"

FLOORS_SQL = f"""{FEATURES_SQL},
    f1 AS (SELECT *, CASE WHEN max_monthly_bill > 0 THEN CAST(trunc(max_monthly_bill * 12 / 0.06::DOUBLE / least(CAST(shared_address_neighbors AS INTEGER) + 1, 3)) AS BIGINT) END AS e,
                  CASE WHEN max_vehicle_cc > 0 THEN {ENGINE.format(x="max_vehicle_cc")} END AS v,
                  CASE WHEN total_property_value > 0 THEN CAST(trunc(total_property_value / 8) AS BIGINT) END AS p,
                  CASE WHEN intl_trips >= 1 THEN CAST(intl_trips AS BIGINT) * 1500000 END AS t FROM features),
    f2 AS (SELECT *, coalesce(greatest(e, v, p, t), 0) AS estimated_income_pkr FROM f1),
    f3 AS (SELECT *, {TAX.format(x="CAST(estimated_income_pkr AS DOUBLE)")} AS tax FROM f2),
    f4 AS (SELECT *, greatest(tax - tax_paid, 0) AS gap FROM f3),
    f5 AS (SELECT *, CAST(round_even(100 * (gap / (gap + 300000)) * (0.5::DOUBLE + 0.5::DOUBLE * CASE WHEN tax > 0 THEN gap / tax ELSE 0 END), 0) AS INTEGER) AS rule_deviation_score FROM f4),
    floors AS (SELECT entity_id, estimated_income_pkr, CAST(trunc(declared_income) AS BIGINT) AS declared_income_pkr, CASE WHEN is_filer = 1 AND declared_income > 0 THEN 'filer' ELSE 'absent' END AS filer_status,
                      CAST(trunc(tax_paid) AS BIGINT) AS tax_paid_pkr, CAST(tax AS BIGINT) AS expected_tax_pkr, CAST(trunc(gap) AS BIGINT) AS tax_gap_pkr, rule_deviation_score, {BAND.format(x="rule_deviation_score")} AS band,
                      array_to_string(list_filter([CASE WHEN e IS NOT NULL THEN 'electricity:' || e END, CASE WHEN v IS NOT NULL THEN 'vehicles:' || v END, CASE WHEN p IS NOT NULL THEN 'property:' || p END, CASE WHEN t IS NOT NULL THEN 'travel:' || t END], lambda x: x IS NOT NULL), '|') AS factors,
                      (CASE WHEN is_filer <> 1 AND tax > 0 THEN 1 ELSE 0 END + CASE WHEN network_nonfiler_asset_value > 2000000 THEN 1 ELSE 0 END) AS n_notes FROM f5)"""

ENGINEERED_SQL = f"""{FEATURES_SQL},
    g1 AS (SELECT *, list_sort(list_filter([greatest(max_monthly_bill - 3000, 0) * 111, greatest(max_vehicle_cc - 800, 0) * 3125, total_property_value / 4, intl_trips * 500000], lambda x: x > 0)) AS s, greatest(declared_income, 0) + 1200000 AS base FROM features),
    g2 AS (SELECT *, greatest(CASE WHEN len(s) > 0 THEN (s[(len(s) - 1) // 2 + 1] + s[len(s) // 2 + 1]) / 2 ELSE 0 END, declared_income, 0) AS implied_income FROM g1),
    engineered AS (SELECT *, max_monthly_bill * 12 / base AS elec_to_declared, total_property_value / base AS property_to_declared, total_vehicle_value / base AS vehicle_to_declared, intl_trips / (base / 1000000) AS travel_to_declared,
                          implied_income / base AS implied_to_declared, network_nonfiler_asset_value / 4 / base AS network_to_declared FROM g2)"""
