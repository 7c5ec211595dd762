"""Queries over the driver's tables, one or more for each operator family, and the SQL they are compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import income as X
from quillspan.functions import normalize as N
from quillspan.functions import similarity as P
from quillspan.operators import audit, blocking, evaluate, graph, linkage, ranking, relational, resolve, scoring, synth
from quillspan.operators.components import connected_components
from quillspan.plans import binding as B
from quillspan.sources import registries as R
from quillspan.sources.shared import materialise, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def floors_of(spark: SparkSession, sf_dir: str, features: DataFrame | None = None) -> DataFrame:
    if features is None:
        features = materialise(spark, B.customer_features(spark, sf_dir), "features")
    rows = materialise(spark, X.with_floors(features), "floors")
    factors = F.array_join(F.transform("factors", lambda x: F.concat_ws(":", x["factor"], x["implied_income"])), "|")
    return rows.select("entity_id", "estimated_income_pkr", "declared_income_pkr", "filer_status", "tax_paid_pkr", "expected_tax_pkr", "tax_gap_pkr", "rule_deviation_score", "band", factors.alias("factors"), F.size("notes").alias("n_notes"))


@query(f"WITH {B.FEATURES_SQL} SELECT * FROM features")
def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A9, J5-J7."""
    return B.customer_features(spark, sf_dir)


@query(f"WITH {B.FLOORS_SQL} SELECT * FROM floors")
def floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1-X8."""
    return floors_of(spark, sf_dir)


@query(f"WITH {B.FLOORS_SQL} SELECT * FROM floors ORDER BY rule_deviation_score DESC, entity_id LIMIT 25")
def floors_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2."""
    return floors_of(spark, sf_dir).orderBy(F.desc("rule_deviation_score"), "entity_id").limit(25)


@query(f"WITH {B.FLOORS_SQL} SELECT band, count(*) AS entities, CAST(sum(tax_gap_pkr) AS BIGINT) AS gap FROM floors GROUP BY 1")
def floor_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    return audit.band_summary(floors_of(spark, sf_dir))


@query("WITH x AS (SELECT o_orderkey, CAST(trunc(o_totalprice * 20) AS BIGINT) AS income FROM orders) SELECT o_orderkey, income, " + B.TAX.format(x="CAST(income AS DOUBLE)") + " AS tax, " + B.ENGINE.format(x="o_orderkey % 3000") + " AS floor FROM x")
def tax_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, X2."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * 20).cast("long").alias("income"))
    return rows.select("o_orderkey", "income", X.annual_tax(F.col("income")).alias("tax"), X.engine_floor(F.col("o_orderkey") % 3000).cast("int").alias("floor"))


_RATIOS = ["implied_income", *scoring.RATIOS]


@query(f"WITH {B.ENGINEERED_SQL} SELECT entity_id, " + ", ".join(f"CAST(floor({c} * 1000000 + 0.5) AS BIGINT) AS {c}" for c in _RATIOS) + " FROM engineered")
def engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9-X11."""
    return X.engineer(B.customer_features(spark, sf_dir)).select("entity_id", *[F.floor(F.col(c) * 1_000_000 + F.lit(0.5)).alias(c) for c in _RATIOS])


@query(f"WITH {B.ENGINEERED_SQL} SELECT entity_id, round(ln(1 + greatest(property_to_declared, 0)), 6) AS x, round((rank() OVER (ORDER BY intl_trips) + (count(*) OVER (PARTITION BY intl_trips) - 1) / 2) / count(*) OVER (), 9) AS percentile FROM engineered")
def percent_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12, W1 (a column with many ties)."""
    rows = X.engineer(B.customer_features(spark, sf_dir)).select("entity_id", "intl_trips", "property_to_declared")
    return ranking.percent_rank_average(spark, rows, "intl_trips", "p").select("entity_id", F.round(X.model_input("property_to_declared"), 6).alias("x"), F.round("p", 9).alias("percentile"))


@query(f"""WITH {B.ENGINEERED_SQL},
    s AS (SELECT entity_id, total_property_value AS a, total_vehicle_value AS b FROM engineered),
    r AS (SELECT b AS v, row_number() OVER (ORDER BY b) - 1 AS k, count(*) OVER () AS n FROM s),
    x AS (SELECT entity_id, ((rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2) / count(*) OVER ()) * (count(*) OVER () - 1) AS place FROM s)
    SELECT entity_id, round(lo.v + (hi.v - lo.v) * (place - floor(place)), 4) AS aligned FROM x JOIN r lo ON lo.k = floor(place) JOIN r hi ON hi.k = least(floor(place) + 1, hi.n - 1)""")
def quantile_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    rows = B.customer_features(spark, sf_dir).select("entity_id", F.col("total_property_value").alias("a"), F.col("total_vehicle_value").alias("b"))
    return ranking.align(spark, materialise(spark, rows, "align"), "a", "b", "aligned").select("entity_id", F.round("aligned", 4).alias("aligned"))


@query(f"WITH {B.FLOORS_SQL}, r AS (SELECT min(rule_deviation_score) AS lo, max(rule_deviation_score) AS hi FROM floors) SELECT CAST(CASE WHEN hi > lo THEN least(greatest(ceil((rule_deviation_score - lo) / ((hi - lo) / 40)) - 1, 0), 39) ELSE 0 END AS INTEGER) AS bin, count(*) AS rows FROM floors, r GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    return ranking.histogram(floors_of(spark, sf_dir), "rule_deviation_score")


@query(f"""WITH {B.FLOORS_SQL}, b AS (SELECT * FROM (VALUES ('0-20', -1, 20), ('20-40', 20, 40), ('40-60', 40, 60), ('60-80', 60, 80), ('80-100', 80, 100)) t(band, lo, hi))
    SELECT b.band, CAST(coalesce(sum(tax_gap_pkr), 0) AS BIGINT) AS total FROM b LEFT JOIN floors f ON f.rule_deviation_score > lo AND f.rule_deviation_score <= hi GROUP BY 1""")
def gap_by_score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    return ranking.sums_by_band(spark, floors_of(spark, sf_dir), "rule_deviation_score", "tax_gap_pkr")


@query(f"""WITH {B.FLOORS_SQL} SELECT count(*) FILTER (rule_deviation_score >= 60) AS flagged, CAST(sum(greatest(estimated_income_pkr - declared_income_pkr, 0)) AS BIGINT) AS undeclared, count(*) FILTER (declared_income_pkr = 0) AS nothing_declared,
    (SELECT count(*) FROM features WHERE is_filer = 1 AND network_nonfiler_asset_value > 2000000) AS hubs, round(avg(CASE WHEN rule_deviation_score <= 50 THEN 1.0 ELSE 0.0 END), 9) AS share_at_50 FROM floors""")
def key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23, A26, Q8, Q9."""
    features = materialise(spark, B.customer_features(spark, sf_dir), "features")
    hubs = features.where("is_filer = 1 AND network_nonfiler_asset_value > 2000000").agg(F.count("*").alias("hubs"))
    score = F.col("rule_deviation_score")
    figures = floors_of(spark, sf_dir, features).agg(F.count_if(score >= 60).alias("flagged"), F.sum(F.greatest(F.col("estimated_income_pkr") - F.col("declared_income_pkr"), F.lit(0))).alias("undeclared"), F.count_if(F.col("declared_income_pkr") == 0).alias("nothing_declared"), F.round(F.avg((score <= 50).cast("double")), 9).alias("share_at_50"))
    return figures.join(hubs)


@query(f"""WITH {B.FEATURES_SQL} SELECT entity_id, CASE WHEN total_vehicle_value >= 1e7 THEN printf('Rs %.2f crore', total_vehicle_value / 1e7) WHEN total_vehicle_value >= 1e5 THEN printf('Rs %.2f lakh', total_vehicle_value / 1e5) ELSE 'Rs ' || format('{{:,}}', CAST(round_even(total_vehicle_value, 0) AS BIGINT)) END AS shown,
    coalesce(CAST(trunc(TRY_CAST(CASE WHEN entity_id % 3 = 0 THEN 'x' ELSE CAST(last_price AS VARCHAR) END AS DOUBLE)) AS BIGINT), 0) AS whole, CASE WHEN entity_id % 100 >= 70 THEN 'HIGH' WHEN entity_id % 100 >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS verdict FROM features""")
def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, F15, X15."""
    rows = B.customer_features(spark, sf_dir)
    text = F.when(F.col("entity_id") % 3 == 0, "x").otherwise(F.col("last_price").cast("string"))
    return rows.select("entity_id", X.rupees(F.col("total_vehicle_value")).alias("shown"), X.safe_int(text).alias("whole"), X.verdict(F.col("entity_id") % 100).alias("verdict"))


_SKELETON = "regexp_replace(lower(t), '[^a-z]', '', 'g')"
for _pair, _one in N.DIGRAPHS:
    _SKELETON = f"replace({_SKELETON}, '{_pair}', '{_one}')"
_SKELETON = f"translate({_SKELETON}, 'qwyaeiou', 'kv')"


@query(f"""WITH w AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(replace(replace(text, '.', ' '), ',', ' ')), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ts FROM documents )),
    s AS (SELECT doc_id, pos, t, {_SKELETON} AS k FROM w)
    SELECT doc_id, count(*) AS n_tokens, string_agg(array_to_string(list_transform(list_filter(generate_series(1, length(k)), lambda i: i = 1 OR substr(k, i, 1) <> substr(k, i - 1, 1)), lambda i: substr(k, i, 1)), ''), ' ' ORDER BY pos) FILTER (k <> '') AS skeletons FROM s GROUP BY 1""")
def name_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2-F5 on the words of all texts."""
    docs = table(spark, sf_dir, "documents")
    tokens = F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.translate("text", ".,", "  ")), r"\s+", " ")), " "), lambda t: t != "")
    rows = docs.select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.nullif(F.array_join(F.filter(F.transform(tokens, N.skeleton), lambda t: t != ""), " "), F.lit("")).alias("skeletons"))
    return rows.where("n_tokens > 0")


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    city = F.get(F.array(*[F.lit(c) for c in N.CITIES]), (k % 12).cast("int"))
    short = F.get(F.array(*[F.lit(c) for c in ("rwp", "isb", "lhr", "khi", "pesh", "fsd", "mtn", "skt", "hyd", "gjw", "qta", "bwp")]), (k % 12).cast("int"))
    house, street = (k % 900 + 1).cast("string"), (k % 60 + 1).cast("string")
    styles = [
        F.concat(F.lit("House "), house, F.lit(", Street "), street, F.lit(", Model Town, "), F.initcap(city)),
        F.concat(F.lit("H.No. "), house, F.lit(", St. "), street, F.lit(", Model Town, "), F.upper(short)),
        F.concat(F.lit("H # "), house, F.lit(" Gali "), street, F.lit(", Model Town "), city),
        F.concat(house, F.lit("-"), street, F.lit(" Model Town, "), F.upper(city)),
        F.concat(F.lit("Plot "), house, F.lit(", Street  "), street, F.lit(", Model Town,"), short),
        F.concat(F.lit("Model Town, "), F.initcap(city)),
    ]
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*styles), (k % 6 + 1).cast("int")).alias("address"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 <> 5 THEN CAST(c_custkey % 900 + 1 AS INTEGER) END AS house, CASE WHEN c_custkey % 6 <> 5 THEN CAST(c_custkey % 60 + 1 AS INTEGER) END AS street, 'model town' AS area,
    ['rawalpindi', 'islamabad', 'lahore', 'karachi', 'peshawar', 'faisalabad', 'multan', 'sialkot', 'hyderabad', 'gujranwala', 'quetta', 'bahawalpur'][c_custkey % 12 + 1] AS city FROM customer""")
def parsed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 on six written forms; the oracle knows the parts they were written from."""
    a = N.normalize_address(F.col("address"))
    return _styled(spark, sf_dir).select("c_custkey", a["house"].alias("house"), a["street"].alias("street"), F.array_join(a["area_tokens"], " ").alias("area"), a["city"].alias("city"))


@query("""WITH x AS (SELECT c_custkey AS k, lpad(CAST(c_custkey * 7919 % 10000000000000 AS VARCHAR), 13, '7') AS d FROM customer)
    SELECT k, CASE WHEN k % 3 <> 2 THEN d END AS digits, substr(d, 1, 5) AS prefix, substr(d, 13, 1) AS last, '0' || lpad(CAST(k AS VARCHAR), 10, '3') AS phone FROM x""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dashed, plain and masked numbers; local and international phones."""
    d = F.lpad((F.col("c_custkey") * 7919 % 10_000_000_000_000).cast("string"), 13, "7")
    k = F.col("c_custkey") % 3
    written = F.when(k == 0, F.concat_ws("-", F.substring(d, 1, 5), F.substring(d, 6, 7), F.substring(d, 13, 1))).when(k == 1, d).otherwise(F.concat(F.substring(d, 1, 5), F.lit("-XXXXXXX-"), F.substring(d, 13, 1)))
    local = F.lpad(F.col("c_custkey").cast("string"), 10, "3")
    phone = F.when(k == 0, F.concat(F.lit("0"), F.substring(local, 1, 3), F.lit("-"), F.substring(local, 4, 7))).otherwise(F.concat(F.lit("+92 "), local))
    c = N.normalize_cnic(written)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), c["digits"].alias("digits"), c["prefix"].alias("prefix"), c["last"].alias("last"), N.normalize_phone(phone).alias("phone"))


@query("""WITH x AS (SELECT p_partkey, lpad(CAST(p_partkey * 104729 % 10000000000000 AS VARCHAR), 13, '4') AS a FROM part),
    y AS (SELECT p_partkey, a, CASE p_partkey % 5 WHEN 0 THEN a WHEN 1 THEN substr(a, 1, 5) || substr(a, 7, 1) || substr(a, 6, 1) || substr(a, 8) WHEN 2 THEN substr(a, 1, 5) || 'x' || substr(a, 7) WHEN 3 THEN substr(a, 1, 5) || substr(a, 7) ELSE reverse(a) END AS b FROM x)
    SELECT p_partkey, damerau_levenshtein(a, b) <= 1 AS near, CASE WHEN a = b THEN 'n_match' ELSE 'n_diff' END AS band FROM y""")
def near_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P7, P9."""
    a = F.lpad((F.col("p_partkey") * 104729 % 10_000_000_000_000).cast("string"), 13, "4")
    rows = table(spark, sf_dir, "part").select("p_partkey", a.alias("a"))
    k, a = F.col("p_partkey") % 5, F.col("a")
    b = F.when(k == 0, a).when(k == 1, F.concat(F.substring(a, 1, 5), F.substring(a, 7, 1), F.substring(a, 6, 1), F.substring(a, 8, 20))).when(k == 2, F.concat(F.substring(a, 1, 5), F.lit("x"), F.substring(a, 7, 20))).when(k == 3, F.concat(F.substring(a, 1, 5), F.substring(a, 7, 20))).otherwise(F.reverse(a))
    return rows.withColumn("b", b).select("p_partkey", P.damerau1(F.col("a"), F.col("b")).alias("near"), P.band_equal(F.col("a"), F.col("b"), "n").alias("band"))


@query("""WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS m, c_custkey AS o, unnest(['N:' || c_nationkey || '|' || c_mktsegment, 'B:' || CAST(floor(c_acctbal / 10) AS BIGINT), 'W:' || c_nationkey]) AS k FROM customer),
    f AS (SELECT k FROM p GROUP BY 1 HAVING count(*) BETWEEN 2 AND 250)
    SELECT DISTINCT x.m AS a, y.m AS b FROM p x JOIN f USING (k) JOIN p y USING (k) WHERE x.o < y.o""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 on three key families, under the surveyed engine's limit of members a block."""
    return blocking.pairs_of_blocks(_customer_blocks(spark, sf_dir), member="m", order="o")


def _customer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(F.concat(F.lit("N:"), F.col("c_nationkey").cast("string"), F.lit("|"), F.col("c_mktsegment")), F.concat(F.lit("B:"), F.floor(F.col("c_acctbal") / 10).cast("string")), F.concat(F.lit("W:"), F.col("c_nationkey").cast("string")))
    return table(spark, sf_dir, "customer").select(F.explode(keys).alias("key"), F.col("c_custkey").cast("string").alias("m"), F.col("c_custkey").alias("o"))


@query("""WITH p AS (SELECT c_custkey AS m, unnest(['N:' || c_nationkey || '|' || c_mktsegment, 'B:' || CAST(floor(c_acctbal / 10) AS BIGINT), 'W:' || c_nationkey]) AS k FROM customer), s AS (SELECT k, count(*) AS n FROM p GROUP BY 1)
    SELECT count(*) AS n_blocks, count(*) FILTER (n > 250) AS skipped_oversize_blocks, CAST(sum(CASE WHEN n <= 250 THEN n * (n - 1) // 2 ELSE 0 END) AS BIGINT) AS block_pairs FROM s""")
def block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A30."""
    return blocking.block_stats(_customer_blocks(spark, sf_dir), member="m")


@query("SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def order_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 on chains: each order of a customer is linked to the next."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), after.alias("dst"))
    return connected_components(spark, edges)


@query("""WITH n AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8)
    SELECT CAST(o_orderkey AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders JOIN n USING (o_custkey)) WHERE b IS NOT NULL""")
def anchor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, W4, without the sampling cap."""
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("record_id"), F.struct(F.col("o_custkey").cast("string").alias("digits")).alias("cnic"))
    return linkage.anchor_pairs(records, cap=None)


_PAIR_SQL = """pairs AS (SELECT x.c_custkey AS a, y.c_custkey AS b, list_filter([CASE WHEN x.c_nationkey = y.c_nationkey THEN 'cnic_exact' ELSE 'cnic_diff' END, CASE WHEN x.c_mktsegment = y.c_mktsegment THEN 'father_match' ELSE 'father_diff' END,
    CASE WHEN x.c_acctbal > 0 AND y.c_acctbal > 0 THEN CASE WHEN floor(x.c_acctbal / 1000) = floor(y.c_acctbal / 1000) THEN 'dob_match' ELSE 'dob_diff' END END], lambda z: z IS NOT NULL) AS bands FROM customer x JOIN customer y ON y.c_custkey BETWEEN x.c_custkey + 1 AND x.c_custkey + 5)"""


def _customer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    one = c.select(F.col("c_custkey").alias("a"), F.col("c_nationkey").cast("string").alias("na"), F.col("c_mktsegment").alias("sa"), F.col("c_acctbal").alias("ba"), F.explode(F.sequence(F.col("c_custkey") + 1, F.col("c_custkey") + 5)).alias("b"))
    two = c.select(F.col("c_custkey").alias("b"), F.col("c_nationkey").cast("string").alias("nb"), F.col("c_mktsegment").alias("sb"), F.col("c_acctbal").alias("bb"))
    both = one.join(two, "b")
    thousand = lambda x: F.when(F.col(x) > 0, F.floor(F.col(x) / 1000).cast("string"))
    nation = F.when(F.col("na") == F.col("nb"), "cnic_exact").otherwise("cnic_diff")
    return both.select("a", "b", P.observed(nation, P.band_equal(F.col("sa"), F.col("sb"), "father"), P.band_equal(thousand("ba"), thousand("bb"), "dob")).alias("bands"))


@query(f"""WITH {_PAIR_SQL}, m AS (SELECT unnest(bands) AS band FROM pairs WHERE b = a + 1), u AS (SELECT unnest(bands) AS band FROM pairs WHERE b > a + 1),
    c AS (SELECT band, (SELECT count(*) FROM m WHERE m.band = x.band) AS cm, (SELECT count(*) FROM u WHERE u.band = x.band) AS cu FROM (SELECT DISTINCT band FROM m UNION SELECT DISTINCT band FROM u) x)
    SELECT band, cm, cu, round(greatest(least(log2(((cm + 0.5) / ((SELECT count(*) FROM pairs WHERE b = a + 1) + 1.0)) / ((cu + 0.5) / ((SELECT count(*) FROM pairs WHERE b > a + 1) + 1.0))), 8), -8), 9) AS weight FROM c""")
def band_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts among two samples and the clipped, smoothed weight."""
    pairs = materialise(spark, _customer_pairs(spark, sf_dir), "pairs")
    m, u = pairs.where("b = a + 1"), pairs.where("b > a + 1")
    seen_m, seen_u, n_m, n_u = linkage.band_counts(m), linkage.band_counts(u), m.count(), u.count()
    rows = [(b, seen_m.get(b, 0), seen_u.get(b, 0), round(linkage.log_weight(seen_m.get(b, 0), n_m, seen_u.get(b, 0), n_u), 9)) for b in sorted({*seen_m, *seen_u})]
    return spark.createDataFrame(rows, "band string, cm long, cu long, weight double")


_W = {"cnic_exact": 8.0, "cnic_diff": -8.0, "father_match": 3.5, "father_diff": -1.25, "dob_match": 4.0, "dob_diff": -2.0}
_WSQL = "CASE z " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _W.items()) + " ELSE 0 END"


@query(f"""WITH {_PAIR_SQL}, s AS (SELECT a, b, bands, CAST(list_sum(list_transform(bands, lambda z: {_WSQL})) AS DOUBLE) AS score FROM pairs),
    p AS (SELECT *, CASE WHEN score - 6 > 50 THEN 1 ELSE pow(2, score - 6) / (1 + pow(2, score - 6)) END AS p FROM s)
    SELECT a, b, round(score, 2) AS score, round(p, 6) AS probability, array_to_string(bands, '|') AS evidence, CASE WHEN p >= 0.95 AND NOT ((list_contains(bands, 'father_diff') OR list_contains(bands, 'dob_diff')) AND NOT list_contains(bands, 'cnic_exact')) AND list_contains(bands, 'cnic_exact') THEN 'match' WHEN p >= 0.2 THEN 'borderline' ELSE 'drop' END AS decision FROM p""")
def routed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10-P12, Q1-Q3."""
    model = linkage.Model(_W, -6.0)
    scored = _customer_pairs(spark, sf_dir).withColumn("score", model.score(F.col("bands"))).withColumn("probability", model.posterior(F.col("score")))
    return linkage.route(scored).select("a", "b", F.round("score", 2).alias("score"), F.round("probability", 6).alias("probability"), F.array_join("bands", "|").alias("evidence"), "decision")


@query(f"""WITH {_PAIR_SQL} SELECT a, b, len(list_intersect(bands, ['father_match', 'dob_match', 'phone_match'])) AS support, list_has_any(bands, ['cnic_diff', 'father_diff', 'city_diff', 'dob_diff']) AS veto FROM pairs""")
def tier2_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4-Q6, U4: supporting and vetoing bands."""
    support = F.array_intersect("bands", F.array(F.lit("father_match"), F.lit("dob_match"), F.lit("phone_match")))
    return _customer_pairs(spark, sf_dir).select("a", "b", F.size(support).cast("long").alias("support"), linkage.overlap(F.col("bands"), linkage.TIER2_VETO).alias("veto"))


@query("""WITH p AS (SELECT x.vec_id AS a, y.vec_id AS b, x.label = y.label AS same, list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS c FROM embeddings x JOIN embeddings y ON y.vec_id BETWEEN x.vec_id + 1 AND x.vec_id + 20)
    SELECT same, CASE WHEN c >= 0.85 THEN 'emb_high' WHEN c >= 0.7 THEN 'emb_mid' WHEN c >= 0.5 THEN 'emb_low' ELSE 'emb_diff' END AS band, count(*) AS pairs, round(avg(c), 9) AS mean FROM p GROUP BY 1, 2""")
def embedding_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine bands by label agreement."""
    e = table(spark, sf_dir, "embeddings")
    one = e.select(F.col("embedding").alias("x"), F.col("label").alias("lx"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 20)).alias("b"))
    both = one.join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), F.col("label").alias("ly")), "b").withColumn("c", P.cosine(F.col("x"), F.col("y")))
    return both.groupBy((F.col("lx") == F.col("ly")).alias("same"), P.band_embedding(F.col("c")).alias("band")).agg(F.count("*").alias("pairs"), F.round(F.avg("c"), 9).alias("mean"))


@query("""WITH x AS (SELECT source AS cluster, lang AS label, count(*) AS n FROM documents GROUP BY 1, 2), c AS (SELECT cluster, sum(n) AS n, max(n) AS top FROM x GROUP BY 1), l AS (SELECT label, sum(n) AS n FROM x GROUP BY 1),
    r AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM x) AS tp, (SELECT sum(n * (n - 1) / 2) FROM c) AS made, (SELECT sum(n * (n - 1) / 2) FROM l) AS real, (SELECT avg(top / n) FROM c) AS purity, (SELECT count(*) FROM c) AS entities)
    SELECT entities, round(tp / made, 9) AS precision, round(tp / real, 9) AS recall, round(2 * (tp / made) * (tp / real) / (tp / made + tp / real), 9) AS f1, round(purity, 9) AS purity FROM r""")
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, A16."""
    d = table(spark, sf_dir, "documents")
    row = evaluate.pair_counts(d.select("doc_id", F.col("source").alias("cluster")), d.select("doc_id", F.col("lang").alias("label")), "doc_id", "cluster", "label")
    return row.select("entities", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "purity")])


@query("WITH n AS (SELECT source AS entity_id, lang AS person_id, count(*) AS n FROM documents GROUP BY 1, 2) SELECT entity_id, arg_min(person_id, (-n, person_id)) AS person_id FROM n GROUP BY 1")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    d = table(spark, sf_dir, "documents")
    return evaluate.majority(d.select(F.col("doc_id").alias("record_id"), F.col("source").alias("entity_id")), d.select(F.col("doc_id").alias("record_id"), F.col("lang").alias("person_id")))


@query("""WITH r AS (SELECT doc_id, n_chars, quality, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k, count(*) OVER () AS n FROM documents JOIN labels USING (doc_id)),
    h AS (SELECT *, sum(quality) OVER (ORDER BY k) AS hits FROM r)
    SELECT round((SELECT avg(hits / k) FROM h WHERE quality = 1), 9) AS average_precision, count(*) FILTER (k <= n // 4) AS k, round(sum(quality) FILTER (k <= n // 4) / (count(*) FILTER (k <= n // 4)), 9) AS precision, round(sum(quality) FILTER (k <= n // 4) / sum(quality), 9) AS recall FROM h""")
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, A18, W8."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars", "quality")
    top = ranking.at_top(rows, "n_chars", "quality", "doc_id").select("k", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))
    return top.join(ranking.average_precision(rows, "n_chars", "quality", "doc_id").select(F.round("average_precision", 9).alias("average_precision")))


@query("""SELECT x.c_custkey AS p, y.c_custkey AS q FROM customer x JOIN customer y ON x.c_nationkey * 1000 + x.c_custkey % 40 = y.c_nationkey * 1000 + y.c_custkey % 40 AND x.c_custkey <> y.c_custkey""")
def household_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6."""
    return graph.co_members(B.homes(spark, sf_dir))


def _order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.col("o_custkey").cast("int").alias("entity_id"), F.concat(F.lit("address:"), F.col("l_suppkey").cast("string"), F.lit("-"), (F.col("o_orderkey") % 400).cast("string")).alias("dst"), F.lit("address").alias("kind")).distinct()


_LINKS = "l AS (SELECT DISTINCT CAST(o_custkey AS INTEGER) AS entity_id, 'address:' || l_suppkey || '-' || o_orderkey % 400 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"WITH {_LINKS}, f AS (SELECT min(entity_id) AS e FROM l) SELECT DISTINCT y.entity_id FROM l x JOIN l y USING (dst), f WHERE x.entity_id = f.e AND y.entity_id <> f.e")
def household_associates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17 for the least entity."""
    links = _order_links(spark, sf_dir)
    first = links.agg(F.min("entity_id").alias("e")).first()["e"]
    return graph.associates(links, first)


@query(f"""WITH RECURSIVE {_LINKS}, e AS (SELECT 'person:' || entity_id AS x, dst AS y FROM l UNION ALL SELECT dst, 'person:' || entity_id FROM l),
    w AS (SELECT 'person:' || min(entity_id) AS id, 0 AS distance FROM l UNION SELECT e.y, w.distance + 1 FROM w JOIN e ON e.x = w.id WHERE w.distance < 3)
    SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM w GROUP BY 1""")
def ego_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps around the least entity."""
    links = _order_links(spark, sf_dir)
    first = links.agg(F.min("entity_id").alias("e")).first()["e"]
    return graph.ego(spark, links, first, 3)


@query(f"WITH {_LINKS} SELECT 'person' AS kind, count(DISTINCT o_custkey) AS count FROM orders UNION ALL SELECT 'address', count(DISTINCT dst) FROM l")
def graph_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    mentions = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("int").alias("entity_id"))
    return graph.graph_summary(mentions, _order_links(spark, sf_dir))


@query("""SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 'customer' AS kind, CAST(NULL AS BIGINT) AS size, 'tier1' AS decided_by FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'supplier', NULL, 'tier1' FROM supplier UNION ALL SELECT p_partkey, p_name, NULL, 'part', p_size, 'tier4' FROM part""")
def union_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union by name, missing columns null, a default for the tier."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("part").alias("kind"), F.col("p_size").cast("long").alias("size"), F.lit("tier4").alias("decided_by"))
    both = c.unionByName(s).unionByName(p, allowMissingColumns=True)
    return both.withColumn("decided_by", F.coalesce("decided_by", F.lit("tier1")))


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS both_sides, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS without_orders, (SELECT count(*) FROM (SELECT o_custkey FROM orders UNION SELECT s_suppkey FROM supplier)) AS either")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2, U3."""
    orders, customer = table(spark, sf_dir, "orders").select("o_custkey"), table(spark, sf_dir, "customer")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(orders.intersect(customer.where("c_acctbal < 0").select("c_custkey")), "both_sides")
    two = n(customer.select("c_custkey").subtract(orders), "without_orders")
    return one.join(two).join(n(orders.union(table(spark, sf_dir, "supplier").select("s_suppkey")).distinct(), "either"))


@query("SELECT lower(trim(event_type)) AS label, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE lower(trim(event_type)) IN (SELECT event_type FROM events) GROUP BY 1")
def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid labels only, and a JSON field."""
    e = table(spark, sf_dir, "events")
    valid = F.broadcast(e.select("event_type").distinct().select(F.col("event_type").alias("label")))
    rows = e.withColumn("label", F.lower(F.trim(F.concat(F.lit(" "), F.col("event_type"))))).join(valid, "label", "left_semi")
    return rows.groupBy("label").agg(F.count("*").alias("events"), F.sum(F.from_json("props", "k long")["k"]).alias("total"))


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer) WHERE k % greatest(n // 12, 1) = 0 ORDER BY c_custkey LIMIT 12")
def every_twelfth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5."""
    return ranking.every_nth(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 12).orderBy("c_custkey")


@query("""WITH q AS (SELECT c_custkey AS query_id, c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 20 = 0),
    s AS (SELECT query_id, c.c_custkey % 10 AS entity, c.c_custkey AS record, abs(c.c_acctbal - q.c_acctbal) AS gap FROM q JOIN customer c USING (c_nationkey, c_mktsegment) WHERE c.c_custkey <> query_id),
    b AS (SELECT query_id, entity, min((gap, record)) AS m FROM s GROUP BY 1, 2)
    SELECT query_id, entity, m[2] AS record, round(m[1], 6) AS gap, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m[1], entity) AS INTEGER) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY m[1], entity) <= 8""")
def best_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated query set probes blocks; the best record of each entity, eight entities a query."""
    c = table(spark, sf_dir, "customer")
    q = c.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("query_id"), "c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("wanted"))
    seen = c.join(q, ["c_nationkey", "c_mktsegment"]).where("c_custkey <> query_id").withColumn("gap", F.abs(F.col("c_acctbal") - F.col("wanted")))
    best = seen.groupBy("query_id", (F.col("c_custkey") % 10).alias("entity")).agg(F.min(F.struct("gap", "c_custkey")).alias("m"))
    order = Window.partitionBy("query_id").orderBy("m.gap", "entity")
    return best.withColumn("rank", F.row_number().over(order)).where("rank <= 8").select("query_id", "entity", F.col("m.c_custkey").alias("record"), F.round("m.gap", 6).alias("gap"), "rank")


@query("SELECT doc_id AS record_id, source AS entity_id, CAST(count(*) OVER (PARTITION BY source) AS INTEGER) AS cluster_size FROM documents")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return resolve.cluster_sizes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("entity_id")))


@query(f"""WITH {B.FEATURES_SQL} SELECT (SELECT count(*) FROM orders) AS n_records, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_entities, (SELECT count(*) FROM features WHERE coalesce(is_filer, 0) = 0) AS n_non_filers""")
def population_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of their customers."""
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("entity_id"))
    return resolve.population_counts(records, B.customer_features(spark, sf_dir))


@query()
def audit_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of every customer (texts; unit tests hold the formats)."""
    rows = X.engineer(materialise(spark, B.customer_features(spark, sf_dir), "features"))
    rows = ranking.percent_rank_columns(spark, rows, {r: f"_p_{r}" for r in scoring.RATIOS})
    return rows.select("entity_id", X.audit_trail({r: F.col(f"_p_{r}") for r in scoring.RATIOS}).alias("reasons"))


@query()
def deviation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest scores and the ensemble with the relational score of households."""
    features = materialise(spark, B.customer_features(spark, sf_dir).withColumn("n_cities", F.lit(1.0)), "features")
    scores, _ = scoring.score(spark, features)
    related = relational.relational_scores(spark, features, B.homes(spark, sf_dir).withColumn("dst", F.col("dst").cast("string")))
    return scoring.ensemble(spark, scores, related)


@query()
def person_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer scored again on the frozen bundle, read back from the shared folder."""
    features = materialise(spark, B.customer_features(spark, sf_dir), "features")
    _, bundle = scoring.score(spark, features)
    path = f"{shared_dir(spark)}/quillspan-bundle-{uuid.uuid4().hex[:12]}"
    bundle.save(spark, path)
    people = features.withColumnRenamed("entity_id", "person").select("person", *X.DEFAULTS)
    return scoring.score_people(spark, people, scoring.Bundle.load(spark, path))


@query()
def resolved_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S12, J1-J4, M1, M2, Q1-Q7, G1-G4, W5, W6 end to end: as many generated people as there are customers, resolved to
    entities, with the scorecard."""
    people = table(spark, sf_dir, "customer").count()
    tables, links, _ = synth.registries(materialise(spark, synth.population(spark, people), "population"))
    held = {k: materialise(spark, v, k) for k, v in tables.items()}
    records = materialise(spark, R.unified(held), "records")
    mentions, _ = resolve.resolve(spark, records)
    return evaluate.pair_counts(mentions, links, "record_id", "entity_id", "person_id")


_LETTERS = "".join(N.URDU_CLASSES)


@query(f"""WITH k AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^{_LETTERS} ]', '', 'g') AS k FROM part)
    SELECT p_partkey, regexp_matches(k, '[{_LETTERS}]') AS urdu, array_to_string(list_transform(list_filter(generate_series(1, length(k)), lambda i: i = 1 OR substr(k, i, 1) <> substr(k, i - 1, 1)), lambda i: substr(k, i, 1)), '') AS skeleton FROM (SELECT p_partkey, replace(k, ' ', '') AS k FROM k)""")
def urdu_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names written in Arabic letters, one for each consonant class; the oracle keeps the classes."""
    letters = "".join(v[0] for v in N.URDU_CLASSES.values())
    written = F.translate(F.regexp_replace(F.lower("p_name"), f"[^{_LETTERS}]", ""), _LETTERS, letters)
    return table(spark, sf_dir, "part").select("p_partkey", N.is_urdu(written).alias("urdu"), N.urdu_skeleton(written).alias("skeleton"))


@query("""WITH p AS (SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON y.c_custkey - x.c_custkey IN (1, 12, 900))
    SELECT a, b, CASE WHEN b - a = 900 AND a % 6 <> 5 THEN 'addr_exact' WHEN b - a IN (12, 900) THEN 'addr_area_match' ELSE 'addr_diff' END AS band FROM p""")
def address_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 on written addresses whose house, street and city follow from the key."""
    parsed = _styled(spark, sf_dir).select("c_custkey", N.normalize_address(F.col("address")).alias("addr"))
    steps = F.explode(F.array(F.lit(1), F.lit(12), F.lit(900)))
    one = parsed.select(F.col("c_custkey").alias("a"), F.col("addr").alias("x"), steps.alias("step")).withColumn("b", F.col("a") + F.col("step"))
    both = one.join(parsed.select(F.col("c_custkey").alias("b"), F.col("addr").alias("y")), "b")
    both = both.withColumn("area", P.token_similarity(F.col("x.area_tokens"), F.col("y.area_tokens")))
    return both.select("a", "b", P.band_address(F.col("x"), F.col("y"), F.col("area")).alias("band"))


@query("SELECT c_custkey AS query_id, round(count(*) OVER (ORDER BY c_acctbal RANGE UNBOUNDED PRECEDING) / count(*) OVER (), 9) AS share FROM customer")
def population_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer, the share of the population at most as large, from cumulative counts."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), "c_acctbal")
    return ranking.shares_at_most(spark, c, c, {"c_acctbal": "share"}).select("query_id", F.round("share", 9).alias("share"))


_PART_TOKENS = "list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '')"
_SQUEEZED = "array_to_string(list_transform(list_filter(generate_series(1, length(k)), lambda i: i = 1 OR substr(k, i, 1) <> substr(k, i - 1, 1)), lambda i: substr(k, i, 1)), '')"


@query(f"""WITH w AS (SELECT p_partkey, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (SELECT p_partkey, {_PART_TOKENS} AS ts FROM part)),
    s AS (SELECT p_partkey, pos, t, {_SKELETON} AS k FROM w)
    SELECT p_partkey, string_agg(t, ' ' ORDER BY pos) AS tokens, string_agg({_SQUEEZED}, ' ' ORDER BY pos) FILTER (k <> '') AS skeletons FROM s GROUP BY 1""")
def honoured_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part names written with none to three honorifics and odd spacing; the oracle knows the bare names."""
    bare = F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z]+", " "))
    before = F.element_at(F.array(*[F.lit(x) for x in ("", "Dr. ", "  MST  Syeda ", "Prof., Engr.,HAJI ")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.concat(before, F.initcap(F.replace(bare, F.lit(" "), F.lit("  "))), F.lit(" ."))
    shown = table(spark, sf_dir, "part").where(bare != "").select("p_partkey", F.array_join(N.name_tokens(name), " ").alias("tokens"), F.nullif(F.array_join(N.name_skeletons(name), " "), F.lit("")).alias("skeletons"))
    return shown


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 <> 5 THEN ['rawalpindi', 'islamabad', 'lahore', 'karachi', 'peshawar', 'faisalabad', 'multan', 'sialkot', 'hyderabad', 'gujranwala', 'quetta', 'bahawalpur'][c_custkey % 12 + 1]
    || ':' || (c_custkey % 900 + 1) || ':' || (c_custkey % 60 + 1) END AS key FROM customer""")
def address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the block key of six written forms of an address; null without a house."""
    return _styled(spark, sf_dir).select("c_custkey", N.address_key(N.normalize_address(F.col("address"))).alias("key"))


@query(f"SELECT p_partkey, array_to_string(list_transform({_PART_TOKENS}, lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '-') || '7X' AS shown FROM part")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a capital after every character that is no letter, small letters elsewhere."""
    text = F.concat(F.upper(F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z]+", " "))), F.lit(" 7x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(F.replace(X.title(text), F.lit(" 7X"), F.lit("7X")), F.lit(" "), F.lit("-")).alias("shown"))


@query(f"""WITH w AS (SELECT p_partkey AS k, length(array_to_string({_PART_TOKENS}, '')) AS n FROM part), j AS (SELECT k, n, ((n - 1) / n::DOUBLE * 2 + 1) / 3 AS j FROM w WHERE n >= 8),
    s AS (SELECT k, CASE k % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN j + 0.1::DOUBLE * 4 * (1 - j) WHEN 2 THEN (2 + (n + 1.5::DOUBLE) / (n + 3)) / 3 ELSE 0 END AS v FROM j)
    SELECT k, round(v, 9) AS similarity, CASE WHEN v >= 0.92 THEN 'name_exact' WHEN v >= 0.78 THEN 'name_close' WHEN v >= 0.6 THEN 'name_weak' ELSE 'name_diff' END AS name,
        CASE WHEN k % 7 <> 0 THEN CASE WHEN v >= 0.85 THEN 'father_match' WHEN v >= 0.6 THEN 'father_weak' ELSE 'father_diff' END END AS father FROM s""")
def name_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against themselves, with another last letter, with three first signs in turn (one and a half
    transpositions), and against signs they do not have; every seventh has no father."""
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.regexp_replace(F.lower("p_name"), "[^a-z]+", "").alias("t")).where("length(t) >= 8")
    a, b = F.concat(F.when(F.col("k") % 4 == 2, "123").otherwise(""), F.col("t")), F.col("t")
    forms = [b, F.concat(F.expr("substring(t, 1, length(t) - 1)"), F.lit("#")), F.concat(F.lit("231"), b), F.regexp_replace(b, ".", "#")]
    both = words.select("k", a.alias("a"), F.element_at(F.array(*forms), (F.col("k") % 4 + 1).cast("int")).alias("b"))
    both = both.withColumn("v", P.token_similarity(F.array("a"), F.array("b")))
    father = F.when(F.col("k") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("a"))
    return both.select("k", F.round("v", 9).alias("similarity"), P.band_name(F.col("v")).alias("name"), P.band_father(F.col("v"), father, F.array("b")).alias("father"))


@query("""SELECT c_custkey, ['cnic_exact', 'cnic_close', 'cnic_close', 'cnic_masked_match', 'cnic_diff_prefix', 'cnic_diff', NULL][c_custkey % 7 + 1] AS band FROM customer""")
def number_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 (with P2): a number against itself, with one digit changed, one lost and restored by a swap, masked, masked with
    another prefix, changed in three places, and missing; the oracle knows which."""
    d = F.lpad((F.col("c_custkey") * 7919 % 10_000_000).cast("string"), 13, "1203456")
    other = lambda at: F.concat(F.substring(d, 1, at - 1), ((F.substring(d, at, 1).cast("int") + 1) % 10).cast("string"), F.substring(d, at + 1, 13))
    swapped = F.concat(F.lit("21"), F.substring(d, 3, 11))
    masked = lambda x: F.concat(F.substring(x, 1, 5), F.lit("-XXXXXXX-"), F.substring(x, 13, 1))
    three = F.concat(F.lit("9"), F.substring(d, 2, 2), F.lit("9"), F.substring(d, 5, 1), F.lit("9"), F.substring(d, 7, 7))
    forms = [d, other(9), swapped, masked(d), masked(F.concat(F.lit("9"), F.substring(d, 2, 12))), three, F.lit(None).cast("string")]
    written = F.element_at(F.array(*forms), (F.col("c_custkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", P.band_cnic(N.normalize_cnic(d), N.normalize_cnic(written)).alias("band"))


@query("""WITH c AS (SELECT c_custkey AS k, 'f' || c_custkey % 7 AS f, 'l' || c_custkey % 11 AS l, ['lahore', 'karachi', ''][c_custkey % 3 + 1] AS city FROM customer)
    SELECT k, array_to_string(list_filter([CASE WHEN k % 4 <> 0 THEN 'C:' || lpad(CAST(k AS VARCHAR), 13, '1') END, CASE WHEN k % 5 <> 0 THEN 'P:0' || k END, CASE WHEN k % 2 = 0 THEN 'N:' || f || '|' || l END,
        CASE WHEN k % 2 = 0 AND city <> '' THEN 'NC:' || f || '|' || l || '|' || city END, CASE WHEN k % 2 = 1 AND city <> '' THEN 'N1:' || l || '|' || city END,
        CASE WHEN city <> '' THEN 'A:' || city || ':' || k % 50 || ':None' END, CASE WHEN k % 6 <> 0 THEN 'D:1990-01-0' || (k % 9 + 1) || '|' || l END], lambda x: x IS NOT NULL), ' ') AS keys FROM c""")
def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven kinds of block keys of records with missing parts and given-name prefixes."""
    k = F.col("c_custkey")
    text = lambda column: column.cast("string")
    first, last = F.concat(F.lit("f"), text(k % 7)), F.concat(F.lit("l"), text(k % 11))
    city = F.element_at(F.array(F.lit("lahore"), F.lit("karachi"), F.lit("")), (k % 3 + 1).cast("int"))
    records = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(k % 2 == 0, F.array(first, last)).otherwise(F.array(F.lit("mhmd"), last)).alias("name_skeletons"),
        city.alias("city"),
        F.when(k % 6 != 0, F.concat(F.lit("1990-01-0"), text(k % 9 + 1))).otherwise("").alias("dob"),
        F.when(k % 5 != 0, F.concat(F.lit("0"), text(k))).alias("phone"),
        F.struct(F.when(k % 4 != 0, F.lpad(text(k), 13, "1")).alias("digits")).alias("cnic"),
        F.struct((k % 50).cast("int").alias("house"), F.lit(None).cast("int").alias("street"), F.nullif(city, F.lit("")).alias("city")).alias("addr"),
    )
    return records.select(F.col("c_custkey").alias("k"), F.array_join(blocking.block_keys(), " ").alias("keys"))
