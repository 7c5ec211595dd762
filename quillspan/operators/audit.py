"""Floors by entity, audit records and notices.

A notice's text is a native template; records, links and reasons are gathered by entity for the chosen entities only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import income as X

#: Fixed value: the notice's second title.
URDU_TITLE = "ٹیکس تعمیل جائزہ نوٹس"


def display_names(mentions: DataFrame) -> DataFrame:
    """The first non-empty name and city of each entity, in reading order, capitalised."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ord")))
    return mentions.groupBy("entity_id").agg(X.title(F.coalesce(first("norm_name"), F.lit(""))).alias("name"), X.title(F.coalesce(first("city"), F.lit(""))).alias("city"))


def entity_floors(features: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row an entity, with ``factors`` and ``notes``."""
    named = X.with_floors(features).join(display_names(mentions), "entity_id", "left")
    shown = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Entity "), F.col("entity_id").cast("string")))
    return named.select("entity_id", shown.alias("display_name"), F.coalesce("city", F.lit("")).alias("city"), "estimated_income_pkr", "declared_income_pkr", "filer_status", "tax_paid_pkr", "expected_tax_pkr", "tax_gap_pkr", "rule_deviation_score", "band", "factors", "notes")


def band_summary(floors: DataFrame) -> DataFrame:
    """Entities and gap of each band."""
    return floors.groupBy("band").agg(F.count("*").alias("entities"), F.sum("tax_gap_pkr").alias("gap"))


def audits(scores: DataFrame, floors: DataFrame, mentions: DataFrame, fields: DataFrame, evidence: DataFrame, top: int = 25) -> DataFrame:
    """The ``top`` entities by headline score with records, links inside the entity, factors and reasons."""
    chosen = scores.orderBy(F.desc("deviation_score_combined"), "entity_id").limit(top)
    wanted = F.broadcast(chosen.select("entity_id"))  # at most ``top`` rows
    theirs = mentions.join(wanted, "entity_id").join(fields, "record_id", "left")
    records = theirs.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("ord", "record_id", F.col("source").alias("registry"), F.col("raw_name").alias("name"), F.map_entries("fields").alias("fields")))).alias("records"), F.countDistinct("source").alias("registries"))
    one, two = (theirs.select(F.col("record_id").alias(f"record_{s}"), F.col("entity_id").alias(f"e_{s}")) for s in "ab")
    inside = evidence.join(one, "record_a").join(two, "record_b").where("e_a = e_b")
    link = F.struct(F.concat_ws(" <-> ", "record_a", "record_b").alias("records"), F.coalesce("decided_by", F.lit("tier1")).alias("decided_by"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.col("posterior").alias("confidence"))
    links = inside.groupBy(F.col("e_a").alias("entity_id")).agg(F.array_sort(F.collect_list(link)).alias("links"))
    whole = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0.0)), 0).cast("long")
    ml = F.struct(whole("deviation_score_combined").alias("deviation_score"), whole("deviation_score").alias("deviation_score_if"), whole("gnn_score").alias("gnn_score"), F.from_json("audit_trail", "array<string>").alias("reasons"))
    check = F.struct(*[F.col(c) for c in ("estimated_income_pkr", "declared_income_pkr", "filer_status", "tax_paid_pkr", "expected_tax_pkr", "tax_gap_pkr", "rule_deviation_score", "band")])
    plain = chosen.select("entity_id", "deviation_score", "deviation_score_combined", "gnn_score", "audit_trail").join(floors, "entity_id", "left").join(records, "entity_id", "left").join(links, "entity_id", "left")
    return plain.select("entity_id", "display_name", "city", "records", "registries", F.coalesce("links", F.expr("array()").cast(links.schema["links"].dataType)).alias("links"), F.col("factors").alias("lifestyle_factors"), "notes", ml.alias("ml"), check.alias("cross_check"))


def notice(audit: str = "") -> Column:
    """K7: the Markdown notice of an audit row."""
    c, n = F.col, lambda x: F.format_number(x, 0)
    ml, check = c("ml"), c("cross_check")
    listed = lambda items, text, empty: F.when(F.size(items) > 0, F.array_join(F.transform(items, text), "\n")).otherwise(F.lit(empty))
    confidence = lambda l: F.coalesce(F.format_string(" (p=%.3f)", l["confidence"]), F.lit(""))
    parts = [
        F.lit(f"# Profile for review / {URDU_TITLE}\n"),
        F.format_string("**Entity:** %d — %s, %s", c("entity_id"), c("display_name"), c("city")),
        F.format_string("**Deviation score:** %d/100 (forest %d, relational %d)\n", ml["deviation_score"], ml["deviation_score_if"], ml["gnn_score"]),
        F.lit("## 1. Why this profile was flagged"),
        listed(ml["reasons"], lambda r: F.concat(F.lit("- "), r), "- (no reasons recorded)"),
        F.format_string("\n## 2. Identity resolution\nAssembled from %d records of %d registries.\n", F.size("records"), c("registries")),
        listed(c("records"), lambda r: F.concat(F.lit("- `"), r["record_id"], F.lit("` ("), r["registry"], F.lit("): "), r["name"]), "- (no records)"),
        F.lit("\n### Link evidence"),
        listed(c("links"), lambda l: F.concat(F.lit("- "), l["records"], F.lit(" — "), l["decided_by"], confidence(l), F.lit(": "), l["evidence"]), "_No link evidence._"),
        F.lit("\n## 3. Income floors"),
        listed(c("lifestyle_factors"), lambda f: F.concat(F.lit("- **"), f["factor"], F.lit("**: at least "), n(f["implied_income"]), F.lit(" PKR/yr — "), f["detail"]), "- (none)"),
        F.concat(F.lit("\n- Estimated income: "), n(check["estimated_income_pkr"]), F.lit(" PKR/yr\n- Declared income: "), n(check["declared_income_pkr"]), F.lit(" PKR ("), check["filer_status"], F.lit(")\n- Expected tax: "), n(check["expected_tax_pkr"]), F.lit(" PKR; paid: "), n(check["tax_paid_pkr"]), F.lit(" PKR\n- Gap: "), n(check["tax_gap_pkr"]), F.lit(" PKR (band "), check["band"], F.lit(")")),
        F.when(F.size("notes") > 0, F.concat(F.lit("\n## 4. Observations\n"), F.array_join(F.transform("notes", lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise(""),
    ]
    return F.concat_ws("\n", *parts)


def write_notices(rows: DataFrame, path: str) -> None:
    """K7: JSON and Markdown, one row an entity. A PDF is left to tools outside Spark."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/json")
    rows.select("entity_id", notice().alias("markdown")).write.mode("overwrite").parquet(f"{path}/markdown")
