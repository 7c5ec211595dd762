"""Operator 8, mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Only DataFrame and SQL functions run here. Documents are summed to cells of (source, lang, topic); the cells' token weights
are raked in turn to the target shares of each of the three marginals, ``SWEEPS`` times and on until every marginal is
within ``RESIDUAL`` of its target (or ``MOST_SWEEPS`` are done: contradictory targets have no solution; ``margins`` shows
what is left). Targets are tables ``margin, target``; without them a target share is the present share raised to an
exponent below 1 and normalised, which lifts small groups. Groups without a target keep their tokens. A cell's weight is its
raked tokens over its tokens. Probabilities start at ``min(1, rate * weight)``, where the rate makes the expected tokens
``BUDGET`` of all. The draw is a digest of the id, so a rerun keeps the same rows.

Up to ``FEW_CELLS`` cells (counted) are raked in one partition, where a sweep is window sums without a shuffle; more stay
distributed, where each sum is an exchange.

A cell at probability 1 falls short of its raked tokens, which would miss the targets where cells are scarce. So the
probabilities are raked themselves, ``BOUND_SWEEPS`` times: the shortfall goes to the free cells of the same groups, and a
group whose target exceeds its tokens is kept whole, its excess shared by the others in proportion to their targets.

Tokens are counted as quarters of UTF-8 bytes, rounded up. The topic is a class of layout read from the whole text.

Defined results: a null source, lang or topic is a group of its own (the empty string); null and empty texts have no
tokens, and a cell without tokens has weight 1; a null id draws as the empty string; repeated rows share their fate; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.sources.shared import materialise, sized_broadcast, small_enough, text_or_empty

MARGINS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
SWEEPS, MOST_SWEEPS, RESIDUAL, BUDGET = 8, 64, 1e-4, 0.8
#: Sweeps that are one plan; the cells are written after each.
AT_ONCE = 4
#: Rounds after which the SQL's rate stands still (here it runs until it does).
RATE_ROUNDS = 6
#: Sweeps over the probabilities, which the bound of 1 slows down.
BOUND_SWEEPS = 16
#: A chance from which a cell counts as whole, so that rounding does not decide it.
WHOLE = 1 - 1e-9
#: Cells that are raked in one partition and may be broadcast to the documents; beyond it both shuffle.
FEW_CELLS = 100_000
#: Topic, character and the least share of it in a text, in order of precedence.
LAYOUTS = [("tabular", "|", 0.02), ("emphatic", "!", 0.05), ("symbolic", "&", 0.01)]


def tokens_of(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("long")


def topic_of(text: Column) -> Column:
    topic = F.lit("prose")
    for name, mark, share in reversed(LAYOUTS):
        topic = F.when(F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit(""))) > share * F.length(text), name).otherwise(topic)
    return topic


def measured(docs: DataFrame, id_col: str, text_col: str, keep: bool = False) -> DataFrame:
    text = text_or_empty(text_col)
    whole = [F.struct("*").alias("doc")] if keep else []
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty("source").alias("source"), text_or_empty("lang").alias("lang"), topic_of(text).alias("topic"), tokens_of(text).alias("n_tokens"), *whole)


def tempered(cells: DataFrame, margin: str, exponent: float) -> DataFrame:
    """``margin, target``: shares of the present tokens, each raised to ``exponent``."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("own"))
    raised = sums.where("own > 0").select(margin, F.pow("own", F.lit(exponent)).alias("raised"))
    total = raised.agg(F.sum("raised").alias("all_raised"))
    return raised.join(F.broadcast(total)).select(margin, (F.col("raised") / F.col("all_raised")).alias("target"))


def _with_targets(cells: DataFrame, targets: dict[str, DataFrame], name: str) -> DataFrame:
    """``cells`` with a column ``name_margin`` for each margin; null where a group has no target."""
    for margin, target in targets.items():
        cells = cells.join(target.select(margin, F.col(name).alias(f"{name}_{margin}")), margin, "left")
    return cells


def together(cells: DataFrame) -> DataFrame:
    """``cells`` in one partition if they are few."""
    return cells.coalesce(1) if small_enough(cells, FEW_CELLS) else cells


def _sum_of(column: str | Column, margin: str) -> Column:
    return F.sum(column).over(Window.partitionBy(margin))


def rake(spark: SparkSession, cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``cells`` with ``raked``: tokens whose marginals are the targets, or as near as they get."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = _with_targets(cells.withColumn("raked", F.col("tokens").cast("double")), targets, "target")
    for done in range(SWEEPS, MOST_SWEEPS + 1, SWEEPS):
        for k in range(SWEEPS):
            now = together(now) if k % AT_ONCE == 0 else now
            for margin in targets:
                wanted = F.col(f"target_{margin}") * F.lit(float(total)) / _sum_of("raked", margin)
                now = now.withColumn("raked", F.col("raked") * F.coalesce(wanted, F.lit(1.0)))
            now = materialise(spark, now, "raked") if k % AT_ONCE == AT_ONCE - 1 else now
        if done == MOST_SWEEPS or not total or residual(now, targets, "raked") <= RESIDUAL:
            break
    return now.drop(*[f"target_{m}" for m in targets])


def margins(cells: DataFrame, targets: dict[str, DataFrame], mass: str = "raked") -> DataFrame:
    """``margin, name, target, share``: what each group should have, and its share of ``mass``."""
    total = cells.agg(F.sum(mass).alias("all_mass"))
    out = [
        cells.groupBy(m).agg(F.sum(mass).alias("own")).join(t, m).join(F.broadcast(total)).select(F.lit(m).alias("margin"), F.col(m).alias("name"), "target", (F.col("own") / F.col("all_mass")).alias("share"))
        for m, t in targets.items()
    ]
    return reduce(DataFrame.unionByName, out)


def residual(cells: DataFrame, targets: dict[str, DataFrame], mass: str = "raked") -> float:
    """The largest gap between a group's share and its target."""
    return margins(cells, targets, mass).agg(F.max(F.abs(F.col("share") - F.col("target")))).first()[0] or 0.0


def rate_of(cells: DataFrame, budget: float = BUDGET) -> float:
    """The factor on weights whose capped probabilities keep ``budget`` of the tokens in expectation."""
    rate, full_tokens = budget, -1
    while True:  # each round caps more cells or ends
        full = F.col("weight") * rate >= 1
        row = cells.agg(F.sum("tokens").alias("all"), F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("tokens") * F.col("weight"))).alias("rest")).first()
        if not row["all"] or not row["rest"] or (row["full"] or 0) == full_tokens:
            return rate
        full_tokens = row["full"] or 0
        rate = max(budget * row["all"] - full_tokens, 0.0) / row["rest"]


def reachable(spark: SparkSession, cells: DataFrame, margin: str, target: DataFrame, budget: float) -> DataFrame:
    """``margin, mass``: expected tokens of each group, none above its own, that sum to ``budget`` of all."""
    total = cells.agg(F.sum("tokens").alias("all_tokens"))
    groups = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).where("tokens > 0").join(target, margin).join(F.broadcast(total))
    groups = materialise(spark, groups.withColumn("weight", F.col("target") * F.col("all_tokens") / F.col("tokens")), f"mass-{margin}")
    return groups.select(margin, (F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * rate_of(groups, budget))).alias("mass"))


def bound(spark: SparkSession, cells: DataFrame, targets: dict[str, DataFrame], rate: float, budget: float = BUDGET, sweeps: int = BOUND_SWEEPS) -> DataFrame:
    """``cells`` with ``chance``, whose part up to 1 is the probability: expected tokens that approach the reachable masses.

    In each group the free cells are scaled to what the capped ones leave of its mass; all are, if these alone exceed it.
    """
    masses = {m: reachable(spark, cells, m, t, budget) for m, t in targets.items()}
    now = _with_targets(cells.withColumn("chance", F.col("weight") * rate), masses, "mass")
    names = now.columns
    for done in range(sweeps):
        if done % AT_ONCE == 0:
            now = together(materialise(spark, now, "bound") if done else now)
        for margin in masses:
            whole = F.col("chance") >= WHOLE
            full, free = F.when(whole, F.col("tokens")).otherwise(0), F.when(~whole, F.col("chance") * F.col("tokens")).otherwise(0.0)
            now = now.select(*names, _sum_of(full, margin).alias("full"), _sum_of(free, margin).alias("free"))
            mass = F.col(f"mass_{margin}")
            left = mass - F.col("full")
            scale = F.when((left > 0) & (F.col("free") > 0), left / F.col("free")).when(left < 0, mass / (F.col("full") + F.col("free"))).otherwise(1.0)
            # Chances above 1 count as 1 when their group has too much, or they would stay above it.
            held = F.when(left < 0, F.least(F.lit(1.0), "chance") * scale).when(whole, F.col("chance")).otherwise(F.col("chance") * scale)
            now = now.withColumn("chance", F.coalesce(F.when(mass.isNotNull(), held), "chance")).select(*names)
    return materialise(spark, now, "bound").drop(*[f"mass_{m}" for m in masses])


def draw(id_col: Column) -> Column:
    """A number in [0, 1) from the id's digest."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def weigh(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, keep: bool = False) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, probability, kept`` of every row (and ``doc``, if ``keep``)."""
    cells = measured(docs, id_col, text_col).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    cells = materialise(spark, cells, "cells")
    found = targets or {m: materialise(spark, tempered(cells, m, e), f"target-{m}") for m, e in MARGINS.items()}
    raked = rake(spark, cells, found)
    weighed = materialise(spark, raked.withColumn("weight", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(1.0)), "weights")
    chance = bound(spark, weighed, found, rate_of(weighed, budget), budget)
    small = sized_broadcast(chance.select(*MARGINS, "weight", "chance"), FEW_CELLS)
    rows = measured(docs, id_col, text_col, keep).join(small, list(MARGINS))
    rows = rows.withColumn("probability", F.least(F.lit(1.0), "chance")).drop("chance")
    return rows.withColumn("kept", (draw(F.col("doc_id")) < F.col("probability")).cast("int"))


def sample(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs``."""
    return weigh(spark, docs, keep=True).where("kept = 1").select("doc.*")


def oracle() -> str:
    """The same in DuckDB SQL, sweeps and rounds written out."""

    def rates(cells: str, name: str) -> list[str]:
        fit = f"greatest({BUDGET} * sum(tokens) - coalesce(sum(tokens) FILTER (weight * rate >= 1), 0), 0) / sum(tokens * weight) FILTER (weight * rate < 1)"
        first = f"{name}0 AS MATERIALIZED (SELECT CAST({BUDGET} AS DOUBLE) AS rate)"
        return [first, *[f"{name}{k + 1} AS MATERIALIZED (SELECT coalesce({fit}, any_value(rate)) AS rate FROM {cells}, {name}{k})" for k in range(RATE_ROUNDS)]]

    layout = " ".join(f"WHEN length(t) - length(replace(t, '{mark}', '')) > {share} * length(t) THEN '{name}'" for name, mark, share in LAYOUTS)
    dims = ", ".join(MARGINS)
    steps = [
        "d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents)",
        f"m AS MATERIALIZED (SELECT doc_id, source, lang, CASE {layout} ELSE 'prose' END AS topic, CAST(ceil(octet_length(encode(t)) / 4) AS BIGINT) AS n_tokens FROM d)",
        f"c AS MATERIALIZED (SELECT {dims}, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS raked FROM m GROUP BY ALL)",
        "a AS MATERIALIZED (SELECT sum(tokens) AS t FROM c)",
    ]
    for margin, exponent in MARGINS.items():
        steps.append(f"t_{margin} AS MATERIALIZED (SELECT {margin}, pow(sum(tokens), {exponent}) AS r FROM c GROUP BY 1 HAVING sum(tokens) > 0)")
        steps.append(f"g_{margin} AS MATERIALIZED (SELECT {margin}, r / (SELECT sum(r) FROM t_{margin}) AS target FROM t_{margin})")
    last = "c"
    for k in range(SWEEPS):
        for margin in MARGINS:
            name = f"r{k}_{margin}"
            others = ", ".join(f"x.{m}" for m in MARGINS)
            steps.append(f"{name} AS MATERIALIZED (SELECT {others}, x.tokens, x.raked * coalesce(g.target * (SELECT t FROM a) / s.own, 1) AS raked FROM {last} x LEFT JOIN g_{margin} g USING ({margin}) LEFT JOIN (SELECT {margin}, sum(raked) AS own FROM {last} GROUP BY 1) s USING ({margin}))")
            last = name
    steps.append(f"w AS MATERIALIZED (SELECT {dims}, tokens, CASE WHEN tokens > 0 THEN raked / tokens ELSE 1 END AS weight FROM {last})")
    steps += rates("w", "q")
    for margin in MARGINS:
        steps.append(f"h_{margin} AS MATERIALIZED (SELECT {margin}, sum(tokens) AS tokens, any_value(target) * (SELECT t FROM a) / sum(tokens) AS weight FROM w JOIN g_{margin} USING ({margin}) GROUP BY 1 HAVING sum(tokens) > 0)")
        steps += rates(f"h_{margin}", f"q_{margin}_")
        steps.append(f"m_{margin} AS MATERIALIZED (SELECT {margin}, tokens * least(1, weight * (SELECT rate FROM q_{margin}_{RATE_ROUNDS})) AS mass FROM h_{margin})")
    steps.append(f"b AS MATERIALIZED (SELECT {dims}, tokens, weight, weight * rate AS chance FROM w, q{RATE_ROUNDS})")
    last = "b"
    for k in range(BOUND_SWEEPS):
        for margin in MARGINS:
            name = f"b{k}_{margin}"
            sums = f"SELECT {margin}, coalesce(sum(tokens) FILTER (chance >= {WHOLE!r}), 0) AS whole, coalesce(sum(tokens * chance) FILTER (chance < {WHOLE!r}), 0) AS free FROM {last} GROUP BY 1"
            scaled = f"CASE WHEN mass < whole THEN least(1, chance) * mass / (whole + free) WHEN chance < {WHOLE!r} AND mass > whole AND free > 0 THEN chance * (mass - whole) / free ELSE chance END"
            steps.append(f"{name} AS MATERIALIZED (SELECT {dims}, tokens, weight, {scaled} AS chance FROM {last} LEFT JOIN m_{margin} USING ({margin}) LEFT JOIN ({sums}) USING ({margin}))")
            last = name
    return f"WITH {', '.join(steps)} SELECT doc_id, topic, n_tokens, round(weight, 6) AS weight, round(least(1.0, chance), 6) AS probability, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < least(1.0, chance) AS INTEGER) AS kept FROM m JOIN {last} USING ({dims})"
