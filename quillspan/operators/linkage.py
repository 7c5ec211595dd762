"""The self-calibrating linkage of records to entities.

Pairs are compared once and written; each later tier reads them. Weights are a dictionary of fewer than thirty numbers.
Sampling orders rows by a hash, so a rerun draws the same pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import similarity as P
from quillspan.functions.normalize import address_key
from quillspan.operators.blocking import block_index, pairs_of_blocks
from quillspan.operators.components import connected_components
from quillspan.sources.shared import discard, materialise

# Fixed values of the linkage model.
CLIP, SMOOTH, ANCHORS, RANDOMS, FEEDBACK_WEIGHT = 8.0, 0.5, 4000, 30_000, 50
MATCH, BORDERLINE, PROMOTE = 0.95, 0.20, 0.97
HARD = ["cnic_exact", "cnic_close", "phone_match", "addr_exact", "addr_house_match"]
TIER2_VETO = ["cnic_diff", "father_diff", "city_diff", "dob_diff"]
TIER2_SUPPORT = ["father_match", "cnic_masked_match", "addr_exact", "addr_house_match", "addr_area_match", "phone_match", "dob_match"]
TIER2_HARD = ["addr_exact", "addr_house_match", "phone_match"]
CROSS_SCRIPT_COSINE, TIER2_ANCHORS, TIER2_RANDOMS = 0.65, 1500, 4000
NAME_BANDS = ["name_exact", "name_close", "name_weak", "name_diff"]
EMBEDDING_BANDS = ["emb_high", "emb_mid", "emb_low", "emb_diff"]
SHARED_BITS = {"cnic": 8.0, "phone": 6.0, "addr": 3.0, "dob": 4.0}
SAME_FATHER = 0.75

COMPARED = ["record_id", "registry", "raw_name", "name_tokens", "name_skeletons", "father_skeletons", "cnic", "dob", "addr", "phone", "city"]


def compare(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``a, b`` with both records' columns (suffixes _a, _b) and ``bands``."""
    side = lambda s: records.select(*[F.col(c).alias(f"{c}_{s}") for c in COMPARED])
    both = pairs.join(side("a"), F.col("a") == F.col("record_id_a")).join(side("b"), F.col("b") == F.col("record_id_b"))
    c = F.col
    area = lambda s: F.coalesce(c(f"addr_{s}")["area_tokens"], F.array().cast("array<string>"))
    lists = [*[(c(f"{n}_a"), c(f"{n}_b")) for n in ("name_skeletons", "name_tokens", "father_skeletons")], (area("a"), area("b"))]
    both = both.withColumn("_similarities", P.token_similarities_of(lists))
    both = both.withColumns({n: F.get("_similarities", k) for k, n in enumerate(("_skeletons", "_tokens", "_father", "_area"))})
    bands = P.observed(
        P.band_name(F.greatest("_skeletons", "_tokens")),
        P.band_father(c("_father"), c("father_skeletons_a"), c("father_skeletons_b")),
        P.band_cnic(c("cnic_a"), c("cnic_b")),
        P.band_equal(c("dob_a"), c("dob_b"), "dob"),
        P.band_address(c("addr_a"), c("addr_b"), c("_area")),
        P.band_equal(c("phone_a"), c("phone_b"), "phone"),
        P.band_equal(c("city_a"), c("city_b"), "city"),
    )
    return both.select("a", "b", "registry_a", "registry_b", "raw_name_a", "raw_name_b", bands.alias("bands"))


def anchor_pairs(records: DataFrame, cap: int | None = ANCHORS) -> DataFrame:
    """Consecutive records of each full number shared by two to eight records, at most ``cap`` by hash order."""
    known = records.where("cnic.digits IS NOT NULL").select("ord", "record_id", F.col("cnic.digits").alias("digits"))
    sizes = known.groupBy("digits").count().where("count BETWEEN 2 AND 8").select("digits")
    after = F.lead("record_id").over(Window.partitionBy("digits").orderBy("ord"))
    pairs = known.join(sizes, "digits").withColumn("b", after).where("b IS NOT NULL").select(F.col("record_id").alias("a"), "b")
    return pairs if cap is None else pairs.orderBy(F.xxhash64("a", "b", F.lit(7)), "a", "b").limit(cap)


def random_pairs(spark: SparkSession, records: DataFrame, n: int = RANDOMS, seed: int = 1) -> DataFrame:
    """``n`` seeded pairs of different records without equal full numbers (fewer where there are under two records)."""
    total = records.count()
    if total < 2:
        return spark.createDataFrame([], "a string, b string")
    numbered = records.select("record_id", "cnic.digits", (F.row_number().over(Window.orderBy("ord")) - 1).alias("i"))
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed * 10 + k)), F.lit(total)).cast("int")
    drawn = spark.range(n + n // 4 + 100).select("id", draw(0).alias("x"), draw(1).alias("y"))
    one, two = (numbered.select(F.col("i").alias(p), F.col("record_id").alias(s), F.col("digits").alias("d" + s)) for p, s in (("x", "a"), ("y", "b")))
    pairs = drawn.where("x <> y").join(one, "x").join(two, "y").where("NOT coalesce(da = db, false)")
    return pairs.orderBy("id").limit(n).select("a", "b")


@dataclass
class Model:
    """M1: weights in bits by band, and the prior."""

    weights: dict[str, float]
    prior_logodds: float
    stats: dict[str, int] = field(default_factory=dict)

    def score(self, bands: Column) -> Column:
        return P.score_bits(bands, self.weights)

    def posterior(self, score: Column) -> Column:
        return P.posterior(score, self.prior_logodds)


def band_counts(compared: DataFrame) -> dict[str, int]:
    """Pairs that show each band."""
    return {r["band"]: r["count"] for r in compared.select(F.explode("bands").alias("band")).groupBy("band").count().collect()}


def log_weight(m: float, n_m: float, u: float, n_u: float) -> float:
    return max(-CLIP, min(CLIP, math.log2(((m + SMOOTH) / (n_m + 2 * SMOOTH)) / ((u + SMOOTH) / (n_u + 2 * SMOOTH)))))


def fit(spark: SparkSession, records: DataFrame, candidates: int, feedback: DataFrame | None = None, anchors: int | None = ANCHORS, randoms: int = RANDOMS) -> Model:
    """M1, M8: band frequencies among anchors and random pairs, reviewed pairs counting fifty times, then fixed overrides."""
    samples = {"m": anchor_pairs(records, anchors), "u": random_pairs(spark, records, randoms)}
    if feedback is not None:
        samples |= {k: feedback.where(F.col("label") == label).select(F.col("record_a").alias("a"), F.col("record_b").alias("b")) for k, label in (("fm", "same"), ("fu", "different"))}
    compared = {k: materialise(spark, compare(p, records).select("bands"), f"sample-{k}") for k, p in samples.items()}
    size, seen = {k: d.count() for k, d in compared.items()}, {k: band_counts(d) for k, d in compared.items()}
    n_m = max(size["m"], 1) + FEEDBACK_WEIGHT * size.get("fm", 0)
    n_u = max(size["u"], 1) + FEEDBACK_WEIGHT * size.get("fu", 0)
    total = lambda k, f, band: seen[k].get(band, 0) + FEEDBACK_WEIGHT * seen.get(f, {}).get(band, 0)
    weights = {band: log_weight(total("m", "fm", band), n_m, total("u", "fu", band), n_u) for band in set().union(*seen.values())}
    weights |= {"cnic_exact": CLIP, "cnic_close": 0.6 * CLIP, "cnic_masked_match": 2.0, "cnic_diff": -CLIP, "cnic_diff_prefix": -2.0}
    weights |= {"dob_match": max(weights.get("dob_match", 0.0), 3.0), "dob_diff": min(weights.get("dob_diff", 0.0), -2.0)}
    prior = min(0.5, max(size["m"], 1) / max(candidates, 1))
    return Model(dict(sorted(weights.items())), math.log2(prior / (1 - prior)), {"anchor_pairs": size["m"], "random_pairs": size["u"], "feedback_matches": size.get("fm", 0), "feedback_nonmatches": size.get("fu", 0)})


def vetoed(bands: Column) -> Column:
    """Q3: a father or birth-date conflict that no full number settles."""
    conflict = F.array_contains(bands, "father_diff") | F.array_contains(bands, "dob_diff")
    return conflict & ~F.array_contains(bands, "cnic_exact") & ~F.array_contains(bands, "cnic_close")


def overlap(bands: Column, names: list[str]) -> Column:
    return F.arrays_overlap(bands, F.array(*[F.lit(n) for n in names]))


def route(scored: DataFrame) -> DataFrame:
    """Q2: ``decision`` match, borderline or drop, from ``probability`` and ``bands``."""
    match = (F.col("probability") >= MATCH) & ~vetoed(F.col("bands")) & overlap(F.col("bands"), HARD)
    return scored.withColumn("decision", F.when(match, "match").when(F.col("probability") >= BORDERLINE, "borderline").otherwise("drop"))


def pair_rows(routed: DataFrame, tier: str) -> DataFrame:
    """Q1: the pair table of a tier."""
    return routed.select(F.col("a").alias("record_a"), "registry_a", F.col("raw_name_a").alias("name_a"), F.col("b").alias("record_b"), "registry_b", F.col("raw_name_b").alias("name_b"), F.bround("score", 2).alias("score_bits"), F.bround("probability", 4).alias("posterior_prob"), F.array_join("bands", "|").alias("evidence"), F.lit(tier).alias("decided_by"))


def number_entities(spark: SparkSession, records: DataFrame, links: DataFrame) -> DataFrame:
    """``record_id, entity_id``; entities are numbered by their first record."""
    grouped = connected_components(spark, links, "a", "b")
    held = records.select("record_id", "ord").join(grouped.withColumnRenamed("node", "record_id"), "record_id", "left").withColumn("component", F.coalesce("component", "record_id"))
    first = held.groupBy("component").agg(F.min("ord").alias("first"))
    numbered = first.withColumn("entity_id", F.format_string("E%06d", F.row_number().over(Window.orderBy("first"))))
    return held.join(numbered, "component").select("record_id", "entity_id")


@dataclass
class Linked:
    """What a tier leaves: the clusters, the pairs still open (with bands), and the evidence of its links."""

    clusters: DataFrame
    open_pairs: DataFrame
    evidence: DataFrame
    model: Model


def tier1(spark: SparkSession, records: DataFrame, feedback: DataFrame | None = None) -> Linked:
    """Blocking, comparison, calibration, routing and components."""
    blocks = block_index(records).join(records.select("record_id", "ord"), "record_id")
    pairs = materialise(spark, pairs_of_blocks(blocks, order="ord"), "pairs")
    model = fit(spark, records, pairs.count(), feedback)
    # Stored first: a filter on the decision would otherwise compute the bands again for each place that names them.
    compared = materialise(spark, compare(pairs, records), "compared")
    scored = compared.withColumn("score", model.score(F.col("bands"))).withColumn("probability", model.posterior(F.col("score")))
    routed = materialise(spark, route(scored).where("decision <> 'drop'"), "routed")
    discard(spark, pairs, compared)
    matches = routed.where("decision = 'match'")
    clusters = materialise(spark, number_entities(spark, records, matches), "clusters")
    return Linked(clusters, routed.where("decision = 'borderline'"), pair_rows(matches, "tier1").select("record_a", "record_b", "decided_by", "evidence", F.col("posterior_prob").alias("posterior")), model)


def hashed_ngrams(names: pd.Series, size: int = 256) -> np.ndarray:
    """S11's offline default: unit vectors of hashed character n-grams (one to three) of names. A substitute for a
    multilingual sentence model, which can be passed instead; the same interface, another model."""
    out = np.zeros((len(names), size), np.float32)
    for k, name in enumerate(names):
        text = f" {(name or '').lower()} "
        for n in (1, 2, 3):
            for i in range(len(text) - n + 1):
                value = int.from_bytes(text[i : i + n].encode()[:8], "little") * 0x9E3779B97F4A7C15 % 2**64
                out[k, (value >> 32) % size] += 1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


Embedder = Callable[[pd.Series], np.ndarray]


def name_vectors(records: DataFrame, embed: Embedder = hashed_ngrams) -> DataFrame:
    """``key, vector`` of each distinct name, from its Roman skeletons, so that both scripts meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"raw_name": part["raw_name"], "vector": list(embed(part["text"]))})

    texts = records.select("raw_name", F.array_join("name_skeletons", " ").alias("text")).distinct()
    return texts.mapInPandas(run, "raw_name string, vector array<float>")


def with_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``cosine`` of the names of compared pairs."""
    one, two = (vectors.select(F.col("raw_name").alias(f"raw_name_{s}"), F.col("vector").alias(f"vector_{s}")) for s in "ab")
    return pairs.join(one, "raw_name_a").join(two, "raw_name_b").withColumn("cosine", P.cosine(F.col("vector_a"), F.col("vector_b"))).drop("vector_a", "vector_b")


def placed(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs whose records lie in different entities, with both entities."""
    one, two = (clusters.select(F.col("record_id").alias(s), F.col("entity_id").alias(f"entity_{s}")) for s in "ab")
    return pairs.join(one, "a").join(two, "b").where("entity_a <> entity_b")


def merge_entities(spark: SparkSession, clusters: DataFrame, links: DataFrame) -> DataFrame:
    """Entities joined by links take the least name among them."""
    grouped = connected_components(spark, links, "entity_a", "entity_b").withColumnRenamed("node", "entity_id")
    return clusters.join(grouped, "entity_id", "left").select("record_id", F.coalesce("component", "entity_id").alias("entity_id"))


def tier2(spark: SparkSession, records: DataFrame, before: Linked, embed: Embedder = hashed_ngrams) -> Linked:
    """Q4-Q6, M2: open pairs promoted by name embeddings."""
    vectors = materialise(spark, name_vectors(records, embed), "vectors")
    model = before.model
    names = records.select("record_id", "raw_name")

    def sample_bands(pairs: DataFrame) -> tuple[dict[str, int], int]:
        named = pairs.join(names.withColumnsRenamed({"record_id": "a", "raw_name": "raw_name_a"}), "a").join(names.withColumnsRenamed({"record_id": "b", "raw_name": "raw_name_b"}), "b")
        rows = with_cosine(named, vectors).groupBy(P.band_embedding(F.col("cosine")).alias("band")).count().collect()
        return {r["band"]: r["count"] for r in rows}, sum(r["count"] for r in rows)

    (m, n_m), (u, n_u) = sample_bands(anchor_pairs(records, TIER2_ANCHORS)), sample_bands(random_pairs(spark, records, TIER2_RANDOMS, seed=2))
    weights = {b: log_weight(m.get(b, 0), n_m, u.get(b, 0), n_u) for b in EMBEDDING_BANDS}
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])

    fit_for = placed(before.open_pairs, before.clusters).where(~overlap(F.col("bands"), TIER2_VETO))
    seen = with_cosine(fit_for, vectors).withColumn("embedding_band", P.band_embedding(F.col("cosine")))
    name_band = F.get(F.filter("bands", lambda b: b.isin(NAME_BANDS)), 0)
    rest = F.filter("bands", lambda b: ~b.isin(NAME_BANDS))
    across = overlap(F.col("bands"), TIER2_HARD) & (F.col("cosine") >= CROSS_SCRIPT_COSINE) & (name_band.isNull() | name_band.isin("name_weak", "name_diff"))
    bits = model.score(rest) + F.greatest(model.score(F.filter("bands", lambda b: b.isin(NAME_BANDS))), F.try_element_at(table, F.col("embedding_band")))
    enough = F.size(F.array_intersect("bands", F.array(*[F.lit(s) for s in TIER2_SUPPORT]))) >= 2
    piled = model.posterior(bits)
    seen = seen.withColumn("decided_by", F.when(across, "tier2_cross_script").when(enough & (piled >= PROMOTE), "tier2_accumulation"))
    promoted = materialise(spark, seen.where("decided_by IS NOT NULL").withColumn("promoted_probability", F.when(across, 1.0).otherwise(piled)), "tier2")
    clusters = materialise(spark, merge_entities(spark, before.clusters, promoted), "clusters")
    left = placed(before.open_pairs, before.clusters).drop("entity_a", "entity_b").join(promoted.select("a", "b"), ["a", "b"], "left_anti")
    evidence = promoted.select(F.col("a").alias("record_a"), F.col("b").alias("record_b"), "decided_by", F.array_join("bands", "|").alias("evidence"), F.bround("promoted_probability", 4).alias("posterior"))
    return Linked(clusters, materialise(spark, left, "open"), before.evidence.unionByName(evidence), model)


def identifier_sets(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """A10: the identifiers that each entity's records carry."""
    held = records.select("record_id", F.col("cnic.digits").alias("cnic"), "phone", address_key(F.col("addr")).alias("addr"), F.nullif("dob", F.lit("")).alias("dob")).join(clusters, "record_id")
    return held.groupBy("entity_id").agg(*[F.collect_set(k).alias(k) for k in SHARED_BITS])


def promote(spark: SparkSession, records: DataFrame, before: Linked) -> Linked:
    """Open pairs of similar names whose entities share identifiers."""
    sets = materialise(spark, identifier_sets(records, before.clusters), "identifiers")
    one, two = (sets.select(F.col("entity_id").alias(f"entity_{s}"), F.struct(*SHARED_BITS).alias(f"ids_{s}")) for s in "ab")
    fit_for = placed(before.open_pairs, before.clusters).where(~overlap(F.col("bands"), ["cnic_diff", "dob_diff"]) & overlap(F.col("bands"), ["name_exact", "name_close"]))
    seen = fit_for.join(one, "entity_a").join(two, "entity_b")
    share = {k: F.arrays_overlap(F.col("ids_a")[k], F.col("ids_b")[k]) for k in SHARED_BITS}
    graph = F.filter(F.array(*[F.when(share[k], f"shared_{k}") for k in SHARED_BITS]), lambda x: x.isNotNull())
    bonus = sum((F.when(share[k], bits).otherwise(0.0) for k, bits in SHARED_BITS.items()), F.lit(0.0))
    seen = seen.withColumn("graph_evidence", graph).withColumn("promoted_probability", before.model.posterior(before.model.score(F.col("bands")) + bonus))
    promoted = materialise(spark, seen.where((F.size("graph_evidence") > 0) & (F.col("promoted_probability") >= PROMOTE)), "tier4")
    clusters = materialise(spark, merge_entities(spark, before.clusters, promoted), "clusters")
    evidence = promoted.select(F.col("a").alias("record_a"), F.col("b").alias("record_b"), F.lit("tier4_promote").alias("decided_by"), F.array_join("bands", "|").alias("evidence"), F.bround("promoted_probability", 4).alias("posterior"))
    return Linked(clusters, before.open_pairs, before.evidence.unionByName(evidence), before.model)
