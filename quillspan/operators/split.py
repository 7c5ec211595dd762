"""Entities that hold two people are split, sequentially inside one entity, independently across entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.similarity import token_set_similarity
from quillspan.operators.linkage import SAME_FATHER, Linked, compare
from quillspan.sources.shared import materialise


def one_edit(a: str, b: str) -> bool:
    """P2 on the driver's or a worker's side."""
    if len(a) == len(b):
        off = [k for k in range(len(a)) if a[k] != b[k]]
        return len(off) <= 1 or (len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]])
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(short == long[:k] + long[k + 1 :] for k in range(len(long)))


def one_document(numbers: set[str]) -> dict[str, str]:
    """Each number's representative: the first in order that is at most one edit away."""
    chosen: dict[str, str] = {}
    for number in sorted(numbers):
        chosen[number] = next((kept for kept in chosen.values() if one_edit(number, kept)), number)
    return chosen


def attach(loose: list[str], cores: dict, scores: dict[frozenset, float]) -> None:
    """Each loose record joins the core that holds its best partner, and can then attract the next."""
    for record in loose:
        best = max(cores, key=lambda c: max(scores.get(frozenset((record, other)), 0.0) for other in cores[c]))
        cores[best].append(record)


def _scores(part: pd.DataFrame) -> dict[frozenset, float]:
    return {frozenset((p["a"], p["b"])): p["score"] for p in part["scores"].iloc[0]} if len(part) and part["scores"].iloc[0] is not None else {}


def _renamed(part: pd.DataFrame, groups: list[list[str]], mark: str) -> pd.DataFrame:
    entity = part["entity_id"].iloc[0]
    names = {r: entity if k == 0 else f"{entity}.{mark}{k}" for k, group in enumerate(groups) for r in group}
    return pd.DataFrame({"record_id": part["record_id"], "entity_id": part["record_id"].map(names).fillna(entity)})


def split_numbers(part: pd.DataFrame) -> pd.DataFrame:
    """One core for each identity document."""
    part = part.sort_values("place")
    known = one_document({d for d in part["digits"] if isinstance(d, str)})
    cores: dict[str, list[str]] = {}
    for record, digits in zip(part["record_id"], part["digits"], strict=True):
        if isinstance(digits, str):
            cores.setdefault(known[digits], []).append(record)
    if len(cores) < 2:
        return _renamed(part, [], "S")
    attach([r for r, d in zip(part["record_id"], part["digits"], strict=True) if not isinstance(d, str)], cores, _scores(part))
    return _renamed(part, [cores[k] for k in sorted(cores)], "S")


def split_fathers(part: pd.DataFrame) -> pd.DataFrame:
    """One core for each father, unless two cores share a full number."""
    part = part.sort_values("place")
    fathers = {r: tuple(f) for r, f in zip(part["record_id"], part["fathers"], strict=True) if len(f)}
    digits = dict(zip(part["record_id"], part["digits"], strict=True))
    cores: dict[int, list[str]] = {}
    for record, father in fathers.items():
        home = next((k for k, core in cores.items() if token_set_similarity(father, fathers[core[0]]) >= SAME_FATHER), len(cores))
        cores.setdefault(home, []).append(record)
    held = [{digits[r] for r in core if isinstance(digits[r], str)} for core in cores.values()]
    if len(cores) < 2 or any(held[i] & held[j] for i in range(len(held)) for j in range(i)):
        return _renamed(part, [], "F")
    attach([r for r in part["record_id"] if r not in fathers], cores, _scores(part))
    return _renamed(part, list(cores.values()), "F")


def split(spark: SparkSession, records: DataFrame, before: Linked) -> Linked:
    """Both passes. Only entities in conflict leave the JVM, with the scores of their own pairs."""
    clusters = before.clusters
    for kind, worker in (("cnic.digits", split_numbers), ("father", split_fathers)):
        held = records.select("record_id", F.format_string("%d:%s", "ord.registry", "ord.id").alias("place"), F.col("cnic.digits").alias("digits"), F.col("father_skeletons").alias("fathers")).join(clusters, "record_id")
        differs = F.countDistinct("digits") if kind == "cnic.digits" else F.countDistinct(F.when(F.size("fathers") > 0, F.col("fathers")))
        torn = materialise(spark, held.join(held.groupBy("entity_id").agg(differs.alias("n")).where("n > 1").select("entity_id"), "entity_id"), "torn")
        loose = torn.where("digits IS NULL") if kind == "cnic.digits" else torn.where("size(fathers) = 0")
        pairs = loose.select("entity_id", F.col("record_id").alias("a")).join(torn.select("entity_id", F.col("record_id").alias("b")), "entity_id").where("a <> b")
        scored = compare(pairs.select("a", "b").distinct(), records).withColumn("score", before.model.score(F.col("bands")))
        scores = scored.join(clusters.withColumnRenamed("record_id", "a"), "a").groupBy("entity_id").agg(F.collect_list(F.struct("a", "b", "score")).alias("scores"))
        done = torn.join(scores, "entity_id", "left").groupBy("entity_id").applyInPandas(worker, "record_id string, entity_id string")
        whole = clusters.join(torn.select("record_id"), "record_id", "left_anti")
        clusters = materialise(spark, whole.select("record_id", "entity_id").unionByName(done), "clusters")
    return Linked(clusters, before.open_pairs, before.evidence, before.model)
