"""Times of generation, linkage, graph and scoring at growing sizes, with the growth at each doubling."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.operators import graph, resolve, scoring, synth
from quillspan.sources import registries as R
from quillspan.sources.shared import materialise, ship

SIZES = (1500, 3000, 6000)


def run(spark: SparkSession, folder: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """``people, records, stage, seconds, growth``: growth is against the size before (null for the first)."""
    ship(spark)
    rows, before = [], {}
    for n in sizes:
        taken: dict[str, float] = {}

        def timed(stage: str, work: Callable[[], object], taken: dict[str, float] = taken) -> object:
            began = time.perf_counter()
            out = work()
            taken[stage] = time.perf_counter() - began
            return out

        place = f"{folder}/{n}"
        timed("generate", lambda n=n, place=place: synth.generate(spark, place, n))
        tables = R.read_all(spark, f"{place}/observable")
        records = materialise(spark, R.unified(tables), "records")
        mentions, _ = timed("resolve", lambda records=records: resolve.resolve(spark, records))
        features, _ = timed("graph", lambda tables=tables, mentions=mentions: graph.entity_features(spark, tables, mentions))
        timed("score", lambda features=features: scoring.score(spark, features))
        count = records.count()
        rows += [(n, count, k, round(v, 3), round(v / before[k], 2) if k in before else None) for k, v in taken.items()]
        before = taken
    return spark.createDataFrame(rows, "people int, records long, stage string, seconds double, growth double")
