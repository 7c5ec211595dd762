"""The linkage pipeline end to end, from registries to audits, each stage written under its own path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.operators import audit, graph, relational, resolve, scoring
from quillspan.operators.blocking import block_index
from quillspan.sources import registries as R
from quillspan.sources.shared import materialise, ship


def run(spark: SparkSession, observable: str, feedback: str | None = None, relational_model: bool = True) -> dict[str, DataFrame | object]:
    """All derived tables by name, and the linkage model and score bundle; each table is also a view ``quillspan_<name>``."""
    ship(spark)
    tables = R.read_all(spark, observable)
    records = materialise(spark, R.unified(tables), "records")
    reviewed = R.load_feedback(spark, feedback) if feedback else None
    mentions, state = resolve.resolve(spark, records, reviewed)
    features, links = graph.entity_features(spark, tables, mentions)
    scores, bundle = scoring.score(spark, features)
    related = relational.relational_scores(spark, features, links) if relational_model else None
    final = materialise(spark, scoring.ensemble(spark, scores, related), "final")
    floors = materialise(spark, audit.entity_floors(features, mentions), "floors")
    audits = audit.audits(final, floors, mentions, R.field_index(tables), state.evidence)
    out = {"records": records, "index": block_index(records), "mentions": mentions, "evidence": state.evidence, "features": features, "edges": links, "scores": final, "floors": floors, "audits": audits, "model": state.model, "bundle": bundle}
    for name, value in out.items():
        if isinstance(value, DataFrame):
            value.createOrReplaceTempView(f"quillspan_{name}")
    return out
