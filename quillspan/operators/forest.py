"""M3: isolation forest. Trees grow on the driver from bounded samples (256 rows each); scoring is one Arrow function.

After Liu, Ting and Zhou (2008): each tree splits a subsample at random features and values down to a height of
ceil(log2(size)); the anomaly of a row is 2 ** (-mean path length / c(size)).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TREES, SUBSAMPLE, SEED = 300, 256, 42


def usual_path(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    more = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, more, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays of nodes: feature (-1: leaf), threshold, left child (right is next), added path length."""

    features: list[str]
    size: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for feature, threshold, left, extra in self.trees:
            at, steps = np.zeros(len(x), int), np.zeros(len(x))
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = left[node] + (x[rows, feature[node]] > threshold[node])
                steps[rows] += 1
            depth += steps + extra[at]
        return 2.0 ** (-depth / max(len(self.trees), 1) / max(float(usual_path(self.size)), 1e-9))

    def to_json(self) -> str:
        """M6: the frozen form, readable without pickle."""
        return json.dumps({"features": self.features, "size": self.size, "trees": [[a.tolist() for a in t] for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Forest:
        held = json.loads(text)
        return Forest(held["features"], held["size"], [(np.array(f), np.array(t), np.array(c), np.array(e)) for f, t, c, e in held["trees"]])


def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    height = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
    waiting = [(0, x, 0)]
    while waiting:
        at, rows, depth = waiting.pop()
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if depth >= height or not len(spread):
            nodes[at][3] = float(usual_path(len(rows)))
            continue
        f = int(rng.choice(spread))
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        nodes[at][:3] = [f, cut, len(nodes)]
        low = rows[:, f] <= cut
        waiting += [(len(nodes), rows[low], depth + 1), (len(nodes) + 1, rows[~low], depth + 1)]
        nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
    table = np.array(nodes)
    return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3]


def fit(df: DataFrame, features: dict[str, Column], key: str = "entity_id") -> Forest:
    """Trees from at most ``TREES * SUBSAMPLE`` rows, drawn by a hash of the key."""
    sample = df.select(*[c.cast("double").alias(n) for n, c in features.items()], F.xxhash64(key, F.lit(SEED)).alias("_h")).orderBy("_h").limit(TREES * SUBSAMPLE).drop("_h").toPandas().to_numpy()
    rng = np.random.default_rng(SEED)
    size = min(SUBSAMPLE, len(sample))
    return Forest(list(features), size, [grow(sample[rng.choice(len(sample), size, replace=False)], rng) for _ in range(TREES if size else 0)])


def anomaly(forest: Forest, features: dict[str, Column]) -> Column:
    """The anomaly of each row, by batches."""

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            flat = rows.flatten().to_numpy(zero_copy_only=False)
            yield pa.array(forest.anomaly(flat.reshape(len(rows), -1)) if len(rows) else np.zeros(0))

    return score(F.array(*[features[n].cast("double") for n in forest.features]))
