"""Operator 6, nearest neighbours by randomly rotated one-bit codes (after RaBitQ, Gao and Long 2024).

Vectors are centred, scaled to unit length and rotated by one random orthogonal matrix; the code keeps the sign of each
coordinate, packed to bits, with two correction scalars: the distance to the centre and the inner product of the unit
vector with its own code. Sign products times the scalars estimate inner products without bias, with a known spread; the
spread times ``BOUND`` bounds the estimate. A query's candidates of a block are the vectors whose upper bound reaches its
20th best so far, and only those are compared exactly, in double precision.

Every row is indexed; the centre is fitted on at most ``CENTRE_ROWS`` rows. The stated query set meets all codes block by
block: queries are broadcast ``QUERY_ROWS`` at a time, codes stay where they are, and each task returns at most ``k`` rows
a query. Of exact copies of a vector only the ``k + 1`` least ids, ``k`` rows of each, can be among anyone's ``k`` nearest, so only
those are scanned; that drops no result.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids; a query
meets the vectors of its own length, where inner products are defined; equal scores go to the smaller id; every other row is
a candidate, so a row that repeats appears as often (a query that repeats asks once, and one whose id repeats with another
vector asks with each and keeps the best of all); fewer candidates give fewer rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.sources.shared import materialise

NEAREST, EVERY = 20, 20
BOUND = 3.0
CENTRE_ROWS, QUERY_ROWS = 20_000, 65_536
#: Vectors and queries that a task compares at a time.
BLOCK, QUERY_BLOCK = 4096, 512


def rotation(size: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``bits (packed), distance to the centre, inner product of each unit vector with its code``."""
    moved = x.astype(np.float64) - centre
    far = np.linalg.norm(moved, axis=1)
    unit = moved / np.maximum(far, 1e-300)[:, None] @ turn
    held = np.abs(unit).sum(1) / np.sqrt(x.shape[1])
    return np.packbits(unit >= 0, axis=1), far.astype(np.float32), np.where(far > 0, held, 1).astype(np.float32)


def signs(bits: np.ndarray, size: int) -> np.ndarray:
    return (np.unpackbits(bits, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(size))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the components."""
    return np.cumsum(a.astype(np.float64) * b.astype(np.float64), axis=1)[:, -1]


class Searcher:
    """The best ``k`` of a stream of blocks for a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.single = vectors.astype(np.float32)
        moved = vectors.astype(np.float64) - centre
        self.turned = (moved @ turn).astype(np.float32)
        self.far = np.linalg.norm(moved, axis=1).astype(np.float32)
        self.shift = (vectors.astype(np.float64) @ centre - centre @ centre).astype(np.float32)
        self.best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        self.floor = np.full(len(ids), -np.inf)
        self.rounding = np.abs(vectors).sum(1) * np.float32(1e-5)
        self.compared = 0

    def feed(self, ids: np.ndarray, vectors: np.ndarray, sign: np.ndarray, far: np.ndarray, held: np.ndarray, with_centre: np.ndarray) -> None:
        size = vectors.shape[1]
        guess = (self.turned @ sign.T) * (far / held) + with_centre + self.shift[:, None]
        spread = np.sqrt(np.maximum(1 - held**2, 0)) / held / np.sqrt(max(size - 1, 1)) * BOUND
        slack = self.far[:, None] * (far * spread) + 1e-5
        floor = self.floor
        if len(ids) > self.k + 1:
            # The best guesses, compared exactly, give a floor for the rest; one more, as a query may meet itself.
            first = np.argpartition(-guess, self.k, axis=1)[:, : self.k + 1]
            seen = np.einsum("qd,qkd->qk", self.vectors.astype(np.float64), vectors[first].astype(np.float64))
            seen = np.where(ids[first] == self.ids[:, None], -np.inf, seen)
            floor = np.maximum(floor, np.partition(seen, 1, axis=1)[:, 1] - 1e-9)
        q, v = np.nonzero(guess + slack >= floor[:, None])
        other = ids[v] != self.ids[q]
        q, v = q[other], v[other]
        self.compared += len(q)
        # Single precision drops what is clearly below the floor; double precision decides the rest.
        near = np.einsum("nd,nd->n", self.single[q], vectors.astype(np.float32)[v]) >= floor[q] - self.rounding[q] * np.float32(np.abs(vectors).max(initial=0))
        q, v = q[near], v[near]
        score = exact(self.vectors[q], vectors[v])
        cut = np.searchsorted(q, np.arange(len(self.ids) + 1))
        for j in np.flatnonzero(np.diff(cut)):
            s, i = self.best[j]
            s, i = np.concatenate([s, score[cut[j] : cut[j + 1]]]), np.concatenate([i, ids[v[cut[j] : cut[j + 1]]]])
            order = np.lexsort((i, -s))[: self.k]
            self.best[j] = s[order], i[order]
            if len(order) == self.k:
                self.floor[j] = s[order[-1]]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = [len(s) for s, _ in self.best]
        return np.repeat(self.ids, n), np.concatenate([i for _, i in self.best]), np.concatenate([s for s, _ in self.best])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of the rows that take part."""
    taken = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return taken.where(~bad & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def nearest(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every`` its ``k`` nearest other rows."""
    taken = materialise(spark, usable(vectors, id_col, vector_col), "vectors")
    sizes = sorted(r["n"] for r in taken.select(F.size("vector").alias("n")).distinct().collect())
    found = [x for n in sizes for x in _found(spark, taken.where(F.size("vector") == n), n, k, every)]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(spark: SparkSession, taken: DataFrame, size: int, k: int, every: int) -> list[DataFrame]:
    """Tables ``query_id, vec_id, score`` of at most ``k`` rows a query and task, for vectors of one length."""
    sample = taken.orderBy(F.xxhash64("id"), "id").limit(CENTRE_ROWS).toArrow()
    centre = _matrix(sample["vector"].combine_chunks(), size).mean(0)
    turn = rotation(size)

    least = Window.partitionBy("vector").orderBy("id")
    kept = taken.withColumn("copy", F.dense_rank().over(least)).where(F.col("copy") <= k + 1)
    kept = kept.withColumn("again", F.row_number().over(Window.partitionBy("vector", "id").orderBy("copy"))).where(F.col("again") <= k)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, far, held = encode(_matrix(batch.column("vector"), size), centre, turn)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits.shape[1]), len(bits), [None, pa.py_buffer(np.ascontiguousarray(bits).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), packed, pa.array(far), pa.array(held)], ["id", "vector", "bits", "far", "held"])

    codes = materialise(spark, kept.select("id", "vector").mapInArrow(index, "id long, vector array<double>, bits binary, far float, held float"), "codes")

    asked = taken.where(F.pmod("id", F.lit(every)) == 0).distinct()
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    out = []
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow().sort_by("id")
        if not len(some):
            continue
        ids, matrix = some["id"].to_numpy(), _matrix(some["vector"].combine_chunks(), size)
        sent = spark.sparkContext.broadcast((ids, matrix, centre, turn))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix, centre, turn = sent.value
            searchers = [Searcher(ids[j : j + QUERY_BLOCK], matrix[j : j + QUERY_BLOCK], centre, turn, k) for j in range(0, len(ids), QUERY_BLOCK)]
            for batch in (b.slice(j, BLOCK) for b in batches for j in range(0, len(b), BLOCK)):
                x = _matrix(batch.column("vector"), size)
                packed = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(len(x), -1)
                block = batch.column("id").to_numpy(), x, signs(packed, size), batch.column("far").to_numpy(), batch.column("held").to_numpy(), (x.astype(np.float64) @ centre).astype(np.float32)
                for searcher in searchers:
                    searcher.feed(*block)
            for searcher in searchers:
                q, v, s = searcher.rows()
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

        out.append(materialise(spark, codes.mapInArrow(scan, "query_id long, vec_id long, score double"), "near"))
    return out
