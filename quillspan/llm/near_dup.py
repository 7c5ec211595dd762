"""Operator 10, near-duplicate classes: BagMinHash signatures, banding, exact multiset overlap, components.

BagMinHash (Ertl 2018) keeps, for each signature slot, the earliest point of a Poisson process on (time x weight). A
shingle that occurs ``w`` times owns the weight interval (0, w]. The weight axis is a hierarchy of cells, the same for all
documents: (0, 1], (1, 2], (2, 4], (4, 8] ..., each split at its middle again and again. Processes of separate top cells
are independent and seeded by shingle and cell, so equal cells of two documents give equal points. To split a process is
to hand each of its points to one half; the halves that a point falls into are the leading bits of its height in the cell,
drawn with the point. A top cell that ``w`` covers in part keeps the points of the parts below ``w``. Processes stop at
the largest slot time so far, which leaves a few points a shingle. Two slots agree with probability sum(min) / sum(max).

Defined results: null and empty texts have no shingles and are equal to each other; a text of under five words is one
shingle; texts are told apart by content, never by id, so rows that share an id but not a text are independent, and texts
without an id join groups like any others; a class or group without any id has a null id; an empty table gives no rows.
Only the named columns are read, others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm import textvec as tv
from quillspan.llm.memory import tidy
from quillspan.operators.components import connected_components
from quillspan.sources.shared import materialise, sized_broadcast, text_or_empty

SLOTS, BAND_ROWS, SHINGLE, SIMILARITY = 128, 4, 5, 0.8
#: Leader rounds before prefix filtering looks for links between the components that still share buckets, and leaders that
#: a bucket names in each.
LEADER_ROUNDS, LEADERS = 5, 4
#: Buckets that a member shares with a leader it is compared with; pairs that share fewer are left to prefix filtering.
SHARED = 3
#: Members that meet one copy of their leader's text; a leader of more is sent once for each so many.
MEMBERS = 512
#: Rows of 8 to 24 bytes that may be broadcast; beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: Ratio of neighbouring size classes in prefix filtering.
SIZE_STEP = 1.05

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 2.0**-53


def bag_minhash(row: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """``n x slots`` ids of the earliest points; rows without elements hold zeros. ``slots``: a power of two."""
    cells = 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    of = np.repeat(np.arange(len(row)), cells)
    cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    owner, weight = row[of], count[of].astype(float)
    low = np.where(cell == 0, 0.0, 2.0 ** (cell - 1))
    width = np.where(cell == 0, 1.0, low)
    seed = tv.mix(value[of] + cell.astype(np.uint64) * _GOLD)
    rate = width * slots
    time = np.zeros(len(of))
    best = np.full(n * slots, np.inf)
    point = np.zeros(n * slots, np.uint64)
    limit = np.full(n, np.inf)
    active, step = np.arange(len(of)), 0
    while len(active):
        many = int(np.clip(32768 // len(active), 1, 64))
        index = (np.arange(step + 1, step + 1 + many).astype(np.uint64) * _GOLD)[None, :]
        draw = tv.mix(seed[active][:, None] + index)
        again = tv.mix(draw ^ _GOLD)
        at = time[active][:, None] + np.cumsum(-np.log1p(-((draw >> np.uint64(11)) * _UNIT)), axis=1) / rate[active][:, None]
        height = low[active][:, None] + (again >> np.uint64(11)) * _UNIT * width[active][:, None]
        mine = owner[active]
        kept = (height < weight[active][:, None]) & (at <= limit[mine][:, None])
        place = (mine[:, None] * slots + (again & np.uint64(slots - 1)).astype(np.int64))[kept]
        when, what = at[kept], draw[kept]
        np.minimum.at(best, place, when)
        won = best[place] == when
        point[place[won]] = what[won]
        time[active] = at[:, -1]
        limit = best.reshape(n, slots).max(axis=1)
        active = active[time[active] <= limit[owner[active]]]
        step += many
    return point.reshape(n, slots)


def bands(points: np.ndarray, band_rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``band_rows`` slots."""
    n, slots = points.shape
    parts = points.reshape(n, slots // band_rows, band_rows)
    total = np.arange(slots // band_rows, dtype=np.uint64)[None, :] * _GOLD
    for k in range(band_rows):
        total = tv.mix(total + parts[:, :, k])
    return total.astype(np.int64)


@tidy
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in tv.chunks(batch.column("text")):
            n = last - first
            row, value, count = tv.multiset(*tv.shingles(data, offsets, SHINGLE))
            keys = bands(bag_minhash(row, value, count, n))
            some = np.bincount(row, minlength=n) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * keys.shape[1])]).astype(np.int32)), pa.array(keys[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("key").slice(first, n), lists], ["doc_id", "key", "bands"])


def multisets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles in order and their counts, for each text."""
    for first, last, data, offsets in tv.chunks(column):
        row, value, count = tv.multiset(*tv.shingles(data, offsets, SHINGLE))
        cut = np.searchsorted(row, np.arange(last - first + 1))
        yield from ((value[i:j], count[i:j]) for i, j in zip(cut, cut[1:], strict=False))


def overlap(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min) / sum(max) of two multisets; 0 if one is empty."""
    (x, p), (y, q) = one, two
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = np.minimum(p, q[at])[y[at] == x].sum()
    return float(common / (p.sum() + q.sum() - common))


@tidy
def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come as a leader's text and then its members; one leader's shingles are held at a time."""
    of, lead = None, None
    for batch in batches:
        a, b, similar = [], [], []
        leads, nodes, firsts = (batch.column(c).to_pylist() for c in ("lead", "node", "first"))
        for name, node, first, found in zip(leads, nodes, firsts, multisets(batch.column("text")), strict=True):
            if first:
                of, lead = name, found
            elif of == name:
                a.append(name)
                b.append(node)
                similar.append(overlap(lead, found))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(similar, pa.float64())], ["a", "b", "similarity"])


def overlaps(spark: SparkSession, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, similarity`` of the pairs ``lead, node``, from whole texts (``node, text``).

    Each member's text is shuffled once for each of its pairs, a leader's once for every ``MEMBERS`` members.
    """
    many = pairs.groupBy("lead").count().where(F.col("count") > MEMBERS).select("lead", F.ceil(F.col("count") / MEMBERS).cast("int").alias("parts"))
    many = sized_broadcast(many, BROADCAST_IDS)
    parts = F.coalesce("parts", F.lit(1))
    followers = pairs.join(many, "lead", "left").select("lead", "node", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    leaders = pairs.select("lead").distinct().join(many, "lead", "left").select("lead", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = leaders.join(texts.withColumnRenamed("node", "lead"), "lead").select("lead", "part", F.lit(True).alias("first"), F.col("lead").alias("node"), "text")
    rows = rows.unionByName(followers.join(texts, "node").select("lead", "part", F.lit(False).alias("first"), "node", "text"))
    rows = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", F.desc("first"))
    return rows.select("lead", "node", "first", "text").mapInArrow(_overlaps, "a long, b long, similarity double")


@tidy
def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in tv.chunks(batch.column("text")):
            row, value, count = tv.multiset(*tv.shingles(data, offsets, SHINGLE))
            size = np.bincount(row, count, minlength=last - first).astype(np.int64)
            at = pa.array(row + first)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(at), batch.column("component").take(at), pa.array(value.astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(size[row].astype(np.int32))], ["node", "component", "token", "n", "size"])


def prefix_pairs(spark: SparkSession, texts: DataFrame, left: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``lead < node`` of ``left`` in different components that can reach ``similarity``, by prefix filtering.

    Tokens are ordered from rare to frequent. What stands before the first common token of a linked pair is lost to both
    texts, and the rest must hold the overlap that the similarity asks for: of texts of sizes s and t, at least
    ``similarity / (1 + similarity) * (s + t)``. So a token far down a text's order serves small partners only: each text
    asks for a token in the size classes it can serve there, and meets the texts of those classes alone. Texts with more
    than ``1 - similarity`` of their weight in tokens of their own ask for nothing, however large their bucket is.
    """
    tokens = texts.join(left, "node").select("node", "component", "text").mapInArrow(_tokens, "node long, component long, token long, n int, size int")
    tokens = materialise(spark, tokens, "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    mine = Window.partitionBy("node")
    before = mine.orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    known = tokens.join(often, "token").withColumn("rest", F.sum("n").over(mine) - F.coalesce(F.sum("n").over(before), F.lit(0)))
    share = similarity / (1 + similarity)
    known = known.withColumn("most", F.col("rest") / share - F.col("size") + 1e-6).where(F.col("most") >= similarity * F.col("size"))
    prefix = materialise(spark, known.select("token", "node", "component", "size", "rest", "most"), "prefix")

    def size_class(x: Column) -> Column:
        return F.floor(F.log(x) / float(np.log(SIZE_STEP))).cast("int")

    served = F.sequence(size_class(similarity * F.col("size") - 1e-6), size_class(F.least(F.col("most"), F.col("size") / similarity + 1e-6)))
    asked = prefix.select("token", F.explode(served).alias("class"), F.col("node").alias("x"), F.col("component").alias("cx"), F.col("size").alias("sx"), F.col("rest").alias("rx"))
    offered = prefix.select("token", size_class(F.col("size")).alias("class"), F.col("node").alias("y"), F.col("component").alias("cy"), F.col("size").alias("sy"), F.col("rest").alias("ry"))
    fits = F.least("rx", "ry") >= share * (F.col("sx") + F.col("sy")) - 1e-6
    # Both texts ask for each other; one of the two answers is kept.
    found = asked.join(offered, ["token", "class"]).where((F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & fits)
    return found.select(F.col("x").alias("lead"), F.col("y").alias("node")).distinct()


def _classes(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key`` of every row, and ``key, class_id, group_id, first`` of every different text; ``first`` marks the text
    that stands for its group: that of the least id."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = base.withColumn("key", F.unhex(F.md5("text")))
    hashed = materialise(spark, base.mapInArrow(_signatures, "doc_id long, key binary, bands array<long>"), "bands")
    classes = hashed.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.any_value("bands").alias("bands"))
    # Numbers are taken once: the table is written before anything reads it.
    classes = materialise(spark, classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = classes.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band")
    members = materialise(spark, rows.join(shared, "band"), "buckets")
    nodes = materialise(spark, members.select("node").distinct(), "nodes")
    wanted = sized_broadcast(materialise(spark, classes.select("key", "class_id", "node").join(nodes, "node"), "wanted"), BROADCAST_IDS)
    texts = base.join(wanted.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    unnamed = texts.where("class_id IS NULL").groupBy("node").agg(F.any_value("text").alias("text"))
    texts = materialise(spark, texts.where("class_id IS NOT NULL").select("node", "text").unionByName(unnamed), "texts")

    links = tried = seen = central = None
    part = nodes.select("node", F.col("node").alias("component"))
    for turn in range(LEADER_ROUNDS + 1):
        placed = members.join(part, "node")
        if central is not None:
            placed = placed.join(central, "node", "left")
        # Leaders are the members that met the most similar texts so far; at first, those of least hash. Neither looks at the
        # band, so that a group has the same few everywhere.
        rank = F.struct((-F.coalesce("central", F.lit(0.0)) if central is not None else F.lit(0)).alias("o"), F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("lead"), F.col("component").alias("of"))
        leads = [F.min(F.when(F.pmod("node", F.lit(LEADERS)) == k, rank)).alias(f"l{k}") for k in range(LEADERS)]
        mixed = placed.groupBy("band").agg(F.min("component").alias("p"), F.max("component").alias("q"), *(leads if turn < LEADER_ROUNDS else [])).where("p < q")
        if turn < LEADER_ROUNDS:
            mixed = mixed.select("band", F.explode(F.filter(F.array(*[f"l{k}" for k in range(LEADERS)]), lambda x: x.isNotNull())).alias("l"))
            named = placed.join(mixed.select("band", "l.lead", "l.of"), "band").where("component <> of").groupBy("node", "lead").count().where(F.col("count") >= SHARED)
            if tried is not None:
                named = named.join(tried, ["node", "lead"], "left_anti")
            # One leader a member: the one it shares most buckets with.
            pairs = named.groupBy("node").agg(F.max(F.struct("count", "lead")).alias("best")).select("best.lead", "node")
        else:
            left = placed.join(mixed.select("band"), "band").groupBy("node").agg(F.min("component").alias("component"))
            pairs = prefix_pairs(spark, texts, materialise(spark, left, "left"), similarity)
        pairs = materialise(spark, pairs, "pairs")
        scored = materialise(spark, overlaps(spark, texts, pairs), "scored")
        found = scored.where(F.col("similarity") >= similarity - 1e-12).select("a", "b")
        links = found if links is None else links.union(found)
        if not scored.limit(1).count():
            break
        now = pairs.select("node", "lead").union(pairs.select(F.col("lead").alias("node"), F.col("node").alias("lead")))
        tried = now if tried is None else tried.union(now)
        met = scored.select(F.col("a").alias("node"), "similarity").union(scored.select(F.col("b").alias("node"), "similarity"))
        seen = met if seen is None else seen.union(met)
        central = seen.groupBy("node").agg(F.avg("similarity").alias("central"))
        grouped = connected_components(spark, links, "a", "b")
        part = materialise(spark, nodes.join(grouped, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "parts")

    placed = classes.select("key", "class_id", "node").join(part, "node", "left").select("key", "class_id", "node", F.coalesce("component", "node").alias("component"))
    heads = placed.groupBy("component").agg(F.min(F.struct(F.col("class_id").isNull().alias("unnamed"), F.col("class_id").alias("group_id"), F.col("node").alias("head"))).alias("h"))
    named = placed.join(heads.select("component", "h.group_id", "h.head"), "component")
    return hashed.select("doc_id", "key"), materialise(spark, named.select("key", "class_id", "group_id", (F.col("node") == F.col("head")).alias("first")), "named")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: ``doc_id, class_id`` (least id with this text), ``group_id`` (least id of all texts
    that links of at least ``similarity`` join to it).

    1. One pass hashes every text into band keys; equal texts collapse to a class by an aggregate.
    2. Each bucket names a few leaders, others in each round; each member is compared with one leader of another component a
       round, exactly: the one it shares most buckets with. That joins all but stray members of a group at one comparison
       each.
    3. Among the members of buckets that still hold different components, prefix filtering names every pair of different
       components that can reach ``similarity``, and those are compared, so no link between components is lost. Links
       inside a component cannot change the result.
    """
    hashed, classes = _classes(spark, docs, id_col, text_col, similarity)
    return hashed.join(classes, "key").select("doc_id", "class_id", "group_id")


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of every near-duplicate group: the least id's (of several such rows with one text, any one)."""
    hashed, classes = _classes(spark, docs, id_col, text_col, similarity)
    placed = hashed.join(classes, "key").withColumn("stays", F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id")))
    dropped = materialise(spark, placed.where(~F.col("stays")).select(F.col("key").alias("_of"), F.col("doc_id").alias("_id")).distinct(), "dropped")
    repeated = materialise(spark, placed.where("stays").groupBy("key").count().where("count > 1").select(F.col("key").alias("_of")), "repeated")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.unhex(F.md5(text_or_empty(text_col))).alias("_key"), F.col(id_col).cast("long").alias("_named"))
    kept = whole.join(sized_broadcast(dropped, BROADCAST_IDS), (F.col("_key") == F.col("_of")) & F.col("_named").eqNullSafe(F.col("_id")), "left_anti")
    if repeated.limit(1).count():
        few = sized_broadcast(repeated, BROADCAST_IDS)
        again = kept.join(few, F.col("_key") == F.col("_of"), "left_semi").groupBy("_key").agg(F.any_value("doc").alias("doc"))
        kept = kept.join(few, F.col("_key") == F.col("_of"), "left_anti").select("doc").unionByName(again.select("doc"))
    return kept.select("doc.*")
