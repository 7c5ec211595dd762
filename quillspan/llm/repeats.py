"""Operator 7, removal of repeated passages by a column-wise collection transform (after Bauer, Cox and Rosone).

The transform of a collection is built by rounds: each inserts one symbol of every document, going from the last column to
the first, and updates the order of suffixes and their common prefixes from the round before. Whole documents would need
as many rounds as the longest has bytes, each over the whole collection, so the rounds run on aligned fragments:

1. Every window of 400 bytes has an anchor, its least-hashed 64-gram (the leftmost among equals). Equal windows have equal
   anchors at equal places, so only fragments around a repeated anchor (736 bytes) can hold a repeated window, and equal
   windows stand in equal columns once fragments are aligned at their anchor.
2. Fragments that occur twice as a whole are repeated throughout. Of the others, those that share an anchor and the 168
   bytes to one side of it go to the rounds, one of each kind, grouped by anchor: at most 736 rounds, whatever the length
   of documents. Symbol columns are laid out one after another and read once in sequence; of the transform only the last
   column's order and common prefixes stay in memory. Windows whose common prefix reaches 400 bytes are repeated.
3. Repeated windows are carried to all places of their fragments and merged to runs.

Fragments count as equal if 64-bit hashes of their anchor and of their content both agree, copies of texts by their MD5; in
the rounds, bytes are compared. Strings are judged on the input.

400 bytes are about 63 words here, so a passage of 51 to 62 words that repeats is not removed by the rule. A further column,
``shared_passage``, marks the texts that hold a run of at least ``PASSAGE`` words that another document holds too, whatever
its bytes: windows of so many words go by the same principle, an anchor of ``GRAM_WORDS`` words first, and only windows
around anchors of two texts are compared, by 64-bit hashes.

Defined results: null and empty texts have 0 bytes; texts under 400 bytes lose nothing; a text of at least 400 bytes that
occurs twice, also as a repeated row, loses all; null ids stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import textvec as tv
from quillspan.llm.memory import tidy
from quillspan.sources.shared import among, discard, materialise, sized_broadcast, text_or_empty

LENGTH, GRAM = 400, 64
REACH = LENGTH - GRAM
HALF, WIDTH = REACH // 2, GRAM + 2 * REACH
#: Stands outside a text and matches nothing.
VOID = 256
#: Fragments that go through the rounds together (whole buckets, so up to ``HOT`` more).
AT_ONCE = 4096
#: Fragments of one anchor beyond which they are told apart by their cores.
HOT = 1024
#: Keys (8 or 16 bytes each) that may be broadcast to filter rows; beyond it the join shuffles.
BROADCAST_KEYS = 500_000
#: Keys of texts that are broadcast as they are; more go as bits. Only texts that pass are shuffled.
TEXT_KEYS = 50_000
OUT = "doc_id long, key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Words of a passage that is marked wherever it repeats across documents, and of its anchor.
PASSAGE, GRAM_WORDS = 51, 8
_PLACE = np.uint64((1 << 28) - 1)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``row, place (in the chunk), anchor hash, fragment hash, left, size, side hashes`` of every least 64-gram of some 400-byte window."""
    sums = tv.prefix_sums(data)
    n = len(data) - GRAM + 1
    out = [[np.zeros(0, np.int64)] * 8]
    if n > 0:
        at = np.arange(n)
        gram = tv.span_hash(sums, at, at + GRAM)
        for row in np.flatnonzero(np.diff(offsets) >= LENGTH):
            a, b = offsets[row], offsets[row + 1]
            here = (gram[a : b - GRAM + 1] & ~_PLACE) | (np.arange(b - a - GRAM + 1).astype(np.uint64) & _PLACE)
            place = np.unique(_window_min(here, REACH + 1) & _PLACE).astype(np.int64) + a
            low, high = np.maximum(place - REACH, a), np.minimum(place + GRAM + REACH, b)
            out.append([np.full(len(place), row), place, gram[place].astype(np.int64), tv.mix(tv.span_hash(sums, low, high) + (place - low).astype(np.uint64)).astype(np.int64), place - low, high - low, *side_hashes(sums, place, low, high)])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def side_hashes(sums: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the gram with ``HALF`` bytes to its left, and to its right (fewer at a text's ends)."""
    left, right = np.maximum(place - HALF, low), np.minimum(place + GRAM + HALF, high)
    return tv.span_hash(sums, left, place + GRAM).astype(np.int64), tv.span_hash(sums, place, right).astype(np.int64)


def repeated_windows(symbols: np.ndarray) -> np.ndarray:
    """Which ``LENGTH``-byte windows of aligned rows occur in another row, as ``rows x starts``.

    ``symbols``: rows of ``WIDTH`` columns, ``VOID`` outside the text; column ``REACH`` starts the anchor. Going from the
    last column to the first, each round inserts one symbol of every row in front of its suffix: a stable sort by that
    symbol (the LF step of the transform) gives the order of the suffixes that start there, and range minima over the old
    common prefixes give the new ones, capped at ``LENGTH``. Equal windows of one anchor stand in equal columns, so only
    the newest suffix of each row can match; older columns are never read again.
    """
    m, width = symbols.shape
    found = np.zeros((m, REACH + 1), bool)
    if m < 2:
        return found
    columns = np.ascontiguousarray(symbols.T)  # one sequential run a column
    order = np.arange(m)
    shared = np.full(m, 0, np.int16)  # with the row before it in the order
    for column in range(width - 1, -1, -1):
        here = columns[column][order]
        if column == width - 1:
            shared[:] = 0
        step = np.argsort(here, kind="stable")
        symbol = here[step]
        # Range minima of the old values between rows that become neighbours: (before, after] in the old order.
        low, high = step[:-1] + 1, step[1:]
        same = (symbol[1:] == symbol[:-1]) & (symbol[1:] != VOID)
        new = np.zeros(m, np.int16)
        if same.any():
            a, b = low[same], high[same]
            level = np.log2(b - a + 1).astype(np.int64)
            value = np.empty(len(a), np.int16)
            table = shared
            for k in range(int(level.max()) + 1):
                if k:
                    gap = 1 << (k - 1)
                    table = np.minimum(table[:-gap], table[gap:])
                mine = level == k
                if mine.any():
                    value[mine] = np.minimum(table[a[mine]], table[b[mine] - (1 << k) + 1])
            new[1:][same] = np.minimum(value + 1, LENGTH)
        order, shared = order[step], new
        if column <= REACH:
            long = shared >= LENGTH
            either = long.copy()
            either[:-1] |= long[1:]
            found[order[either], column] = True
    return found


@tidy
def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in tv.chunks(batch.column("text")):
            row, place, gram, fragment, left, size, near, far = anchors(data, offsets)
            key = batch.column("key").take(pa.array(row + first))
            numbers = [pa.array((place - offsets[row]).astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(gram), pa.array(fragment), pa.array(near), pa.array(far)]
            yield pa.RecordBatch.from_arrays([key, *numbers], ["key", "place", "left", "size", "anchor", "fragment", "near", "far"])


@tidy
def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted fragments of each text."""
    for batch in batches:
        anchor, fragment, left, content = [], [], [], []
        for text, wanted in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            for w in wanted:
                start = w["place"] - w["left"]
                anchor.append(w["anchor"])
                fragment.append(w["fragment"])
                left.append(w["left"])
                content.append(text[start : start + w["size"]])
        yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(fragment, pa.int64()), pa.array(left, pa.int32()), pa.array(content, pa.binary())], ["anchor", "fragment", "left", "content"])


def _intervals(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """``anchor, fragment, from, to`` (relative to the anchor) of the repeated bytes of whole groups of fragments."""
    rows = list({row[:2]: row for row in rows}.values())  # a fragment of several buckets must not match itself
    symbols = np.full((len(rows), WIDTH), VOID, np.int16)
    for k, (_, _, left, content) in enumerate(rows):
        symbols[k, REACH - left : REACH - left + len(content)] = np.frombuffer(content, np.uint8)
    found = repeated_windows(symbols)
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    for k, a, b in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True):
        yield rows[k][0], rows[k][1], a - REACH, b - 1 + LENGTH - REACH


@tidy
def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments sorted by bucket: gather whole buckets up to ``AT_ONCE`` rows, then run the rounds on them together."""

    def out(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        columns = list(zip(*_intervals(rows), strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "fragment", "start", "stop"])

    held: list[tuple[int, int, int, bytes]] = []
    last = None
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "anchor", "fragment", "left", "content")), strict=True):
            if last == (bucket, row[1]):
                continue  # the same fragment from a copy of its text
            if len(held) >= AT_ONCE and bucket != last[0]:
                yield out(held)
                held = []
            held.append(tuple(row))
            last = bucket, row[1]
    if held:
        yield out(held)


@tidy
def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            runs: list[list[int]] = []
            for s in sorted((s["s"], s["e"]) for s in spans):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            edges = [0, *(x for r in runs for x in r), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def word_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, anchor, hash`` of every run of ``PASSAGE`` words; equal runs have equal anchors (their least-hashed gram)."""
    starts, ends, row = tv.words(data, offsets)
    if len(starts) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    word = tv.span_hash(tv.prefix_sums(data), starts, ends)
    scale = tv.powers(len(word) + 1)
    sums = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * scale[:-1], out=sums[1:])
    back = tv.powers(len(word) + 1, inverse=True)

    def runs(size: int) -> np.ndarray:
        return tv.mix((sums[size:] - sums[:-size]) * back[: len(word) - size + 1])

    whole = row[: len(word) - PASSAGE + 1] == row[PASSAGE - 1 :]
    anchor = _window_min(runs(GRAM_WORDS), PASSAGE - GRAM_WORDS + 1)
    return row[: len(whole)][whole], anchor[whole], runs(PASSAGE)[whole]


@tidy
def _word_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, data, offsets in tv.chunks(batch.column("text")):
            row, anchor, _ = word_windows(data, offsets)
            row, anchor, _ = tv.multiset(row, anchor)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row + first)), pa.array(anchor.view(np.int64))], ["key", "anchor"])


@tidy
def _shared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around anchors that other texts have as well."""
    for batch in batches:
        lists = batch.column("anchors")
        for first, last, data, offsets in tv.chunks(batch.column("text")):
            wanted = np.unique(lists.slice(first, last - first).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            row, anchor, window = word_windows(data, offsets)
            some = np.isin(anchor, wanted)
            row, window, _ = tv.multiset(row[some], window[some])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row + first)), pa.array(window.view(np.int64))], ["key", "window"])


def shared_passages(spark: SparkSession, firsts: DataFrame, copies: DataFrame) -> DataFrame:
    """``key`` of the different texts (``key, text``) that hold a run of ``PASSAGE`` words of another text, or any such run and
    stand in ``copies`` (``key``)."""
    rows = materialise(spark, firsts.mapInArrow(_word_anchors, "key binary, anchor long"), "word-anchors")
    # A text has a row for each of its anchors and windows. Repeated rows of one text (without ids, or of one id) count as two,
    # but such a text stands in ``copies``, so it is marked below in any case.
    both = rows.groupBy("anchor").count().where("count > 1").select("anchor")
    lists = materialise(spark, rows.join(both, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors")), "shared-anchors")
    some = among(firsts, lists, "key", TEXT_KEYS, exact=False).join(sized_broadcast(lists, TEXT_KEYS), "key")
    windows = materialise(spark, some.select("key", "text", "anchors").mapInArrow(_shared_windows, "key binary, window long"), "windows")
    again = windows.groupBy("window").count().where("count > 1").select("window")
    twice = rows.join(sized_broadcast(copies, BROADCAST_KEYS), "key", "left_semi").select("key")
    out = materialise(spark, windows.join(again, "window").select("key").union(twice).distinct(), "passages")
    discard(spark, rows, lists, windows)
    return out


def intervals(spark: SparkSession, contents: DataFrame) -> DataFrame:
    """``anchor, fragment, start, stop`` of the repeated bytes of fragments.

    Anchors of at most ``HOT`` fragments go to the rounds as they are. The fragments of a frequent one are told apart
    further, however many they are: windows that start in a range of columns share a core, the bytes that all of them
    cover, so only fragments of equal cores can have equal windows there. Cores are counted with map-side sums; a core of
    one fragment is done, one of few goes to the rounds, and for the rest the range is halved. Fragments that are equal over
    all windows of a range are repeated there, and one of them stands for the others from then on; a range of one column is
    settled that way.
    """
    sizes = contents.select("anchor", "fragment").distinct().groupBy("anchor").count()
    hot = materialise(spark, sizes.where(F.col("count") > HOT).select("anchor"), "hot")
    cold = contents.join(sized_broadcast(hot, BROADCAST_KEYS), "anchor", "left_anti").withColumn("bucket", F.col("anchor"))
    parts = [cold.select("bucket", "anchor", "fragment", "left", "content")]
    whole: list[DataFrame] = []
    many = materialise(spark, contents.join(sized_broadcast(hot, BROADCAST_KEYS), "anchor", "left_semi").dropDuplicates(["anchor", "fragment"]), "frequent")
    nodes = many.select("anchor", "fragment", F.lit(0).alias("lo"), F.lit(REACH).alias("hi"))
    first, last = f"({REACH} - left)", f"({REACH} - left + length(content) - {LENGTH})"

    def half(lo: str, hi: str) -> str:
        core = f"substring(content, {hi} - {first} + 1, {lo} + {LENGTH} - ({hi}))"
        reach = f"IF({lo} >= {first} AND {hi} <= {last}, substring(content, {lo} - {first} + 1, {hi} - ({lo}) + {LENGTH}), NULL)"
        own = lambda k: f"IF({reach} IS NULL, fragment, xxhash64({reach}, {k}))"
        return f"named_struct('ok', greatest({lo}, {first}) <= least({hi}, {last}), 'lo', {lo}, 'hi', {hi}, 'h', xxhash64({core}, 1), 'g', xxhash64({core}, 2), 'f', {own(1)}, 'e', {own(2)})"

    middle = "CAST(floor((lo + hi) / 2) AS INT)"
    while nodes.limit(1).count():
        both = F.expr(f"filter(array({half('lo', middle)}, {half(middle + ' + 1', 'hi')}), x -> x.ok)")
        cores = nodes.join(many, ["anchor", "fragment"]).select("anchor", "fragment", F.explode(both).alias("x"))
        cores = materialise(spark, cores.select("anchor", "fragment", "x.lo", "x.hi", "x.h", "x.g", "x.f", "x.e"), "cores")
        # Equal over all the range's windows: repeated there. One of them stays, for others to match.
        place = ["anchor", "lo", "hi", "f", "e"]
        kinds = materialise(spark, cores.groupBy(*place).agg(F.count("*").alias("n"), F.min("fragment").alias("fragment"), F.min("h").alias("h"), F.min("g").alias("g")), "kinds")
        whole.append(cores.join(kinds.where("n > 1").select(*place), place).select("anchor", "fragment", (F.col("lo") - REACH).alias("start"), (F.col("hi") + LENGTH - REACH).alias("stop")))
        cores = kinds.select("anchor", "fragment", "lo", "hi", "h", "g")
        counts = cores.groupBy("anchor", "lo", "hi", "h", "g").count().where("count > 1")
        alive = materialise(spark, cores.join(counts, ["anchor", "lo", "hi", "h", "g"]), "alive")
        few = alive.where(F.col("count") <= HOT).select(F.xxhash64("anchor", "lo", "hi", "h", "g").alias("bucket"), "anchor", "fragment")
        parts.append(few.join(many, ["anchor", "fragment"]).select("bucket", "anchor", "fragment", "left", "content"))
        big = alive.where(F.col("count") > HOT)
        nodes = materialise(spark, big.where("lo < hi").select("anchor", "fragment", "lo", "hi"), "nodes")
    rows = reduce(DataFrame.unionByName, parts)
    groups = rows.repartition("bucket").sortWithinPartitions("bucket", "fragment")
    found = groups.mapInArrow(_groups, "anchor long, fragment long, start int, stop int")
    return materialise(spark, reduce(DataFrame.unionByName, [found, *whole]).distinct(), "intervals")


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, shared_passage`` of every row."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    long = base.where(F.octet_length("text") >= LENGTH)
    # One row stands for each different text where texts are read again (more only where none of them has an id).
    many = materialise(spark, base.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where("n > 1"), "copies")
    copies = many.where(F.col("size") >= LENGTH).select("key")
    few = sized_broadcast(many.select(F.col("key").alias("of"), "first"), BROADCAST_KEYS)
    firsts = base.join(few, F.col("key") == F.col("of"), "left").where(F.col("of").isNull() | F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "key", "text")
    passages = shared_passages(spark, firsts.select("key", "text").where(F.octet_length("text") >= 2 * PASSAGE - 1), many.select("key"))
    rows = long.select("key", "text").mapInArrow(_anchor_rows, "key binary, place int, left int, size int, anchor long, fragment long, near long, far long")
    rows = materialise(spark, rows, "anchors")

    # Counts first, which are narrow; the places and side hashes of fragments only where an anchor has several kinds.
    kinds = materialise(spark, rows.groupBy("anchor", "fragment").agg(F.count("*").alias("n")), "fragments")
    anchors_seen = materialise(spark, kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where("n > 1").select("anchor", "kinds"), "repeated")
    mixed = anchors_seen.where("kinds > 1").select("anchor")
    varied = among(rows, mixed, "anchor", BROADCAST_KEYS).groupBy("anchor", "fragment").agg(F.min("near").alias("near"), F.min("far").alias("far"), F.min(F.struct("key", "place", "left", "size")).alias("at"))
    varied = materialise(spark, varied, "varied")
    # A repeated window holds HALF bytes on one side of its anchor at least, so its fragments share that side's hash.
    sides = varied.select("anchor", "fragment", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("near").alias("h")), F.struct(F.lit(1).alias("side"), F.col("far").alias("h")))).alias("x")).select("anchor", "fragment", "x.side", "x.h")
    shared = sides.groupBy("anchor", "side", "h").count().where("count > 1").drop("count")
    alive = sides.join(shared, ["anchor", "side", "h"]).select("anchor", "fragment").distinct()
    wanted = varied.join(alive, ["anchor", "fragment"]).groupBy("at.key").agg(F.collect_list(F.struct("anchor", "fragment", "at.place", "at.left", "at.size")).alias("wanted"))
    wanted = materialise(spark, wanted, "wanted")
    some = among(firsts.select("key", "text"), wanted, "key", TEXT_KEYS, exact=False)
    contents = some.join(wanted, "key").select("text", "wanted").mapInArrow(_contents, "anchor long, fragment long, left int, content binary")
    contents = materialise(spark, contents, "contents")
    discard(spark, varied, wanted)
    found = intervals(spark, contents)
    discard(spark, contents)

    # Places of texts that are not themselves copies; a copy is repeated as a whole.
    single = among(rows, anchors_seen, "anchor", BROADCAST_KEYS).join(sized_broadcast(copies, BROADCAST_KEYS), "key", "left_anti")
    parts = kinds.where("n > 1").select("anchor", "fragment", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop")).unionByName(found)
    begin, end = F.coalesce("start", -F.col("left")), F.coalesce("stop", F.col("size") - F.col("left"))
    spans = single.select("key", "place", "left", "size", "anchor", "fragment").join(parts, ["anchor", "fragment"]).select("key", (F.col("place") + begin).alias("s"), (F.col("place") + end).alias("e"))
    spans = materialise(spark, spans.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "removed")
    discard(spark, rows, kinds, anchors_seen, found)

    # Only texts that lose a part meet their spans; all others need no more than their digest.
    sized = base.select("doc_id", "key", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    partly = among(sized, spans, "key", TEXT_KEYS, exact=False).join(spans, "key").select("doc_id", "key", "text", "spans").mapInArrow(_kept, OUT)
    rest = sized.join(sized_broadcast(spans.select("key"), BROADCAST_KEYS), "key", "left_anti").select("doc_id", "key", "n_bytes", F.sha2("text", 256).alias("own"))
    rest = rest.join(sized_broadcast(copies.withColumn("whole", F.lit(True)), BROADCAST_KEYS), "key", "left")
    gone = F.coalesce("whole", F.lit(False))
    rest = rest.select("doc_id", "key", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"), F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("own")).alias("kept_sha256"))
    marked = sized_broadcast(passages.withColumn("shared_passage", F.lit(1)), BROADCAST_KEYS)
    return partly.unionByName(rest).join(marked, "key", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("shared_passage", F.lit(0)).alias("shared_passage"))
