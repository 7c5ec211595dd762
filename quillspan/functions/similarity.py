"""Pairwise similarity. Token similarity runs in one Arrow function, column-wise over the different tokens of a batch;
bands are native expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Token pairs that a worker remembers (some 300 bytes each), and token pairs laid out at once.
MEMO, AT_ONCE = 30_000, 1 << 20


@lru_cache(maxsize=MEMO)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with the prefix bonus always applied; equal strings 1, an empty one 0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    from_a = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                from_a.append(x)
                break
    if not from_a:
        return 0.0
    from_b = [y for y, unused in zip(b, free, strict=True) if not unused]
    m, swapped = len(from_a), sum(x != y for x, y in zip(from_a, from_b, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def token_set_similarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Each token of the shorter list takes its best unused partner; the mean over the shorter list."""
    if not a or not b:
        return 0.0
    one, two = sorted((a, b))
    if len(one) > len(two):
        one, two = two, one
    left = dict(enumerate(two))
    total = 0.0
    for token in one:
        best = max(left, key=lambda j: (jaro_winkler(token, left[j]), -j), default=None)
        if best is not None and (value := jaro_winkler(token, left[best])) > 0:
            total += value
            del left[best]
    return total / len(one)


def _matched(one: np.ndarray, two: np.ndarray, words: list[str]) -> np.ndarray:
    """P3 of rows of token codes (padded with -1), the shorter list first; codes follow the order of ``words``."""
    size = (one >= 0).sum(1)
    real = (one >= 0)[:, :, None] & (two >= 0)[:, None, :]
    codes, place = np.unique((one[:, :, None].astype(np.int64) * len(words) + two[:, None, :])[real], return_inverse=True)
    value = np.full(real.shape, -1.0)
    value[real] = np.array([jaro_winkler(words[c // len(words)], words[c % len(words)]) for c in codes.tolist()])[place]
    total, rows = np.zeros(len(one)), np.arange(len(one))
    for k in range(one.shape[1]):
        here = value[:, k]
        best = here.argmax(1)  # the first of equals
        gain = here[rows, best]
        total += np.maximum(gain, 0.0)
        hit = gain > 0
        value[rows[hit], :, best[hit]] = -1.0
    return total / np.maximum(size, 1)


def token_similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """``token_set_similarity`` of each row of two list arrays; a null list is an empty one."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
    flat = pc.fill_null(pa.concat_arrays([a.flatten(), b.flatten()]).cast(pa.string()), "").dictionary_encode()
    held = flat.dictionary.to_pylist()
    order = sorted(range(len(held)), key=held.__getitem__)
    rank = np.empty(len(held), np.int64)
    rank[order] = np.arange(len(held))
    codes, words = rank[flat.indices.to_numpy(zero_copy_only=False)], [held[k] for k in order]
    codes = np.append(codes, -1)
    starts = [np.cumsum(sizes[0]) - sizes[0], np.cumsum(sizes[1]) - sizes[1] + sizes[0].sum()]
    out, longest = np.zeros(len(a)), np.maximum(*sizes)
    some, width = np.minimum(*sizes) > 0, 1
    while width < 2 * longest.max(initial=0):
        mine = np.flatnonzero(some & (longest <= width) & (longest > width // 2))
        step = max(1, AT_ONCE // width**2)
        for rows in (mine[k : k + step] for k in range(0, len(mine), step)):
            at = np.arange(width)
            one, two = (codes[np.where(at < n[rows, None], s[rows, None] + at, -1)] for n, s in zip(sizes, starts, strict=True))
            off = np.argmax(one != two, axis=1)[:, None]
            later = np.take_along_axis(one, off, 1)[:, 0] > np.take_along_axis(two, off, 1)[:, 0]
            swap = ((sizes[0][rows] > sizes[1][rows]) | ((sizes[0][rows] == sizes[1][rows]) & later))[:, None]
            out[rows] = _matched(np.where(swap, two, one), np.where(swap, one, two), words)
        width *= 2
    return out


@F.arrow_udf(T.DoubleType())
def token_similarity(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """P3 on columns of token arrays; a null array is an empty one."""
    for a, b in batches:
        yield pa.array(token_similarities(a, b), pa.float64())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _all_similarities(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for columns in batches:
        values = np.stack([token_similarities(a, b) for a, b in zip(columns[::2], columns[1::2], strict=True)], axis=1)
        yield pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), values.ravel())


#: Declared non-deterministic although it is not, so that Spark neither runs it again for a filter on its result nor copies
#: it into each expression that uses it: every copy would be a Python worker more for each task, over all columns of the rows.
_once = _all_similarities.asNondeterministic()


def token_similarities_of(pairs: list[tuple[Column, Column]]) -> Column:
    """P3 of several pairs of token arrays as ``array<double>``, in one pass of one worker."""
    return _once(*[c for pair in pairs for c in pair])


def damerau1(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda k: F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1)))
    x, y = F.get(places, 0), F.get(places, 1)
    swap = (F.size(places) == 2) & (y == x + 1) & (F.substring(a, x, F.lit(1)) == F.substring(b, y, F.lit(1))) & (F.substring(a, y, F.lit(1)) == F.substring(b, x, F.lit(1)))
    return F.when(F.length(a) == F.length(b), (F.size(places) <= 1) | swap).otherwise((F.abs(F.length(a) - F.length(b)) == 1) & (F.levenshtein(a, b) <= 1))


def ladder(value: Column, steps: list[tuple[float, str]], last: str | None) -> Column:
    """The name of the first threshold that ``value`` reaches."""
    out = F.lit(last)
    for least, name in reversed(steps):
        out = F.when(value >= least, name).otherwise(out)
    return out


def band_name(similarity: Column) -> Column:
    """P4."""
    return ladder(similarity, [(0.92, "name_exact"), (0.78, "name_close"), (0.60, "name_weak")], "name_diff")


def band_father(similarity: Column, a: Column, b: Column) -> Column:
    """P5: null unless both have father skeletons."""
    seen = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(seen, ladder(similarity, [(0.85, "father_match"), (0.6, "father_weak")], "father_diff"))


def band_cnic(a: Column, b: Column) -> Column:
    """On ``struct<digits, prefix, last>``."""
    full = a["digits"].isNotNull() & b["digits"].isNotNull()
    digits = F.when(a["digits"] == b["digits"], "cnic_exact").when(damerau1(a["digits"], b["digits"]), "cnic_close").otherwise("cnic_diff")
    parts = a["prefix"].isNotNull() & b["prefix"].isNotNull()
    masked = F.when((a["prefix"] == b["prefix"]) & (a["last"] == b["last"]), "cnic_masked_match").when(a["prefix"] != b["prefix"], "cnic_diff_prefix")
    return F.when(full, digits).when(parts, masked)


def band_equal(a: Column, b: Column, name: str) -> Column:
    """Match or diff; null where either value is missing or empty."""
    return F.when((a != "") & (b != ""), F.when(a == b, f"{name}_match").otherwise(f"{name}_diff"))


def band_address(a: Column, b: Column, area_similarity: Column) -> Column:
    """On parsed addresses; null unless both are there."""
    same = (a["house"] == b["house"]) & (a["street"].eqNullSafe(b["street"]) | a["street"].isNull() | b["street"].isNull())
    same = F.coalesce(same, F.lit(False))
    city = F.coalesce(a["city"] == b["city"], F.lit(True))
    band = F.when(same & (area_similarity >= 0.6), "addr_exact").when(same & city, "addr_house_match")
    band = band.when((area_similarity >= 0.75) & a["city"].eqNullSafe(b["city"]), "addr_area_match").otherwise("addr_diff")
    return F.when(a.isNotNull() & b.isNotNull(), band)


def observed(*bands: Column) -> Column:
    """P10: the bands that could be compared, in order."""
    return F.filter(F.array(*bands), lambda x: x.isNotNull())


def score_bits(bands: Column, weights: dict[str, float]) -> Column:
    """The sum of the bands' weights; an unknown band counts 0."""
    table = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]) if weights else F.create_map(F.lit(""), F.lit(0.0))
    return F.aggregate(bands, F.lit(0.0), lambda s, b: s + F.coalesce(F.try_element_at(table, b), F.lit(0.0)))


def posterior(score: Column, prior_logodds: Column | float) -> Column:
    """The probability of a match from bits of evidence."""
    odds = score + prior_logodds
    power = F.pow(F.lit(2.0), F.least(odds, F.lit(50.0)))
    return F.when(odds > 50, 1.0).otherwise(power / (1 + power))


def cosine(a: Column, b: Column) -> Column:
    """The inner product of two unit vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def band_embedding(value: Column) -> Column:
    return ladder(value, [(0.85, "emb_high"), (0.70, "emb_mid"), (0.50, "emb_low")], "emb_diff")
