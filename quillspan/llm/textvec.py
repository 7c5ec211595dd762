"""Whole-batch text primitives on Arrow buffers: words, rolling hashes and shingles without a Python loop per word.

Null texts are empty. Words are runs of bytes between ASCII white space (``SPACE``) or of letters and digits (``ALNUM``,
where every byte of a multi-byte character counts as a letter). No function looks at a prefix only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are expanded to numpy arrays at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(20240817)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.ones(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    key = "inv" if inverse else "pow"
    if len(_powers.get(key, ())) < n:
        step = np.full(max(n, CHUNK_BYTES + 1), _BASE_INV if inverse else _BASE, np.uint64)
        step[0] = 1
        _powers[key] = np.multiply.accumulate(step)
    return _powers[key][:n]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the base of rolling hashes, or of its inverse."""
    return _power(n, inverse)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first, last, bytes, offsets`` of successive row ranges with at most ``limit`` bytes (or one row)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, byte for byte."""
    out = _LOWER[data]
    if len(out) > 1:
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][wide] += 32
    return out


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends, row`` of the maximal runs of ``kind`` bytes; no run crosses rows."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(len(data), False), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _power(len(sums), True)[starts])


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``row, hash`` of each run of ``size`` words; a text of fewer words (but one) gives one shingle of them all."""
    starts, ends, row = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = span_hash(prefix_sums(data), starts, ends)
    count = np.bincount(row, minlength=len(offsets) - 1)
    padded = np.concatenate([word, np.zeros(size, np.uint64)])
    owner = np.concatenate([row, np.full(size, -1)])
    total = np.zeros(len(word), np.uint64)
    for k in range(size):
        same = owner[k : k + len(word)] == row
        total += np.where(same, padded[k : k + len(word)], 0).astype(np.uint64) * _GRAM[k]
    first = np.zeros(len(word), bool)
    first[np.flatnonzero(np.diff(row, prepend=-1))] = True
    whole = (owner[size - 1 : size - 1 + len(word)] == row) | (first & (count[row] < size))
    return row[whole], mix(total[whole])


def multiset(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``row, value`` in order, with their counts."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))
