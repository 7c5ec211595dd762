"""Operator 3, media columns: texts as 8-bit PNG images in binary columns, read back and given cosine-transform hashes.

A payload (UTF-8 bytes, padded with byte 32 to a positive multiple of 192) becomes an RGB image of 64 pixels a row: one
image row for each 192 bytes. Rows that mostly repeat the row above are filtered by the difference to it (type 2), others
are left as they are (type 0); the stream goes through zlib into checksummed chunks. Reading tests every
chunk's checksum and length, inflates, undoes all five filter types with numpy and checks the size.

The images are written to a table with a binary column in the shared folder; every value but ``n_bytes`` comes from the
bytes of that column, in a second pass that sees no text.

The feature is a perceptual hash: grey levels averaged to 32 x 32, a cosine transform, the 8 x 8 lowest frequencies,
one bit for each coefficient above their median, as 16 hexadecimal digits.

Defined results: null and empty texts are one row of byte 32 and have 0 unpadded bytes; equal texts give equal values;
null ids stay; an empty table gives no rows; an image higher than 2**31 - 1 rows is refused by the format.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.memory import tidy

ROW_BYTES, PAD = 192, 32
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type, at 8 bits a sample.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
SIDE, LOW = 32, 8
BATCH_BYTES = 32 << 20

_angle = np.pi / SIDE * np.outer(np.arange(LOW), np.arange(SIDE) + 0.5)
_COSINES = np.cos(_angle) * np.where(np.arange(LOW) == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))[:, None]


class BrokenImage(ValueError):
    """A PNG that fails its checksums, lengths or format."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(payload: bytes) -> bytes:
    size = max(1, -(-len(payload) // ROW_BYTES)) * ROW_BYTES
    return payload.ljust(size, bytes([PAD]))


def write_png(samples: np.ndarray, level: int = 1) -> bytes:
    """A PNG of a ``rows x (3 * width)`` array of bytes."""
    rows, wide = samples.shape
    up = samples.copy()
    up[1:] -= samples[:-1]
    # Text deflates best as it is; a difference pays where most of a row repeats the row above.
    better = (up == 0).sum(1) * 2 > wide
    lines = np.empty((rows, wide + 1), np.uint8)
    lines[:, 0] = np.where(better, 2, 0)
    lines[:, 1:] = np.where(better[:, None], up, samples)
    head = struct.pack(">IIBBBBB", wide // 3, rows, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks_of(image: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of each chunk; raises on a wrong signature, checksum or length."""
    if image[:8] != SIGNATURE:
        raise BrokenImage("no PNG signature")
    at = 8
    while at < len(image):
        if at + 12 > len(image):
            raise BrokenImage("a chunk is cut off")
        (size,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(image):
            raise BrokenImage("a chunk is shorter than declared")
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise BrokenImage(f"checksum of {kind!r}")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise BrokenImage("no IEND")


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Samples of filtered lines (first column: filter type), ``step`` bytes a pixel."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise BrokenImage("unknown filter type")
    row = 0
    while row < len(kinds):
        end = row + 1
        while end < len(kinds) and kinds[end] == kinds[row]:
            end += 1
        kind, block = kinds[row], out[row:end]
        above = out[row - 1] if row else np.zeros(out.shape[1], np.uint8)
        if kind == 1:
            wide = block.reshape(len(block), -1, step)
            np.cumsum(wide, axis=1, dtype=np.uint8, out=wide)
        elif kind == 2:
            block[0] += above
            np.cumsum(block, axis=0, dtype=np.uint8, out=block)
        elif kind in (3, 4):
            for line in block:
                left = np.zeros(step, np.int16)
                corner = np.zeros(step, np.int16)
                for k in range(0, len(line), step):
                    over = above[k : k + step].astype(np.int16)
                    if kind == 3:
                        guess = (left + over) // 2
                    else:
                        p = left + over - corner
                        a, b, c = abs(p - left), abs(p - over), abs(p - corner)
                        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, over, corner))
                    line[k : k + step] += guess.astype(np.uint8)
                    left, corner = line[k : k + step].astype(np.int16), over
                above = line
        row = end
    return out


def read_png(image: bytes) -> tuple[np.ndarray, int]:
    """``samples (rows x bytes), channels`` of an 8-bit non-interlaced PNG, with every check."""
    head, data, ended = None, [], False
    for kind, body in chunks_of(image):
        if head is None and kind != b"IHDR":
            raise BrokenImage("IHDR is not first")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
    if head is None or not ended:
        raise BrokenImage("no header or end")
    width, rows, depth, colour, method, filters, laced = head
    if depth != 8 or colour not in CHANNELS or method or filters or laced:
        raise BrokenImage("only 8-bit samples without a palette or interlacing are read")
    step = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as broken:
        raise BrokenImage(str(broken)) from broken
    if len(raw) != rows * (width * step + 1):
        raise BrokenImage("the stream's length does not fit the header")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(rows, width * step + 1), step), step


def _shrink(x: np.ndarray, side: int) -> np.ndarray:
    """Means over ``side`` equal shares of the rows; rows are repeated where there are fewer."""
    n = len(x)
    if n < side:
        return x[np.arange(side) * n // side]
    cut = np.arange(side + 1) * n // side
    return np.add.reduceat(x, cut[:-1], axis=0) / np.diff(cut)[:, None]


def cosine_hash(samples: np.ndarray, channels: int) -> str:
    grey = samples.reshape(len(samples), -1, channels).sum(2, dtype=np.float64) / channels
    small = _shrink(_shrink(grey, SIDE).T, SIDE).T
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    bits = low > np.median(low)
    return format(int.from_bytes(np.packbits(bits).tobytes(), "big"), "016x")


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


STORED = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary()}
VALUES = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


@tidy
def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The image of each text; a batch ends at ``BATCH_BYTES``, as a binary column holds 2 GiB at most."""
    for batch in batches:
        rows, held = [], 0
        for key, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.large_binary()), strict=True):
            plain = text.as_py() or b""
            image = write_png(np.frombuffer(pad(plain), np.uint8).reshape(-1, ROW_BYTES))
            rows.append((key.as_py(), len(plain), image))
            held += len(image)
            if held >= BATCH_BYTES:
                yield _batch(rows, STORED)
                rows, held = [], 0
        yield _batch(rows, STORED)


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the stored bytes hold, with every check of the format."""
    for batch in batches:
        rows = []
        for key, size, image in zip(batch.column("doc_id"), batch.column("n_bytes"), batch.column("media"), strict=True):
            stored = image.as_py()
            samples, channels = read_png(stored)
            payload = samples.tobytes()
            rows.append((key.as_py(), size.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(samples, channels)))
        yield _batch(rows, VALUES)


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: the image of every row, in a binary column."""
    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return taken.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def media_values(stored: DataFrame) -> DataFrame:
    """Digests and the cosine-transform hash of every image of a media table."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
