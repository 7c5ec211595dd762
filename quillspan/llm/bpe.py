"""Operator 4, BPE encoding and decoding with forced boundaries.

A byte pair that stands inside no vocabulary token can never be joined by merges, since every merge makes a vocabulary
token. Each such pair is therefore a certain cut. A text is split into pieces by the tokenizer file's own normaliser and
piece pattern, each piece is cut at its forced boundaries, the fragments are encoded independently by merge rank, and the
ids are concatenated.

Texts are taken ``CHUNK_CHARS`` at a time and their pieces made distinct in Arrow. The distinct pieces of a chunk that are
not remembered yet are encoded together: fragments become rows of a matrix of token ids, and each round merges the best
pair of every row. Long fragments, and bytes without a token, take a path of their own. What is remembered is bounded by
its estimated bytes (``MEMO_BYTES``).

The file is a public BPE in the ``tokenizers`` JSON layout (byte alphabet, optional end-of-word suffix, special tokens
matched in the raw text). Normalising and splitting follow the file; the merging, the cuts and the decoding are here.

Defined results: null and empty texts have no ids; their decoded text is empty; special tokens in a text give their ids
(as with add_special_tokens=False) and come back as text; repeated rows get equal results; null ids stay; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.memory import release, tidy

#: Characters of texts whose pieces are held at a time (or one longer text), and estimated bytes of each of two generations of
#: remembered pieces.
CHUNK_CHARS, MEMO_BYTES = 1 << 20, 24 << 20
#: What a remembered piece takes besides its characters, and for each character.
ENTRY_BYTES, CHAR_BYTES = 190, 5
#: Fragments up to this many bytes are rows of a matrix, so many rows at a time; a rank that no pair has.
SHORT, ROWS, NEVER = 32, 8192, np.int32(2**31 - 1)
#: Rows whose results are held at a time.
BATCH_ROWS = 512
#: Scripts beyond this character are normalised and split by the library.
LAST = 0x52F
BLANK = pa.scalar(" ", pa.large_string())

_loaded: dict[str, Encoder] = {}


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def _ranges(kind: str) -> str:
    """The characters up to ``LAST`` of a general category (``space``: white space), as ranges for a character class."""
    found = [c for c in range(LAST + 1) if (chr(c).isspace() and not 28 <= c <= 31 if kind == "space" else unicodedata.category(chr(c)).startswith(kind))]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in runs)


class Encoder:
    """Encodes and decodes texts with one vocabulary file (its JSON text)."""

    def __init__(self, layout: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(layout)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {k: t for t, k in self.vocab.items()}
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.alphabet = byte_alphabet()
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        self.tokens |= {k: t for t, k in self.added.items()}
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        for name, kind in ((r"\s", "space"), (r"\p{L}", "L"), (r"\p{N}", "N")):
            pattern = pattern.replace(name, _ranges(kind))
        self.pieces = re.compile(pattern).findall
        self.beyond = re.compile(rf"[^\u0000-\u{LAST:04x}]").search
        # Only the library's normaliser and splitter are kept; it never sees the vocabulary.
        library = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.whole, self.split_whole = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.bytes_of = {c: b for b, c in self.alphabet.items()}
        self.plain = [s["type"] for s in spec["normalizer"].get("normalizers", [spec["normalizer"]])] == ["NFC", "Replace", "Lowercase"]
        self.inside = self._inside()
        self._tables()
        self.forget()

    def _tables(self) -> None:
        """Ids of single bytes (inside a piece, and at its end), cuts by byte pair, and merges as sorted pairs of ids."""
        alone = [self.alphabet[b] for b in range(256)]
        self.first = np.array([[self.vocab.get(c + end, -1) for c in alone] for end in ("", self.suffix)], np.int32)
        self.joins = np.zeros((256, 256), bool)
        for a, b in self.inside:
            self.joins[self.bytes_of[a], self.bytes_of[b]] = True
        self.size = max(self.tokens) + 1
        usable = [(self.vocab[a] * self.size + self.vocab[b], k, self.vocab[a + b]) for (a, b), k in self.ranks.items() if a in self.vocab and b in self.vocab and a + b in self.vocab]
        self.made = np.full(max([k for _, k, _ in usable], default=0) + 1, -1, np.int32)
        self.made[[k for _, k, _ in usable]] = [made for _, _, made in usable]
        usable.sort()
        self.pair = np.array([x[0] for x in usable] or [-1], np.int64)
        self.rank = np.array([x[1] for x in usable] or [NEVER], np.int32)
        #: Ids as text and tokens, by id.
        self.texts = [pa.array(x, pa.large_string()) for x in ([str(k) for k in range(self.size)], [self.tokens.get(k, "") for k in range(self.size)])]

    def forget(self) -> None:
        """A task starts without remembered pieces, and an idle worker holds none for long."""
        #: Ids (32 bits each) of the pieces met lately, and of those met before, and the estimated size of the former.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _inside(self) -> frozenset[tuple[str, str]]:
        """Character pairs (bytes, in the byte alphabet) that stand side by side in some vocabulary token."""
        cut = len(self.suffix)
        bare = (t[:-cut] if cut and t.endswith(self.suffix) else t for t in self.vocab)
        return frozenset(pair for t in bare for pair in zip(t, t[1:], strict=False) if pair[0] in self.bytes_of and pair[1] in self.bytes_of)

    def merge(self, fragment: str, ends: bool) -> list[int]:
        """Ids of one fragment (in the byte alphabet), by a heap of pairs: the lowest rank merges first, the leftmost among
        equals, n log n for n symbols."""
        parts: list[str | None] = list(fragment)
        if ends:
            parts[-1] += self.suffix
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        ranks = self.ranks
        queue = [(r, k, parts[k], parts[k + 1]) for k in range(len(parts) - 1) if (r := ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, one, two = heapq.heappop(queue)
            n = after[k]
            if parts[k] != one or n < 0 or parts[n] != two:
                continue
            parts[k], parts[n] = one + two, None
            after[k] = after[n]
            if after[k] >= 0:
                before[after[k]] = k
                if (r := ranks.get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(queue, (r, k, parts[k], parts[after[k]]))
            if before[k] >= 0 and (r := ranks.get((parts[before[k]], parts[k]))) is not None:
                heapq.heappush(queue, (r, before[k], parts[before[k]], parts[k]))
        return [self.vocab[p] for p in parts if p is not None and p in self.vocab]

    def _ranked(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, ``NEVER`` where there is no merge. Negative ids merge with nothing."""
        wanted = np.where((one < 0) | (two < 0), -2, one.astype(np.int64) * self.size + two)
        at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        return np.where(self.pair[at] == wanted, self.rank[at], NEVER)

    def _merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids, filled up with -1, after all merges. Each round merges the best pair of every row that has one."""
        out, where, wide = ids.copy(), np.arange(len(ids)), ids.shape[1]
        # One more column on the right, so that rows can move up by one in place.
        ids = np.hstack([ids, np.full((len(ids), 1), -1, np.int32)])
        rank = np.hstack([self._ranked(ids[:, :-2], ids[:, 1:-1]), np.full((len(ids), 2), NEVER, np.int32)])[:, : wide + 1]
        column = np.arange(wide)
        while len(ids) and wide > 1:
            k = rank.argmin(1)
            best = rank[np.arange(len(ids)), k]
            more = best < NEVER
            if not more.all():
                out[where[~more]] = ids[~more, :wide]
                ids, rank, where, k, best = ids[more], rank[more], where[more], k[more], best[more]
            every = np.arange(len(ids))
            # What stands behind the pair moves up by one.
            flat = column + every[:, None] * (wide + 1)
            ids[:, :wide] = ids.ravel()[flat + (column > k[:, None])]
            rank[:, :wide] = rank.ravel()[flat + (column >= k[:, None])]
            ids[every, k] = self.made[best]
            left = np.maximum(k - 1, 0)
            rank[every, k] = self._ranked(ids[every, k], ids[every, k + 1])
            rank[every, left] = self._ranked(ids[every, left], ids[every, left + 1])
        return out

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``ids, offsets`` of many pieces: cut at forced boundaries, fragments merged independently."""
        raw = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        last = np.zeros(len(data), bool)  # of a piece
        last[ends[np.diff(ends, prepend=0) > 0] - 1] = True
        cut = last.copy()
        cut[:-1] |= ~self.joins[data[:-1], data[1:]]
        stop = np.flatnonzero(cut) + 1
        start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        symbols = self.first[last.astype(int), data] if self.suffix else self.first[0][data]
        size = stop - start
        known = np.bitwise_and.reduceat((symbols >= 0).astype(np.uint8), start).astype(bool) if len(start) else np.zeros(0, bool)
        quick = known & (size <= SHORT)
        total = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # fragments and their ids, one after another
        order = np.flatnonzero(quick)
        order = order[np.argsort(size[order], kind="stable")]
        for some in (order[j : j + ROWS] for j in range(0, len(order), ROWS)):
            wide = int(size[some].max())
            place = start[some][:, None] + np.arange(wide)
            inside = np.arange(wide) < size[some][:, None]
            rows = self._merge_rows(np.where(inside, symbols[np.minimum(place, len(data) - 1)], np.int32(-1)))
            total[some] = (rows >= 0).sum(1)
            parts.append((some, rows[rows >= 0]))
        for k in np.flatnonzero(~quick):
            fragment = "".join(map(self.alphabet.__getitem__, data[start[k] : stop[k]].tolist()))
            ids = self.merge(fragment, bool(last[stop[k] - 1]))
            total[k] = len(ids)
            parts.append((np.array([k]), np.array(ids, np.int32)))
        offset = np.concatenate([[0], np.cumsum(total)])
        out = np.zeros(offset[-1], np.int32)
        for some, ids in parts:
            n = total[some]
            within = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(offset[some], n) + within] = ids
        return out, np.concatenate([[0], offset[np.searchsorted(stop, ends, "right")]])

    def split(self, text: str) -> list[str]:
        """Normalised pieces. For scripts up to Cyrillic, composition, small letters and the file's pattern give them (white
        space, which the file squeezes, separates pieces either way; a capital sigma is small everywhere, as the file maps
        by letter). Beyond, also after composition, letter classes depend on the library's Unicode version, so its own splitter is asked."""
        if self.plain and text.isascii():
            return self.pieces(text.lower())
        if self.plain and not self.beyond(text) and not self.beyond(whole := unicodedata.normalize("NFC", text)):
            return self.pieces(whole.replace("\u03a3", "\u03c3").lower())
        return [bytes(map(self.bytes_of.__getitem__, p)).decode() for p, _ in self.split_whole(self.whole(text))]

    def learn(self, distinct: list[str]) -> None:
        """Remember the ids of ``distinct``. Pieces not met since ``MEMO_BYTES`` of others were remembered are forgotten."""
        if self.held > MEMO_BYTES:
            self.older, self.memo, self.held = self.memo, {}, 0
        fresh = [p for p in distinct if p not in self.memo]
        found = {p: ids for p in fresh if (ids := self.older.get(p)) is not None}
        new = [p for p in fresh if p not in found] if found else fresh
        self.memo |= found
        self.held += sum(map(len, fresh)) * CHAR_BYTES + ENTRY_BYTES * len(fresh)
        if new:
            ids, cut = self.encode_pieces(new)
            raw, cut = ids.tobytes(), (cut * 4).tolist()
            self.memo |= zip(new, [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True)

    def _encode_chunk(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
        """For texts as pieces: all ids, how many each text has, and for each text its ids and its tokens joined by blanks."""
        coded = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(distinct)
        raw = list(map(self.memo.__getitem__, distinct))
        size = np.array(list(map(len, raw)), np.int64) // 4
        cut = np.concatenate([[0], np.cumsum(size)])
        ids = np.frombuffer(b"".join(raw), np.int32)
        code, text = coded.indices.to_numpy(), np.repeat(np.arange(len(split)), list(map(len, split)))
        if len(size) and not size.all():  # pieces without ids leave no blank
            some = size[code] > 0
            code, text = code[some], text[some]
        place = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(split)))])
        joined = []
        for known in self.texts:
            each = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), known.take(pa.array(ids))), BLANK)
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(place, pa.int32()), each.take(pa.array(code))), BLANK)
            joined.append(whole.cast(pa.large_binary()).to_pylist())
        many = size[code]
        total = np.bincount(text, many, minlength=len(split)).astype(np.int64)
        start = np.repeat(cut[code] - (np.cumsum(many) - many), many)
        return ids[start + np.arange(len(start))], total, *joined

    def _encode_special(self, text: str) -> tuple[np.ndarray, bytes, bytes]:
        """The same for one text with special tokens."""
        out: list[np.ndarray] = []
        for k, part in enumerate(self.special.split(text)):
            out.append(np.array([self.added[part]], np.int32) if k % 2 else self._encode_chunk([self.split(part)])[0])
        ids = np.concatenate(out)
        return ids, *(" ".join(known.take(pa.array(ids)).to_pylist()).encode() for known in self.texts)

    def encode_texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes, bytes]]:
        """For each text: its ids, and its ids and tokens joined by blanks."""
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last] or "") <= CHUNK_CHARS):
                size += len(texts[last] or "")
                last += 1
            special = [bool(t and self.special and self.special.search(t)) for t in texts[first:last]]
            split = [self.split(t) if t and not apart else [] for t, apart in zip(texts[first:last], special, strict=True)]
            ids, total, names, tokens = self._encode_chunk(split)
            del split
            each = np.split(ids, np.cumsum(total)[:-1])
            for k, apart in enumerate(special):
                yield self._encode_special(texts[first + k]) if apart else (each[k], names[k], tokens[k])
            first = last

    def encode(self, text: str | None) -> list[int]:
        ((ids, _, _),) = self.encode_texts([text])
        return ids.tolist()

    def decode(self, ids: list[int]) -> str:
        """As a file without a decoder asks: the tokens, special ones included, joined by blanks."""
        return " ".join(self.tokens[k] for k in ids if k in self.tokens)


def load(layout: str) -> Encoder:
    """One encoder for each vocabulary and worker."""
    key = hashlib.sha256(layout.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Encoder(layout)
        release()
    return _loaded[key]


def encode_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, on request) for every row.

    ``vocabulary`` is the tokenizer file's path on the driver; its 2 MB of text go out in one broadcast.
    """
    with open(vocabulary, encoding="utf-8") as file:
        layout = spark.sparkContext.broadcast(file.read())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(layout.value)
        for batch in (b.slice(j, BATCH_ROWS) for b in batches for j in range(0, len(b), BATCH_ROWS)):
            sizes, digests, back, lists = [], [], [], []
            for found, joined, text in encoder.encode_texts(batch.column("text").to_pylist()):
                sizes.append(len(found))
                digests.append(hashlib.sha256(joined).hexdigest())
                back.append(hashlib.sha256(text).hexdigest())
                if ids:
                    lists.append(found)
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                arrays.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        encoder.forget()

    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return taken.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
