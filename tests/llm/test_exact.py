"""Operators 2 to 5, 7 and 8: round trips and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspan.llm import bpe, mixing, pii, png, repeats, warc
from quillspan.llm.queries import ORACLES, QUERIES
from quillspan.sources.shared import among
from tests.compare import oracle_rows, rows_of

SMALL = "/root/testdata/sf0.001"
LAYOUT = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    columns, expected = oracle_rows(ORACLES[name], SMALL)
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


# Operator 2


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [b"", b"\nabc\n", b"x" * 5000, "é".encode()]
    data = warc.write_arc(version, [(f"http://a/{k}", "1.2.3.4", "20010203040506", "text/html", b) for k, b in enumerate(bodies)])
    reader = warc.ArcReader(data)
    assert reader.version == version
    assert [r.body for r in reader] == bodies
    with pytest.raises(warc.BrokenArchive):
        list(warc.ArcReader(data[:-3]))


def test_warc_checks():
    record = warc.ArcRecord({"URL": "http://a", "Archive-date": "2001", "IP-address": "0.0.0.0", "Content-type": "t"}, b"body")
    member = warc.gzip_member(warc.convert(record, hashlib.sha256(b"body").hexdigest(), 1, None, 4))
    ((fields, block),) = warc.read_warc(member)
    assert block == b"body"
    assert fields["WARC-Date"] == "2001-01-01T00:00:00Z"
    with pytest.raises(warc.BrokenArchive):
        list(warc.read_warc(member[:-4]))


def test_pages_edge_rows(spark):
    big = "p" * 200
    rows = [(1, "http://a b", big), (2, None, big), (2, None, big), (None, "u", big), (3, "u", None), (4, "u", ""), (5, "u", "é" * 99), (6, "u", "é" * 99), (7, "u\n", "s" * 99), (8, "u", "s" * 99)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    archives, records = warc.archive_pages(spark, pages)
    found = records.collect()
    assert archives.count() >= 1
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found}
    assert (by[1]["record_type"], by[2]["refers_to"], by[None]["refers_to"]) == ("response", 1, 1)
    assert (by[6]["record_type"], by[6]["payload_bytes"], by[8]["record_type"]) == ("revisit", 198, "response")
    assert by[3]["payload_digest"] == by[4]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    assert len({r["record_id"] for r in found if r["page_id"] not in (2,)}) == 8
    assert warc.archive_pages(spark, pages.limit(0))[1].count() == 0


# Operator 3


@given(st.binary(max_size=2000))
@settings(max_examples=60, deadline=None)
def test_png_round_trip(payload):
    samples = np.frombuffer(png.pad(payload), np.uint8).reshape(-1, png.ROW_BYTES)
    image = png.write_png(samples)
    back, channels = png.read_png(image)
    assert channels == 3
    assert np.array_equal(back, samples)
    assert re.fullmatch("[0-9a-f]{16}", png.cosine_hash(back, channels))


@pytest.mark.parametrize("kind", range(5))
def test_all_filters(kind):
    rng = np.random.default_rng(kind)
    x = rng.integers(0, 256, (7, 12)).astype(np.uint8)
    lines = np.zeros((7, 13), np.uint8)
    lines[:, 0] = kind
    for r in range(7):
        for k in range(12):
            a = int(x[r, k - 3]) if k >= 3 else 0
            b = int(x[r - 1, k]) if r else 0
            c = int(x[r - 1, k - 3]) if r and k >= 3 else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[r, k + 1] = (int(x[r, k]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    assert np.array_equal(png.unfilter(lines, 3), x)


def test_broken_images():
    image = png.write_png(np.full((3, 192), 65, np.uint8))
    for broken in (image[1:], image[:-5], image[:40] + bytes([image[40] ^ 1]) + image[41:], b""):
        with pytest.raises(png.BrokenImage):
            png.read_png(broken)


def test_media_rows(spark, edges):
    stored = png.media_table(edges)
    assert stored.columns == ["doc_id", "n_bytes", "media"]
    images = {r["media"] for r in stored.collect()}
    assert len(images) == len({r["text"] or "" for r in edges.select("text").collect()})
    by_digest = {hashlib.sha256(x).hexdigest(): x for x in images}
    for r in png.media_values(stored).join(edges.select("doc_id", "text").distinct(), "doc_id").collect():
        payload = png.pad((r["text"] or "").encode())
        assert (r["n_bytes"], r["payload_bytes"]) == (len((r["text"] or "").encode()), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert png.read_png(by_digest[r["media_sha256"]])[0].tobytes() == payload
        assert r["media_bytes"] == len(by_digest[r["media_sha256"]])
    assert png.media_values(stored).count() == edges.count()
    assert png.media_values(png.media_table(edges.limit(0))).count() == 0


def test_media_batches_end_at_their_bytes(spark, edges, monkeypatch):
    monkeypatch.setattr(png, "BATCH_BYTES", 100)
    batch = edges.select("doc_id", "text").toArrow().combine_chunks().to_batches()[0]
    parts = list(png._store(iter([batch])))
    assert len(parts) > 3
    assert sum(len(p) for p in parts) == len(batch)
    assert sum(len(p) for p in png._read(iter(parts))) == len(batch)


# Operator 4

ENCODER, LIBRARY = bpe.Encoder(LAYOUT), Tokenizer.from_str(LAYOUT)


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" '\n\tsStTaAΣİ<|>endoftext"))), max_size=60))
@settings(max_examples=300, deadline=None)
def test_encodes_as_the_library(text):
    found = LIBRARY.encode(text, add_special_tokens=False)
    assert ENCODER.encode(text) == found.ids
    assert ENCODER.decode(found.ids) == LIBRARY.decode(found.ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["<|startoftext|>A <|endoftext|>b", "x" * 4000, "don't we'll", "", None])
def test_special_and_long(text):
    assert ENCODER.encode(text) == LIBRARY.encode(text or "", add_special_tokens=False).ids


ALPHABETS = [
    "abcdefghij 's't", "\x00\x01\x1c\x1d\x1e\x1f\x85\xa0 \t\nab", "éèñÀÖß²³¼½ àİıſ", "αβγΣσςΩ ά", "АБВгд ԯЀ", "áe\u0308\u0303\u0300 n", "😀🎉👍\u200d❤ ẽ",
    "<|startoftext|> <|endoftext|>AB", "0123456789١٢ ⅓", "xqzjkvw'll're'S'D",
]


def test_many_strings_encode_as_the_library():
    """21,000 strings over ten alphabets and all of them mixed, in texts of all sizes at once; the memo turns over."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABETS[k % 10] if k % 3 else "".join(ALPHABETS)) for _ in range(rng.randint(1, 60))) for k in range(21_000)]
    encoder = bpe.Encoder(LAYOUT)
    for text, (ids, joined, tokens) in zip(texts, encoder.encode_texts(texts), strict=True):
        expected = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert joined.decode() == " ".join(map(str, expected))
        assert tokens.decode() == LIBRARY.decode(expected, skip_special_tokens=False)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 500)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(7)) for _ in range(60)) for _ in range(60)]
    encoder = bpe.Encoder(LAYOUT)
    for text, (ids, _, _) in zip(texts, encoder.encode_texts(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert len(encoder.memo) + len(encoder.older) < 500


def test_cuts_are_never_joined():
    """The fragments' ids concatenated are the ids of merging the uncut piece, by either way of merging."""
    for word in ("straßenüberquerung", "xqzjkv", "internationalization", "zzqqxx", "zzqqxx" * 9):
        held = "".join(map(ENCODER.alphabet.__getitem__, word.encode()))
        assert ENCODER.merge(held, True) == ENCODER.encode_pieces([word])[0].tolist()


def test_encoded_rows(spark, edges):
    rows = bpe.encode_documents(spark, edges, public_tokenizers.path("word_bpe_49k.json"), ids=True).collect()
    assert len(rows) == edges.count()
    known = {r["doc_id"]: r["text"] for r in edges.collect()}
    for r in rows:
        if r["doc_id"] is not None:
            ids = LIBRARY.encode(known[r["doc_id"]] or "", add_special_tokens=False).ids
            assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# Operator 5

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checked(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute_spans(text: str) -> str:
    out = [(m.start(), k, kind, m.end()) for k, (kind, pattern) in enumerate(PLAIN.items()) for m in re.finditer(pattern, text) if checked(kind, m[0])]
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out))


def test_spans_against_plain_patterns(spark):
    rng = random.Random(3)
    alphabet = "ab@@..+--_%0123456789 ()é😀x1255"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", None, "1" * 50_000, "1 " * 30_000 + "@", "a@" * 5000 + "a.b", "+1" * 20_000, "x" * 3000 + "@a.b", "a@b.c_d@e.f%x@y.z", "4111 1111 1111 1111 and +1 (017) 555-7713, 000255.1.2.3 256.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    for r in df.select("text", pii.joined(pii.base_spans(F.coalesce("text", F.lit("")))).alias("found")).collect():
        assert r["found"] == brute_spans(r["text"] or "")


def test_disclosing_terms(spark):
    """A word that stands only beside addresses discloses them; one that stands everywhere does not."""
    rows = [(k, f"common words here zephyrine me{k}@mail.org common end") for k in range(30)]
    rows += [(100 + k, "common words of the other kind " * 40) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.spans(spark, docs).collect()}
    at = rows[3][1].index("zephyrine")
    assert f"term:{at}:{at + 9}" in found[3]["spans"]
    assert found[3]["n_email"] == 1
    assert found[100]["spans"] == ""
    assert all("term" not in x or x.startswith("term") for x in found[3]["spans"].split(","))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, docs).collect()}
    assert "zephyrine" not in clean[3]
    assert "[EMAIL]" in clean[3]
    assert "common" in clean[3]
    assert clean[100] == rows[-1][1]


@pytest.mark.parametrize("times", [1, 20])
def test_rare_terms_are_judged_at_any_size(spark, times):
    """Terms that stand near one, two or four entities only; the flagged terms are the same in a table many times as large."""
    rows = ["common words here zephyrine me@mail.org common", "common words quillon you@mail.org common"] * 2 + ["zephyrine common words too@mail.org here", "zephyrine one@mail.org"]
    rows += ["words hapaxia İzmirli four@mail.org common", "gluedé5@mail.org words"] + ["common words here of the other kind " * 40] * 30
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows * times)], "doc_id long, text string")
    out = pii.spans(spark, docs).where(f"doc_id < {len(rows)}").collect()
    terms = {rows[r["doc_id"]][int(s) : int(e)] for r in out for kind, s, e in (x.split(":") for x in r["spans"].split(",") if x) if kind == "term"}
    assert terms == {"zephyrine", "quillon", "hapaxia", "İzmirli", "gluedé"}


def test_sanitise_edge_rows(spark, edges):
    out = pii.sanitise(spark, edges.union(edges.where("doc_id = 1").withColumn("text", F.lit("call +1 (017) 555-7713 now"))))
    assert out.columns == edges.columns
    assert out.count() == edges.count() + 2 - 1
    row = out.where("text LIKE 'call%'").first()
    assert (row["text"], row["n_chars"]) == ("call [PHONE] now", 16)
    assert out.where("text IS NULL").count() == 2
    assert pii.spans(spark, edges.limit(0)).count() == 0


# Operator 7


def brute_repeats(texts: list[bytes]) -> list[tuple[int, int, int, str]]:
    seen = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        runs = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_repeats_against_brute_force(spark, words, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    passage, other = " ".join(words(150)), " ".join(words(90))
    texts = [" ".join(words(60)) + passage + " ".join(words(50)) for _ in range(6)]
    texts += [passage[7:] + other, other, other[:399], other[1:] + "é", "ab" * 500, "xyz" * 133 + "x", passage, passage, "", None, "q" * 399, "q" * 400, "q" * 401]
    texts += [" ".join(words(200)) for _ in range(3)] + [texts[0][:420] + " ".join(words(80))]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, anchor string")
    found = sorted(map(tuple, repeats.remove_repeats(spark, df).collect()))
    expected = brute_repeats([(t or "").encode() for t in texts])
    assert [f[1:5] for f in found] == expected
    assert [f[5] for f in found] == brute_passages(texts)


def brute_passages(texts: list[str | None]) -> list[int]:
    runs = [{tuple(w[k : k + 51]) for k in range(len(w) - 50)} for w in (re.split("[\t\n\x0b\f\r ]+", (t or "").strip("\t\n\x0b\f\r ")) for t in texts)]
    held = Counter(r for x in runs for r in x)
    return [int(any(held[r] > 1 for r in x)) for x in runs]


def test_many_keys_go_as_bits_and_tables_are_deleted(spark, words, monkeypatch):
    """Beyond the limits the result is the same, and nothing but what the result reads stays on disk."""
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", 2)
    monkeypatch.setattr(repeats, "TEXT_KEYS", 2)
    made, write = {}, repeats.materialise

    def noted(session, df, name):
        made[name] = write(session, df, name)
        return made[name]

    monkeypatch.setattr(repeats, "materialise", noted)
    passage = " ".join(words(150))
    texts = [" ".join(words(60)) + passage[k:] + " ".join(words(50)) for k in range(8)] + [" ".join(words(200)) for _ in range(8)]
    out = repeats.remove_repeats(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = [tuple(r)[1:5] for r in sorted(out.collect())]
    assert found == brute_repeats([t.encode() for t in texts])
    left = {name for name, df in made.items() if Path("/" + df._quillspan_path.removeprefix("file:").lstrip("/")).exists()}
    assert {"passages", "copies", "removed"} <= left
    assert not left & {"word-anchors", "shared-anchors", "windows", "anchors", "fragments", "varied", "wanted", "contents", "intervals"}


def test_rows_without_a_key_are_not_shuffled(spark):
    rows, keys = spark.range(20_000).withColumn("key", F.unhex(F.md5(F.col("id").cast("string")))), spark.range(0, 20_000, 7)
    keys = keys.select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"))
    likely = among(rows, keys, "key", 10, exact=False)
    assert likely.columns == rows.columns
    assert likely.join(keys, "key").count() == keys.count()
    assert likely.count() < 1.5 * keys.count()
    for limit in (10, 10**6):
        assert among(rows, keys, "key", limit).count() == keys.count()
    assert among(rows, keys.limit(0), "key", 10).count() == 0


def test_short_passages_are_marked(spark, words):
    """Passages of 50 words are not marked, of 51 are, with short words (under 400 bytes, so that nothing is removed) too."""
    texts = []
    for size in (50, 51, 55):
        passage = " ".join(w[:4] for w in words(size))
        texts += [" ".join(words(n)) + " " + passage + "\n" + " ".join(words(30)) for n in (0, 20, 90)]
    texts += [" ".join(words(120)) for _ in range(5)] + [" ".join(words(51))] * 2 + [" ".join(words(50))] * 2 + ["", None, "one"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_removed"], r["shared_passage"]) for r in repeats.remove_repeats(spark, df).collect())
    assert [f[2] for f in found] == brute_passages(texts) == [0] * 3 + [1] * 6 + [0] * 5 + [1] * 2 + [0] * 5
    assert not any(f[1] for f in found)


def test_repeats_edge_rows(spark, edges):
    assert repeats.remove_repeats(spark, edges).count() == edges.count()
    assert repeats.remove_repeats(spark, edges.limit(0)).count() == 0


# Operator 8


def test_raked_margins(spark, small_docs):
    rows = mixing.weigh(spark, small_docs).toPandas()
    assert set(rows["kept"]) <= {0, 1}
    assert rows["probability"].between(0, 1).all()
    kept = (rows["probability"] * rows["n_tokens"]).sum() / rows["n_tokens"].sum()
    assert kept == pytest.approx(mixing.BUDGET, abs=0.02)
    for margin, exponent in mixing.MARGINS.items():
        own = rows.groupby(margin)["n_tokens"].sum() ** exponent
        got = (rows["weight"] * rows["n_tokens"]).groupby(rows[margin]).sum()
        assert np.allclose(got / got.sum(), own / own.sum(), atol=0.02)


def test_sample_meets_reachable_margins(spark):
    """Expected kept tokens of each group: the target, or all of a group that has less, the rest shared by the others."""
    sizes = {("a", "en", "x"): 600, ("a", "es", "x"): 150, ("b", "en", "x"): 130, ("b", "es", "x"): 60, ("c", "en", "x"): 12, ("c", "es", "|"): 8, ("a", "en", "|"): 40}
    docs = spark.createDataFrame([(k, s, l, t * 40) for k, (s, l, t) in enumerate(c for c, n in sizes.items() for _ in range(n))], "doc_id long, source string, lang string, text string")
    rows = mixing.weigh(spark, docs, keep=True).toPandas()
    assert rows["probability"].between(0, 1).all()
    for margin, exponent in mixing.MARGINS.items():
        own = rows.groupby(margin)["n_tokens"].sum()
        target, mass = own**exponent / (own**exponent).sum(), own * 0.0
        for _ in own:
            whole = mass >= own
            mass = own.where(whole, target * (mixing.BUDGET * own.sum() - own[whole].sum()) / target[~whole].sum()).clip(upper=own)
        got = (rows["probability"] * rows["n_tokens"]).groupby(rows[margin]).sum()
        assert np.allclose(got / own.sum(), mass / own.sum(), atol=0.005)


def test_given_and_unreachable_targets(spark):
    """Given targets are met to the residual; contradictory ones end with what is left shown; a group without a target stays."""
    rows = [("a", "en", "p", 50), ("a", "es", "p", 10), ("b", "en", "p", 20), ("b", "es", "p", 20), ("", "es", "p", 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    table = lambda name, shares: spark.createDataFrame(list(shares.items()), f"{name} string, target double")
    targets = {"source": table("source", {"a": 0.3, "b": 0.7}), "lang": table("lang", {"en": 0.5, "es": 0.5}), "topic": table("topic", {"p": 1.0})}
    raked = mixing.rake(spark, cells, targets)
    assert mixing.residual(raked, targets) <= mixing.RESIDUAL
    assert {(r["margin"], r["name"]) for r in mixing.margins(raked, targets).collect()} == {("source", "a"), ("source", "b"), ("lang", "en"), ("lang", "es"), ("topic", "p")}
    only = cells.where("NOT (source = 'a' AND lang = 'es') AND NOT (source = 'b' AND lang = 'en')")
    apart = mixing.rake(spark, only, {"source": table("source", {"a": 0.3, "b": 0.7}), "lang": table("lang", {"en": 0.6, "es": 0.4})})
    assert mixing.residual(apart, {"source": table("source", {"a": 0.3, "b": 0.7})}) > 0.05
    one = mixing.rake(spark, cells, {"source": table("source", {"a": 0.3})}).collect()
    assert {r["raked"] for r in one if r["source"] == "b"} == {20.0}


def test_mixing_edge_rows(spark, edges):
    holes = edges.withColumn("source", F.when(F.col("doc_id") > 4, F.col("source"))).withColumn("lang", F.lit(None).cast("string"))
    rows = mixing.weigh(spark, holes).collect()
    assert len(rows) == edges.count()
    assert len({r["kept"] for r in rows if r["doc_id"] == 4}) == 1
    assert mixing.sample(spark, holes).columns == holes.columns
    assert mixing.weigh(spark, holes.limit(0)).count() == 0


def test_arrow_words_match_python():
    from quillspan.llm import textvec as tv

    texts = ["a b  c", "", "é ñ\tx\n", "one", " lead and trail "]
    for _, _, data, offsets in tv.chunks(pa.array(texts)):
        starts, ends, row = tv.words(data, offsets)
        found = [[] for _ in texts]
        for s, e, r in zip(starts, ends, row, strict=True):
            found[r].append(bytes(data[s:e]).decode())
        assert found == [t.split() for t in texts]
