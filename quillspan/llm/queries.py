"""The query of each operator: its whole intended table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import ann, bpe, mixing, near_dup, pii, png, quality, repeats, toxicity, warc
from quillspan.sources.shared import materialise, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with its fold."""
    return toxicity.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, from WARC archives that were converted from legacy records and read back."""
    _, records = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an image in a binary column of a table: digests of what is read back from it, and the image's hash."""
    return png.media_values(materialise(spark, png.media_table(table(spark, sf_dir, "documents")), "media"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    return bpe.encode_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal-data spans of every document: the base kinds, and terms that disclose protected entities."""
    return pii.spans(spark, table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every vector whose id is divisible by 20."""
    return ann.nearest(spark, table(spark, sf_dir, "embeddings"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses if each byte of a 400-byte string that occurs elsewhere goes."""
    return repeats.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, calibrated inclusion probability and draw of every document."""
    rows = mixing.weigh(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, with its fold."""
    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: class of equal texts and near-duplicate group."""
    return near_dup.near_duplicates(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_media": op3_media,
    "op4_bpe": op4_bpe,
    "op5_pii": op5_pii,
    "op6_nearest": op6_nearest,
    "op7_repeats": op7_repeats,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_near_duplicates": op10_near_duplicates,
}

#: DuckDB SQL where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op8_mixing": mixing.oracle(),
    "op2_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op6_nearest": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(q.e, b.e) AS score
              FROM v q JOIN v b ON b.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20""",
}
