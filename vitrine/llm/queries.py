"""One registered query for each operator of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, media, packing, quality, secrets, simhash, token_files, toxicity, warc
from .shared import read_table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(read_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(read_table(spark, sf_dir, "documents"), end_id=1)
    return token_files.read_token_files(spark, files)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents"))


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(read_table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), end_id=1)


def op7_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.roundtrip(read_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as the first batch of a new index, which is dropped once it has been written."""
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}")
    try:
        return index.ingest(read_table(spark, sf_dir, "documents"))
    finally:
        index.drop()


def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


#: WARC roles and digests in SQL; a base32 digit is five bits of up to three hexadecimal ones.
OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) || '00' AS h FROM pages),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((
           (strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 256 + (strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1) * 16
           + strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 3 AS BIGINT), 1)) - 1) >> (7 - 5 * i % 4)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM m
"""

#: Exact deduplication in SQL; the other operators' answers are not expressible there.
OP9_SQL = r"""
WITH rows AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_salvage": OP5_SQL, "op9_exact_dedup": OP9_SQL}
