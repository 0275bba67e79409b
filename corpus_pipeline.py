"""The corpus pipeline: documents of good quality, without copies and secrets, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again
as the next stage's documents. All but the last return the columns of documents. In every stage null
texts count as empty, texts of any length are read whole, rows that repeat are each judged (copies go in
the second stage), further columns pass whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import exact_dedup, packing, quality, secrets, simhash
from vitrine.llm.shared import discard, materialise, read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the accepting quantile. Empty texts are scored by their all-zero features;
    ties at the quantile stay; without labels of both classes all documents do."""
    return quality.accept(docs, read_table(spark, sf_dir, "labels"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text: the one of most characters, of equal ones that of smallest doc_id (null
    last), then the first in its file. The digest index is new and is dropped afterwards."""
    index = exact_dedup.DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex[:12]}")
    try:
        return exact_dedup.deduplicate(docs, index)
    finally:
        index.drop()


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of smallest doc_id (null last), then of smallest
    fingerprint, then the first in its file. Texts without words are one group."""
    return simhash.deduplicate(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each secret and n_chars brought up to date. Null texts stay null."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences. An empty text is its end id alone; a null doc_id
    stays null; columns other than doc_id and text end here."""
    return packing.pack(docs, cache=packing.SMALL_CACHE)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("simhash near-dedup", near_deduplication),
    ("secret scans", secret_redaction),
    ("best-fit packing", best_fit_packing),
]

#: The stages' models and vocabularies can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. A stage's table goes when the next one's is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, written = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(spark, before)
        before = written
    return docs
