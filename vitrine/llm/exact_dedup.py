"""Exact deduplication against a persistent digest index.

The index is a table in the warehouse, bucketed and sorted by digest, with one row for each distinct
normalised text seen so far. A batch of documents is reduced to one winner for each digest (partial
aggregates first, so a digest that a third of the rows share costs one row a task), the winners are
anti-joined with the index by sort and merge, and those not found are appended under the batch's name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import keep, placed
from .shared import discard, materialise

#: Fixed value: the characters that normalisation deletes.
BLANK = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANK, "")


def digests(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, digest, n_points): SHA-256 of the normalised text, code points of the original one; and ``more``."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
        F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_points"),
        *more,
    )


def winners(rows: DataFrame) -> DataFrame:
    """One row for each digest: the row of most code points, then of smallest doc_id (nulls last), and how
    many there are. Of rows alike in both, the first place stays where ``rows`` has places (file, row)."""
    place = [c for c in ("file", "row") if c in rows.columns]
    best = F.max(F.struct(F.col("n_points"), F.col("doc_id").isNotNull().alias("known"), *(F.bitwise_not(c).alias(c) for c in ("doc_id", *place))))
    counted = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    return counted.select("digest", F.bitwise_not("best.doc_id").alias("keep_id"), F.col("best.n_points").alias("n_points"), "group_size", *(F.bitwise_not(f"best.{c}").alias(c) for c in place))


#: Digests that a bucket of a new index holds at most, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 4_000_000, 8


def buckets_for(n: int) -> int:
    """A power of two, so that buckets of an index that grows can be split evenly by ``rebuild``."""
    buckets = LEAST_BUCKETS
    while n > buckets * BUCKET_ROWS:
        buckets *= 2
    return buckets


@dataclass
class DigestIndex:
    """The persistent index ``table``: (digest, keep_id, n_points, batch), one row for each distinct text.

    The table is made by the first ``ingest``, with ``buckets`` or as many as suit that batch; ``rebuild``
    deals a grown index out anew. Across sessions it is found where the session's catalog lasts.
    """

    spark: SparkSession
    table: str
    buckets: int | None = None

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def create(self, rows: int = 0) -> None:
        """Make the table for a first batch of ``rows`` distinct texts, or finish a ``rebuild`` that was cut short."""
        if not self.exists() and self.spark.catalog.tableExists(self._new):
            self.spark.sql(f"ALTER TABLE {self._new} RENAME TO {self.table}")
        if not self.exists():
            self._write(self.spark.createDataFrame([], "digest binary, keep_id long, n_points long, batch string"), self.table, self.buckets or buckets_for(rows))

    @property
    def _new(self) -> str:
        return f"{self.table}_rebuilt"

    def _write(self, rows: DataFrame, table: str, buckets: int) -> None:
        # Rows are dealt out as the table is bucketed, so that a write adds one sorted file to a bucket.
        rows.repartition(buckets, "digest").write.mode("append").format("parquet").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(table)

    def _bucket_count(self) -> int:
        detail = {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").collect()}
        return int(detail["Num Buckets"])

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def rebuild(self, buckets: int | None = None) -> None:
        """Deal the index out to ``buckets``, or as many as its size asks for. No ingest may run meanwhile.

        The new table is whole before the old one goes; if the job ends between the two, the next
        ``create`` or ``ingest`` takes the new one.
        """
        self.create()
        self.spark.sql(f"DROP TABLE IF EXISTS {self._new}")
        self._write(self.read(), self._new, buckets or buckets_for(self.read().count()))
        self.spark.sql(f"DROP TABLE {self.table}")
        self.create()

    def drop(self) -> None:
        for table in (self.table, self._new):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def _resolve(self, rows: DataFrame, batch: str) -> tuple[DataFrame, str]:
        """Decide on the texts of ``rows`` and append the new ones; the table (digest, keep_id, group_size, fresh, ...) and its URI."""
        best, best_uri = materialise(winners(rows), "winners")
        self.create(best.count())
        # A batch that comes again, after a failure or by mistake, is measured against the other batches alone.
        others = self.read().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("index_id"))
        fresh = best.join(others.hint("merge"), "digest", "left_anti").withColumn("fresh", F.lit(True))
        known = best.join(others.hint("merge"), "digest", "inner").withColumn("keep_id", F.col("index_id")).drop("index_id").withColumn("fresh", F.lit(False))
        # A table of its own: both sides of a later join are then shuffled for it, and a digest with a
        # large share of the rows is split by adaptive execution.
        resolved, resolved_uri = materialise(fresh.unionByName(known), "resolved")
        own = self.read().where(F.col("batch") == batch).select("digest")
        added = resolved.where("fresh").select("digest", "keep_id", "n_points", F.lit(batch).alias("batch"))
        self._write(added.join(own.hint("merge"), "digest", "left_anti"), self.table, self._bucket_count())
        discard(self.spark, best_uri)
        return resolved, resolved_uri

    def ingest(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Append the batch's new digests and return a decision for each of its rows.

        Columns: doc_id, keep_id (the document that stays for this text: an earlier batch's if it had
        the text), group_size (rows of this batch with the text), kept, text_sha256. Null texts count
        as empty, and all empty texts are one group; texts of any length are digested whole. Rows that
        repeat a doc_id and text share one decision; ties of length go to the smallest doc_id. A null
        doc_id stays only where no other row has the text, and then has a null keep_id and kept true.
        Other columns, whatever their names, are ignored; an empty table gives an empty result.

        ``batch`` names the content: ingesting the same rows again under the same name gives the same
        decisions and adds nothing, also after a failure half-way. Without a name the batch is new.
        """
        rows, _ = materialise(digests(docs), "digests")
        resolved, _ = self._resolve(rows, batch or uuid.uuid4().hex)
        return rows.join(resolved.select("digest", "keep_id", "group_size", "fresh").hint("merge"), "digest").select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("fresh")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def stay(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """The documents that stay after they are ingested as ``batch``: all columns, one row for each new text.

        Only digests and places are shuffled; texts are read again where they lie. Of rows that repeat a
        doc_id and text the first in its file stays. Nulls, empty and long texts, ties and batches are
        as in ``ingest``; other columns pass unchanged, whatever their names.
        """
        found = placed(docs)
        rows, rows_uri = materialise(digests(found.rows, F.col(f"`{found.file}`").alias("file"), F.col(f"`{found.row}`").alias("row")), "digests")
        resolved, resolved_uri = self._resolve(rows, batch or uuid.uuid4().hex)
        kept = keep(found, resolved.where("fresh").select("file", "row"))
        discard(self.spark, rows_uri)
        discard(self.spark, resolved_uri)
        return kept


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The documents that stay after ``index`` has taken them in, as ``DigestIndex.stay`` says."""
    return index.stay(docs, batch)
