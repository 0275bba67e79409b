"""Matching as a stream: each micro-batch of listings is scored, and best matches go to a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def match_stream(listings: DataFrame, match: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``match`` on each micro-batch and append its rows to the Parquet store ``sink``.

    Rows carry the query's id and the batch's number, and a repeated batch replaces its own, so a restart
    adds nothing twice. A query with a new checkpoint has a new id: it adds to the store and overwrites
    nothing of an earlier one's.
    """
    started: list[StreamingQuery] = []

    def write(batch: DataFrame, number: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or str(started[0].id)
        match(batch).write.mode("overwrite").parquet(f"{sink}/query={run}/batch={number}")

    writer = listings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    started.append((writer.trigger(availableNow=True) if once else writer).start())
    return started[0]


def read_matches(spark: SparkSession, sink: str) -> DataFrame:
    """All rows of the store, with query and batch."""
    return spark.read.parquet(sink)


def new_urls(matches: DataFrame, key: str = "product_url") -> DataFrame:
    """A stream of matches in which each url comes once, however often it is matched; its state is the urls seen."""
    return matches.where(F.coalesce(key, F.lit("")) != "").dropDuplicates([key])
