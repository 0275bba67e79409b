"""Stores that a run resumes from: entries, progress, scraped urls, and records by outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("excel_product_name", "search_query", "website_product_name", "product_url")]
    + [T.StructField("avg_similarity_score", T.DoubleType()), T.StructField("max_similarity_score", T.DoubleType()), T.StructField("is_scraped", T.BooleanType()), T.StructField("scrap_directory", T.StringType())]
)


def row_id(title: Column, query: Column) -> Column:
    """A target's identity: title::query on one line; what is missing reads None."""
    return F.trim(F.replace(F.concat(F.coalesce(title, F.lit("None")), F.lit("::"), F.coalesce(query, F.lit("None"))), F.lit("\n"), F.lit(" ")))


def pending(entries: DataFrame) -> DataFrame:
    """Entries with a url that aren't marked as scraped."""
    return entries.where(~F.coalesce("is_scraped", F.lit(False)) & (F.col("product_url") != ""))


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those done."""
    return rows.join(done.select(key), key, "left_anti")


def seen(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_semi")


def processed(*cells: Column) -> Column:
    """Whether all output cells are filled."""
    return F.forall(F.array(*cells), lambda x: x.isNotNull() & ~F.lower(F.trim(x)).isin("", "nan"))


def first_match_update(entries: DataFrame, updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Entries with is_scraped and scrap_directory set on the first entry (by ``order``, which tells entries apart) of each updated key only.

    ``updates`` has (key, scrap_directory); of several for a key the smallest directory counts, and blank
    keys update nothing. The first entries are found by an aggregate over updated keys alone, so a key
    that most entries share, blank ones above all, is no task's own.
    """
    new = updates.where(F.trim(key) != "").groupBy(key).agg(F.min("scrap_directory").alias("_dir"))
    place = F.struct(*order)
    firsts = entries.where(F.trim(key) != "").groupBy(key).agg(F.min(place).alias("_place")).join(new, key).select("_place", "_dir", F.lit(True).alias("_hit"))
    joined = entries.join(firsts, place.eqNullSafe(F.col("_place")), "left")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.withColumn("is_scraped", F.when(hit, F.lit(True)).otherwise(F.col("is_scraped"))).withColumn("scrap_directory", F.when(hit, F.col("_dir")).otherwise(F.col("scrap_directory"))).drop("_place", "_dir", "_hit")


def titled(rows: DataFrame, title: str = "title") -> DataFrame:
    """Rows whose source title isn't blank; here the text nan counts as a title."""
    return rows.where(F.trim(F.coalesce(title, F.lit(""))) != "")


def unmatched_updates(entries: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates whose key no entry has."""
    return updates.join(entries.select(key), key, "left_anti")


def write_back(sheet: DataFrame, results: DataFrame, key: str, cells: list[str]) -> DataFrame:
    """``sheet`` with the result's cells where there is a result, else its own."""
    new = results.select(key, *(F.col(c).alias(f"_{c}") for c in cells))
    joined = sheet.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in cells else F.col(c) for c in sheet.columns))


def fill_header(sheet: DataFrame, cells: list[str]) -> DataFrame:
    """``sheet`` with the missing ones of the output columns, empty."""
    for cell in cells:
        if cell not in sheet.columns:
            sheet = sheet.withColumn(cell, F.lit(None).cast("string"))
    return sheet


def is_failed(error: Column, name: Column) -> Column:
    return (F.coalesce(F.trim(error), F.lit("")) != "") | (F.coalesce(F.trim(name), F.lit("")) == "")


def run_counts(records: DataFrame) -> DataFrame:
    """attempted, succeeded and failed records."""
    return records.agg(F.count("*").alias("attempted"), F.count_if(~F.col("is_failed")).alias("succeeded"), F.count_if(F.col("is_failed")).alias("failed"))


def save_by_outcome(records: DataFrame, path: str) -> None:
    """JSON records in folders is_failed=true and is_failed=false."""
    records.write.mode("append").partitionBy("is_failed").json(path)


def ordered_distinct(urls: Column) -> Column:
    """Non-empty urls, each once, in their order."""
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != "")))


def stable_id(c: Column) -> Column:
    """A name for a record that is the same in every run."""
    return F.sha2(c, 256)
