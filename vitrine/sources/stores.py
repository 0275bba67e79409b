"""File sources: target sheets, JSON stores, text-line state."""

from __future__ import annotations

import io
import re
import tempfile
import time
import uuid
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank
from ..operators.state import ENTRY

COLUMNS = ["ignored", "title", "search_query", *(f"name{k}" for k in range(1, 6))]
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local
    master gets a temporary folder, and a cluster an error, as its machines share none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vitrine-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part that holds the workbook's first sheet, by the workbook's own order."""
    parts = set(book.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= parts:
        sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
        places = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(_RELATION)}
        target = places.get(sheet.get(_ID), "") if sheet is not None else ""
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if name in parts:
            return name
    numbered = [(int(m[1]), x) for x in parts if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", x))]
    return min(numbered)[1]


def _column(reference: str) -> int:
    at = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        at = 26 * at + ord(letter) - 64
    return at


def sheet_rows(raw: bytes) -> list[tuple[int, list[str | None]]]:
    """(row number, cells as texts, empty ones None) of a workbook's first sheet; numbers are the sheet's own."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(x.text or "" for x in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        rows: list[tuple[int, list[str | None]]] = []
        for row in ElementTree.fromstring(book.read(_first_sheet(book))).iter(f"{_MAIN}row"):
            cells: dict[int, str | None] = {}
            at = 0
            for cell in row.findall(f"{_MAIN}c"):
                at = _column(cell.get("r", "")) or at + 1  # a cell without a reference follows the one before
                value = cell.find(f"{_MAIN}v")
                if cell.get("t") == "inlineStr":
                    cells[at] = "".join(x.text or "" for x in cell.iter(f"{_MAIN}t"))
                elif value is not None:
                    cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            number = int(row.get("r") or (rows[-1][0] + 1 if rows else 1))
            rows.append((number, [cells.get(k) for k in range(1, max(cells, default=0) + 1)]))
        return rows


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(row_num, cells): rows of workbooks at ``path`` under their first row's names; a workbook is read by one task."""
    files = spark.read.format("binaryFile").load(path)

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for raw in batch["content"]:
                rows = sheet_rows(raw)
                header = [x or f"_{k}" for k, x in enumerate(rows[0][1])] if rows else []
                body = [(number, {k: v for k, v in zip(header, cells, strict=False) if v is not None}) for number, cells in rows[1:]]
                yield pd.DataFrame({"row_num": [x for x, _ in body], "cells": [x for _, x in body]})

    return files.select("content").mapInPandas(parse, "row_num long, cells map<string,string>")


def targets(sheet: DataFrame) -> DataFrame:
    """Target rows of a sheet with COLUMNS: those whose third name isn't blank."""
    return sheet.where(~is_blank(F.col("name3"))).select("title", "search_query", F.array(*(f"name{k}" for k in range(1, 6))).alias("names"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The match store at ``path``: JSON array files as one run writes them, or the table of ``append_entries``.

    A missing, broken or non-array file is empty; an entry without some field has null there.
    """
    path = current(spark, path)
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([], ENTRY)
    if _exists(spark, f"{path}/_SUCCESS"):
        return spark.read.schema(ENTRY).json(path)
    raw = spark.read.text(path, wholetext=True)
    # A lone object would be read as an array of one, so the first character is asked for.
    whole = raw.where(F.ltrim(F.regexp_replace("value", r"^\x{FEFF}?[\s]+", "")).startswith("["))
    parsed = whole.select(F.from_json("value", T.ArrayType(ENTRY)).alias("e"), F.try_parse_json("value").isNotNull().alias("valid"))
    return parsed.where("valid").select(F.inline("e"))


def read_scraped_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct urls of all JSON records below a folder; broken files are passed over.

    A file holds one record, or a record a line if a Spark write has made it (part-*.json).
    """
    if not _exists(spark, folder):
        return spark.createDataFrame([], "url string")
    reader = lambda glob, whole: spark.read.schema("url string").option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", whole).json(folder)
    single = reader("*.json", True).where(~F.col("_metadata.file_name").startswith("part-"))
    return single.select("url").union(reader("part-*.json", False).select("url")).where(F.col("url") != "").distinct()


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Row ids of finished rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "row_id string")
    return spark.read.text(path).select(F.trim("value").alias("row_id")).where("row_id <> ''").distinct()


def read_images(spark: SparkSession, folder: str, plan: DataFrame) -> DataFrame:
    """(image_id, url, raw): the bytes of planned images (image_id, url) that were fetched to files named by their
    ids, whatever the suffix; null for those that weren't, or are empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where("length > 0")
    named = files.select(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("image_id"), F.col("content").alias("raw"))
    return plan.select("image_id", "url").distinct().join(named, "image_id", "left")


def append_entries(entries: DataFrame, path: str) -> None:
    """Add match entries to the store at ``path``, without a look at those that are there: equal ones may repeat.

    Fields that ``entries`` lacks are null, is_scraped false. The write is committed as a whole.
    """
    own = set(entries.columns)
    missing = {"is_scraped": F.lit(False)}
    rows = entries.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in own else missing.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY.fields))
    rows.write.mode("append").json(path)


def append_state(rows: DataFrame, path: str) -> None:
    """Add the row ids of finished rows (column row_id) to the progress at ``path``, a line each."""
    rows.select(F.regexp_replace("row_id", r"[\r\n]+", " ").alias("value")).write.mode("append").text(path)


_POINTER = "_current"


def current(spark: SparkSession, path: str) -> str | None:
    """The version that a table replaced by ``replace_table`` has now; ``path`` itself if it never was replaced."""
    if not _exists(spark, f"{path}/{_POINTER}"):
        return path
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_POINTER}")
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        name = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()
    return f"{path}/{name}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``replace_table`` wrote."""
    return spark.read.json(current(spark, path))


def replace_table(df: DataFrame, path: str, keep: int = 2) -> None:
    """Write a new version beside the old ones and then point to it.

    The pointer is one small file, written whole: a reader finds the old or the new version, on file
    systems and object stores alike. The last ``keep`` versions stay for readers that have begun.
    """
    spark = df.sparkSession
    name = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").json(f"{path}/{name}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(hadoop.Path(f"{path}/{_POINTER}"), True)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    versions = sorted(x.getPath().getName() for x in store.listStatus(hadoop.Path(path)) if x.getPath().getName().startswith("v"))
    for old in versions[:-keep]:
        store.delete(hadoop.Path(f"{path}/{old}"), True)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
