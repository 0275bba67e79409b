"""Rows named by their place in a file table, so that decisions on rows travel and texts stay.

A row's place is a hash of its file's name and its number in the file. An operator decides on narrow
rows that carry places; the decisions are sorted by place and written as shards to the shared folder;
the next pass over the wide table looks them up there, batch by batch. The wide table is never
shuffled, and its columns are read where they lie. Splits may differ between the passes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attempt_name, materialise, open_input, open_output, scratch

#: Shards that a reader holds at once; consecutive rows need one or two.
HELD = 2
_PLAIN = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def _plain(plan) -> bool:
    """Whether a plan gives each row of its files at most once, with its place known."""
    children = plan.children()
    return plan.getClass().getSimpleName() in _PLAIN and children.size() <= 1 and all(_plain(children.apply(k)) for k in range(children.size()))


def _places_known(rows: DataFrame) -> bool:
    """Whether rows come straight from files whose names have hashes of their own."""
    from xxhash import xxh64_intdigest

    plan = rows._jdf.queryExecution().analyzed()
    if not _plain(plan):
        return False
    try:
        rows.select(rows.metadataColumn("_metadata")["row_index"])
    except AnalysisException:  # a file format without row numbers
        return False
    files = rows.inputFiles()
    return bool(files) and len({xxh64_intdigest(f.encode(), 42) for f in files}) == len(set(files))


@dataclass(frozen=True)
class Placed:
    """``rows`` with the columns ``file`` and ``row``, whose names no other column has; ``columns`` are the others."""

    rows: DataFrame
    file: str
    row: str
    columns: tuple[str, ...]


def placed(rows: DataFrame) -> Placed:
    """``rows`` with their places. Rows that don't come straight from files are written to the shared folder first."""
    columns = tuple(rows.columns)
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    file, row = f"{prefix}file", f"{prefix}row"
    if not _places_known(rows):
        # Written under plain names: the columns' own may not be fit for a file, or clash.
        names = [f"c{k}" for k in range(len(columns))]
        written, _ = materialise(rows.toDF(*names), "placed")
        rows = written
    else:
        names = [f"`{c}`" for c in columns]
    meta = rows.metadataColumn("_metadata")
    own = [F.col(n).alias(c) for n, c in zip(names, columns, strict=True)]
    return Placed(rows.select(*own, F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(row)), file, row, columns)


# -- shards of decisions ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Shard:
    """Where a shard lies, and its first and last place."""

    path: str
    first: tuple[int, int]
    last: tuple[int, int]


_MANIFEST = "path string, file0 long, row0 long, file1 long, row1 long"


def write_shards(places: DataFrame, label: str) -> list[Shard]:
    """Shards of rows (file, row, value), in the order of places; the manifest has one entry for each partition.

    Places must be distinct and not null. The rows are dealt out by ranges, so a file that holds most
    rows fills many shards.
    """
    folder = scratch(places.sparkSession, label)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for k in range(3):
                columns[k].append(batch.column(k).to_numpy(zero_copy_only=False))
        if not sum(map(len, columns[0])):
            return
        files, rows, values = (np.concatenate(c).astype("<i8") for c in columns)
        path = f"{folder}/{attempt_name('places')}"
        with open_output(path) as out:
            out.write(len(files).to_bytes(8, "little"))
            for part in (files, rows, values):
                out.write(part.tobytes())
        ends = [(int(files[k]), int(rows[k])) for k in (0, -1)]
        yield pa.RecordBatch.from_pylist([{"path": path, "file0": ends[0][0], "row0": ends[0][1], "file1": ends[1][0], "row1": ends[1][1]}])

    source = places.select(*(F.col(c).cast("long").alias(c) for c in ("file", "row", "value")))
    dealt = source.repartitionByRange("file", "row").sortWithinPartitions("file", "row")
    manifest = dealt.mapInArrow(write, _MANIFEST).collect()  # of each partition what one attempt gave, whichever ended
    return sorted((Shard(r.path, (r.file0, r.row0), (r.file1, r.row1)) for r in manifest), key=lambda s: s.first)


class ShardReader:
    """Looks places up in shards; holds at most HELD of them."""

    def __init__(self, shards: list[Shard]):
        self.shards = shards
        self.firsts, self.lasts = [s.first for s in shards], [s.last for s in shards]
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def load(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k not in self.held:
            if len(self.held) >= HELD:
                del self.held[next(iter(self.held))]
            with open_input(self.shards[k].path) as file:
                raw = file.read()
            n = int.from_bytes(raw[:8], "little")
            if len(raw) != 8 + 24 * n:
                raise ValueError(f"{self.shards[k].path} is not whole")
            whole = np.frombuffer(raw, "<i8", offset=8).reshape(3, n)
            self.held[k] = whole[0], whole[1], whole[2]
        return self.held[k]

    def find(self, files: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places the shards hold, and their values (0 where they don't)."""
        hit, value = np.zeros(len(files), bool), np.zeros(len(files), np.int64)
        for name in np.unique(files).tolist():
            at = np.flatnonzero(files == name)
            wanted = rows[at]
            low, high = (name, int(wanted.min())), (name, int(wanted.max()))
            for k in range(bisect_left(self.lasts, low), bisect_right(self.firsts, high)):
                in_files, in_rows, in_values = self.load(k)
                a, b = np.searchsorted(in_files, name, "left"), np.searchsorted(in_files, name, "right")
                part, worth = in_rows[a:b], in_values[a:b]
                if not len(part):
                    continue
                place = np.minimum(np.searchsorted(part, wanted), len(part) - 1)
                same = part[place] == wanted
                hit[at[same]] = True
                value[at[same]] = worth[place[same]]
        return hit, value


def keep(docs: Placed, places: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose places (file, row) are in ``places``, with their own columns.

    No row moves, and only places pass through Python workers: the other columns wait in the JVM.
    """
    shards = write_shards(places.select("file", "row", F.lit(0).alias("value")), "kept")

    def held(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        reader = ShardReader(shards)
        for files, rows in parts:
            yield pd.Series(reader.find(files.to_numpy(), rows.to_numpy())[0])

    found = F.pandas_udf(held, "boolean")
    return docs.rows.where(found(F.col(f"`{docs.file}`"), F.col(f"`{docs.row}`"))).select(*(f"`{c}`" for c in docs.columns))
