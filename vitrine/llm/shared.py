"""The folder that driver and executors share, and small helpers on top of it.

Lineage is cut with tables written there, never with local checkpoints: a lost executor then
costs its running tasks only.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import shared_folder


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused URI below the shared folder."""
    return f"{shared_folder(spark)}/vitrine-{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; the reread frame and its URI."""
    spark, uri = df.sparkSession, scratch(df.sparkSession, label)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri), uri


def discard(spark: SparkSession, uri: str) -> None:
    """Delete a scratch URI that no frame reads any more."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI or path, None for other stores."""
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme == "file" else (uri if not parsed.scheme else None)


def open_output(uri: str):
    """A binary file object for writing; parent folders are made."""
    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb", buffering=1 << 20)
    store, path = _filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def open_input(uri: str):
    """A seekable binary file object for reading."""
    if (path := local_path(uri)) is not None:
        return open(path, "rb", buffering=1 << 16)
    store, path = _filesystem(uri)
    return store.open_input_file(path)


def remove_file(uri: str) -> None:
    if (path := local_path(uri)) is not None:
        os.remove(path)
    else:
        store, path = _filesystem(uri)
        store.delete_file(path)


def attempt_name(prefix: str) -> str:
    """A file name that no other task attempt uses: readers follow the names in committed manifests."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(rows: DataFrame, size: int, *keys: str, salt: str = "") -> DataFrame:
    """About ``size`` of the rows, whose keys must be distinct; all if there are no more: those whose keys'
    hash lies below a bound.

    The choice doesn't depend on partitions, and nothing is sorted or gathered.
    """
    n = rows.count()
    if n <= size:
        return rows
    bound = -(1 << 63) + int((1 << 64) * size / n)
    return rows.where(F.xxhash64(*keys, F.lit(salt)) < F.lit(bound))
