"""Token-id files: documents compressed one by one under a shared zstandard dictionary.

A set of shards lies in one folder. Shard k has a data file (the compressed id arrays, one frame for
each document) and an index file (document keys, frame offsets, token counts). Both begin with the
SHA-256 of the dictionary, so a reader refuses data of another dictionary; the index gives any short
document by one seek. Keys ascend within a shard and from shard to shard (null keys come first,
rows of equal keys lie side by side).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary, library_encoder, library_tokenizer, text_batches
from .shared import attempt_name, discard, materialise, open_input, open_output, scratch, shuffle_partitions

MAGIC = b"VTOK0001"
HEADER = struct.Struct("<8sB3x32sQ")  # magic, bytes of an id, dictionary hash, number of documents (index only)

#: Bounds of the dictionary's training, as ``train_format`` takes them: sampled texts, pieces taken of each
#: (evenly over its length), bytes of a piece, bytes of the dictionary.
SAMPLE_DOCS, PIECES, PIECE_BYTES, DICTIONARY_BYTES = 512, 32, 4_096, 65_536


@dataclass(frozen=True)
class IdFormat:
    """How ids are written: little-endian unsigned integers of ``width`` bytes, one zstandard frame a document."""

    width: int
    dictionary: bytes = b""
    level: int = 3

    @property
    def dtype(self) -> str:
        return f"<u{self.width}"

    @property
    def digest(self) -> bytes:
        return hashlib.sha256(self.dictionary).digest()

    def compressor(self):
        import zstandard

        known = {"dict_data": zstandard.ZstdCompressionDict(self.dictionary)} if self.dictionary else {}
        return zstandard.ZstdCompressor(level=self.level, write_content_size=True, write_dict_id=False, **known)

    def decompressor(self):
        import zstandard

        known = {"dict_data": zstandard.ZstdCompressionDict(self.dictionary)} if self.dictionary else {}
        return zstandard.ZstdDecompressor(**known)


def train_format(docs: DataFrame, vocabulary: str, end_id: int, sample: int = SAMPLE_DOCS, pieces: int = PIECES, piece_bytes: int = PIECE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> IdFormat:
    """A dictionary from at most ``pieces`` pieces of the ids of each of about ``sample`` texts, drawn by hash.

    Texts of any length take part; equal ones are drawn together and count once. Too few samples to train on give a format
    without dictionary.
    """
    import zstandard

    size = max(library_tokenizer(vocabulary).get_vocab_size(), end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    texts = docs.where(F.col("text") != "").select("text", F.xxhash64("text", F.lit("dictionary")).alias("_hash"))
    n = docs.count()
    if n > sample:
        texts = texts.where(F.col("_hash") < F.lit(-(1 << 63) + int((1 << 64) * sample / n)))
    chosen = texts.groupBy("_hash").agg(F.min("text").alias("text")).select("text")  # copies are dropped within tasks

    def cut(batches):
        encoder = library_encoder(vocabulary)
        for batch in text_batches(batches):
            rows = []
            for raw in encoder.encode_batch(batch.column(0).to_pylist()):
                raw = np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes()
                starts = range(0, len(raw), piece_bytes)
                step = -(-len(starts) // pieces)
                rows += [raw[k : k + piece_bytes] for k in starts[:: max(1, step)]]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["piece"])

    found = sorted(bytes(r.piece) for r in chosen.mapInArrow(cut, "piece binary").distinct().collect())
    try:
        dictionary = zstandard.train_dictionary(min(dictionary_bytes, max(512, sum(map(len, found)) // 10)), found).as_bytes()
    except (zstandard.ZstdError, ValueError):
        dictionary = b""
    return IdFormat(width, dictionary)


class ShardWriter:
    """Writes one shard; documents must come in the order of their keys."""

    def __init__(self, prefix: str, form: IdFormat):
        self.prefix, self.form, self.out = prefix, form, open_output(f"{prefix}.bin")
        self.out.write(HEADER.pack(MAGIC, form.width, form.digest, 0))
        self.at, self.keys, self.offsets, self.counts = HEADER.size, [], [HEADER.size], []

    def add(self, key: int | None, count: int, frame: bytes) -> None:
        self.out.write(frame)
        self.at += len(frame)
        self.keys.append(key)
        self.offsets.append(self.at)
        self.counts.append(count)

    def close(self) -> None:
        self.out.close()
        with open_output(f"{self.prefix}.idx") as out:
            out.write(HEADER.pack(MAGIC, self.form.width, self.form.digest, len(self.keys)))
            out.write(np.array([k is None for k in self.keys], "u1").tobytes())
            for values in ([k or 0 for k in self.keys], self.offsets, self.counts):
                out.write(np.array(values, "<i8").tobytes())


class ShardReader:
    """One shard's documents, all in order or single ones by their place."""

    def __init__(self, prefix: str, form: IdFormat):
        with open_input(f"{prefix}.idx") as file:
            raw = file.read()
        magic, width, digest, n = HEADER.unpack_from(raw)
        if magic != MAGIC or (width, digest) != (form.width, form.digest):
            raise ValueError(f"{prefix}.idx: not written with this dictionary and id width")
        at = HEADER.size
        nulls = np.frombuffer(raw, "u1", n, at)
        keys = np.frombuffer(raw, "<i8", n, at + n)
        self.keys = [None if x else int(k) for x, k in zip(nulls, keys, strict=True)]
        self.offsets = np.frombuffer(raw, "<i8", n + 1, at + 9 * n)
        self.counts = np.frombuffer(raw, "<i8", n, at + 9 * n + 8 * (n + 1))
        self.form, self.back, self.file = form, form.decompressor(), open_input(f"{prefix}.bin")
        magic, width, digest, _ = HEADER.unpack(self.file.read(HEADER.size))
        if magic != MAGIC or (width, digest) != (form.width, form.digest):
            raise ValueError(f"{prefix}.bin: not written with this dictionary and id width")

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, k: int) -> np.ndarray:
        """The k-th document's ids; one seek and one read."""
        begin, end = int(self.offsets[k]), int(self.offsets[k + 1])
        self.file.seek(begin)
        frame = self.file.read(end - begin)
        ids = np.frombuffer(self.back.decompress(frame) if frame else b"", self.form.dtype)
        if len(ids) != self.counts[k]:
            raise ValueError(f"document {k} has {len(ids)} ids; the index says {self.counts[k]}")
        return ids

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class TokenFileSet:
    """A written set: its format and, in key order, (shard prefix, documents, ids before it)."""

    form: IdFormat
    shards: list[tuple[str, int, int]]


def write_token_files(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = 1, partitions: int | None = None) -> TokenFileSet:
    """Encode (doc_id, text) rows, append ``end_id`` to each, and write shards in ascending doc_id order.

    Null texts count as empty and so hold the end id alone; texts of any length are encoded whole; repeated
    rows are all written, side by side; null keys come first; other columns, whatever their names, are
    ignored; an empty table gives a set without shards. Each shard
    is written by one task under a name of its own, and only names in the tasks' committed manifest
    are part of the set, so lost tasks leave nothing but unused files. The driver holds the
    dictionary and one manifest row for each shard.
    """
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    form = train_format(docs, path, end_id)
    folder = folder or scratch(spark, "tokens")
    end = np.array([end_id], "<u4").tobytes()

    def frames(batches):
        encoder, shrink = library_encoder(path), form.compressor().compress
        for batch in text_batches(batches):
            counts, blobs = [], []
            for raw in encoder.encode_batch(batch.column(1).to_pylist()):
                ids = np.frombuffer(raw + end, "<u4")
                counts.append(len(ids))
                blobs.append(shrink(ids.astype(form.dtype).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n_tokens", "frame"])

    # Written before it is dealt out: the sampling for the range bounds would encode all texts once more.
    encoded, encoded_uri = materialise(docs.mapInArrow(frames, "doc_id long, n_tokens long, frame binary"), "frames")

    def shards(batches):
        from pyspark import TaskContext

        writer, total = None, 0
        for batch in batches:
            for key, count, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    writer = ShardWriter(f"{folder}/{attempt_name('shard')}", form)
                writer.add(key, count, frame)
                total += count
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "prefix": writer.prefix, "docs": len(writer.keys), "ids": total}], schema=pa.schema([("shard", pa.int32()), ("prefix", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    # The hash beside the key lets rows of one key fill several shards.
    tie = F.xxhash64("frame")
    dealt = encoded.repartitionByRange(partitions or shuffle_partitions(spark), F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    manifest = dealt.mapInArrow(shards, "shard int, prefix string, docs long, ids long")
    manifest, manifest_uri = materialise(manifest, "token-manifest")
    before, listed = 0, []
    for row in manifest.orderBy("shard").collect():  # one row for each shard
        listed.append((row.prefix, row.docs, before))
        before += row.ids
    discard(spark, encoded_uri)
    discard(spark, manifest_uri)
    return TokenFileSet(form, listed)


def read_token_files(spark: SparkSession, files: TokenFileSet, keep_ids: bool = False) -> DataFrame:
    """Per document, read from the files: doc_id, start (ids before it), n_tokens, ids_crc32 and, on
    request, ids. A shard is one row of work."""
    form = files.form
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")

    def rows(prefix: str, start: int) -> Iterator[tuple]:
        reader = ShardReader(prefix, form)
        for k, key in enumerate(reader.keys):
            ids = reader.ids(k)
            yield (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int64)] if keep_ids else []))
            start += len(ids)
        reader.close()

    def read(batches):
        types = [pa.int64()] * 4 + ([pa.list_(pa.int64())] if keep_ids else [])
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(types)]
        for batch in batches:
            for prefix, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = []
                for row in rows(prefix, start):
                    part.append(row)
                    if len(part) == (256 if keep_ids else 20_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)
                        part = []
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)

    work = spark.createDataFrame([(k, p, s) for k, (p, _, s) in enumerate(files.shards)], "shard int, prefix string, start long")
    if files.shards:
        work = work.repartitionByRange(len(files.shards), "shard")
    return work.select("prefix", "start").mapInArrow(read, schema)
