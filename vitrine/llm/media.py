"""Media columns kept as content-defined chunks.

A payload is stored as 8-bit mono PCM in a WAV container. Its bytes are cut where a rolling gear hash
of the last bytes has given zero bits, so equal passages give equal chunks wherever they stand. Each
distinct chunk is stored once; a medium is the ordered list of its chunks' digests.

Storing takes three steps: tasks cut their media and write the chunks they have not written yet to
packs of their own (unchanged copies within a task cost nothing); one place is chosen for each digest
by an aggregate over all packs; and packs are rewritten with the chosen chunks alone. They are
rewritten in waves, and a wave's old packs are deleted when its new ones are committed, so the store
is never there twice. Chunk bytes are never shuffled, only digests and places are.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_batches
from .shared import attempt_name, discard, materialise, open_input, open_output, scratch

#: The gear hash has as many bits as bytes in its window; a cut needs MASK_BITS zero bits at its top.
WINDOW, MASK_BITS, LEAST, MOST = 32, 12, 1024, 32768
UNIT, PAD = 192, b"\x20"
RATE = 8000
#: Parts in which packs are rewritten.
WAVES = 4
#: Bytes that one request to a pack asks for at least, packs that a reader has open, and media (as a power of two)
#: that are rebuilt in one go.
AHEAD, OPEN_PACKS, RUN_BITS = 1 << 18, 32, 8
#: Digests of written chunks that a task remembers; beyond it, copies are left to the later steps.
REMEMBERED = 500_000


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """A fixed pseudo-random 32-bit number for each byte."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear%d" % b).digest()[:4], "little") for b in range(256)], np.uint32)


def gear_hashes(data: bytes) -> np.ndarray:
    """h[i] = sum of gear[data[i - j]] << j over the last WINDOW bytes, modulo 2**32.

    Sums over 2, 4, 8, ... bytes are made by doubling, so the work is a few array operations.
    """
    h = gear()[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW and span < len(h):
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def cuts(data: bytes, step: int = 1 << 18) -> list[int]:
    """Ends of the chunks: the first place at least LEAST bytes on whose hash has MASK_BITS zero bits at its top, MOST bytes on at the latest."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    limit = np.uint32(1 << 32 - MASK_BITS)
    marks = []
    for k in range(0, n, step):
        lead = min(k, WINDOW)
        marks.append(np.flatnonzero(gear_hashes(data[k - lead : k + step])[lead:] < limit) + k + 1)
    places = np.concatenate(marks)
    ends, at = [], 0
    while n - at > LEAST:
        k = int(np.searchsorted(places, at + LEAST))
        end = int(places[k]) if k < len(places) else n
        at = min(end, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def wave_header(n: int) -> bytes:
    """The 44 bytes before n 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def wave_samples(media: bytes) -> bytes:
    """The samples of a file that wave_header() begins."""
    tag, _, kind, _, _, code, channels, _, _, _, bits, _, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (tag, kind, code, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or len(media) != 44 + n:
        raise ValueError("not an 8-bit mono PCM file of the stated length")
    return media[44:]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 of the text (null: empty), its length, padded with blanks to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + PAD * ((-len(raw)) % UNIT if raw else UNIT)


def features(samples: bytes) -> str:
    """Loudness of the samples around their middle, crossings of it, and spectral flatness of their byte counts."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    centred = counts * (np.arange(256) - 128.0)
    mean = float(centred.sum()) / len(x)
    rms = math.sqrt(float((counts * (np.arange(256) - 128.0) ** 2).sum()) / len(x))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    share = counts[counts > 0] / len(x)
    entropy = float(-(share * np.log2(share)).sum())
    return f"mean={mean:.4f};rms={rms:.4f};crossings={crossings};entropy={entropy:.4f}"


CHUNK_SCHEMA = "medium long, place int, digest binary, doc_id long, n_bytes long, media_sha256 string, pack string, at long, packed int"
_CHUNK_TYPES = [("medium", pa.int64()), ("place", pa.int32()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_sha256", pa.string()), ("pack", pa.string()), ("at", pa.int64()), ("packed", pa.int32())]
_CHUNK_PA = pa.schema(_CHUNK_TYPES)


def _cut_media(folder: str):
    """Cut media and write each chunk that this task has not written yet to its pack; a row for each chunk.

    The rows of a copy within the task have no place.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        shrink = zstandard.ZstdCompressor(level=3).compress
        medium, seen, out, pack, at = TaskContext.get().partitionId() << 40, set(), None, None, 0
        for batch in text_batches(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n_bytes, payload = payload_of(text)
                media = wave_header(len(payload)) + payload
                whole, begin = hashlib.sha256(media).hexdigest(), 0
                for place, end in enumerate(cuts(media)):
                    chunk = media[begin:end]
                    begin = end
                    digest = hashlib.sha256(chunk).digest()[:20]
                    if digest in seen:
                        rows.append((medium, place, digest, doc_id, n_bytes, whole, None, None, None))
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(digest)
                    if out is None:
                        pack = f"{folder}/{attempt_name('pack')}"
                        out = open_output(pack)
                    small = shrink(chunk)
                    out.write(small)
                    rows.append((medium, place, digest, doc_id, n_bytes, whole, pack, at, len(small)))
                    at += len(small)
                medium += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _CHUNK_TYPES, strict=True)], schema=_CHUNK_PA)
        if out is not None:
            out.close()

    return run


class RangeReader:
    """Reads ranges of packs. What lies behind a range is read with it, so ranges in the order of a pack cost
    one request for AHEAD bytes instead of one each; the last buffers of some packs are kept."""

    def __init__(self, ahead: int = AHEAD, packs: int = OPEN_PACKS):
        self.ahead, self.packs = ahead, packs
        self.files: dict[str, object] = {}
        self.buffers: dict[str, tuple[int, bytes]] = {}
        self.requests = 0

    def read(self, pack: str, at: int, size: int) -> bytes:
        begin, data = self.buffers.get(pack, (0, b""))
        if not begin <= at <= at + size <= begin + len(data):
            file = self.files.pop(pack, None)
            if file is None:
                if len(self.files) >= self.packs:
                    self._drop(next(iter(self.files)))
                file = open_input(pack)
            self.files[pack] = file  # the last of the dictionary is the one used last
            file.seek(at)
            data = file.read(max(size, self.ahead))
            self.requests += 1
            if len(data) < size:
                raise ValueError(f"{pack} is damaged: it ends before {at + size}")
            begin, self.buffers[pack] = at, (at, data)
        return data[at - begin : at - begin + size]

    def _drop(self, pack: str) -> None:
        self.files.pop(pack).close()
        self.buffers.pop(pack, None)

    def close(self) -> None:
        for pack in list(self.files):
            self._drop(pack)


def _rewrite_packs(folder: str):
    """Copy the chosen chunks, sorted by (pack, at), to a new pack and give their new places."""
    names = ["digest", "pack", "at", "packed"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out, target, at = RangeReader(packs=2), None, None, 0
        for batch in batches:
            packs, ats, sizes = (batch.column(k).to_pylist() for k in (1, 2, 3))
            if out is None and packs:
                target = f"{folder}/{attempt_name('chunks')}"
                out = open_output(target)
            places = []
            for pack, begin, size in zip(packs, ats, sizes, strict=True):
                out.write(reader.read(pack, begin, size))
                places.append(at)
                at += size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([target] * len(packs), pa.string()), pa.array(places, pa.int64()), batch.column(3)], names=names)
        reader.close()
        if out is not None:
            out.close()

    return run


INDEX_SCHEMA = "digest binary, pack string, at long, packed int"


def store(media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store (doc_id, text) rows; the recipe rows (medium, place, digest, ...) and the index (digest, pack, at, packed).

    The index has each digest of the corpus once, and packs hold each of these chunks once.
    """
    spark = media.sparkSession
    folder = scratch(spark, "media")
    source = media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    recipe, _ = materialise(source.mapInArrow(_cut_media(f"{folder}/first"), CHUNK_SCHEMA), "recipe")
    # Deduplication over all packs: the first place of each digest, by partial and then whole aggregates.
    first = recipe.where("pack is not null").groupBy("digest").agg(F.min(F.struct("pack", "at", "packed")).alias("x")).select("digest", "x.pack", "x.at", "x.packed")
    chosen, chosen_uri = materialise(first, "chosen")
    index_uri = scratch(spark, "chunk-index")
    for wave in range(WAVES):
        part = chosen.where(F.pmod(F.xxhash64("pack"), F.lit(WAVES)) == wave)
        moved = part.repartitionByRange("pack", "at").sortWithinPartitions("pack", "at").mapInArrow(_rewrite_packs(f"{folder}/packs"), INDEX_SCHEMA)
        moved.write.mode("append").parquet(index_uri)
        for row in part.select("pack").distinct().collect():  # one for each task of the first step at most
            discard(spark, row.pack)
    discard(spark, f"{folder}/first")
    discard(spark, chosen_uri)
    index = spark.read.schema(INDEX_SCHEMA).parquet(index_uri)
    return recipe.drop("pack", "at", "packed"), index


RESULT_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Media from their chunk lists (doc_id, n_bytes, media_sha256, chunks), verified and measured."""
    import zstandard

    unpack, reader = zstandard.ZstdDecompressor().decompress, RangeReader()
    for batch in text_batches(batches):
        rows = []
        for doc_id, n_bytes, said, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts = []
            for chunk in sorted(chunks, key=lambda c: c["place"]):
                part = unpack(reader.read(chunk["pack"], chunk["at"], chunk["packed"]))
                if hashlib.sha256(part).digest()[:20] != chunk["digest"]:
                    raise ValueError(f"a chunk in {chunk['pack']} at {chunk['at']} is damaged")
                parts.append(part)
            media = b"".join(parts)
            digest = hashlib.sha256(media).hexdigest()
            if digest != said:
                raise ValueError(f"the media of document {doc_id} differ from what was stored")
            payload = wave_samples(media)
            rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), digest, features(payload)))
        types = [pa.string() if x.endswith("string") else pa.int64() for x in RESULT_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in RESULT_SCHEMA.split(", ")])
    reader.close()


def reconstruct(recipe: DataFrame, index: DataFrame) -> DataFrame:
    """Each medium read back from its chunk list, checked chunk by chunk and as a whole, with features."""
    placed = recipe.join(index.hint("merge"), "digest").withColumn("run", F.shiftright("medium", RUN_BITS))
    chunk = F.struct("place", "digest", "pack", "at", "packed")
    # Media that one task cut one after the other come together again and in that order, which is their chunks'.
    listed = placed.repartition("run").groupBy("run", "medium").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.first("media_sha256").alias("media_sha256"), F.collect_list(chunk).alias("chunks"))
    return listed.sortWithinPartitions("medium").select("doc_id", "n_bytes", "media_sha256", "chunks").mapInArrow(_rebuild, RESULT_SCHEMA)


def roundtrip(docs: DataFrame) -> DataFrame:
    """Every text stored as media and read back: a row for each row of ``docs``, repeated ones too.

    Null texts count as empty and give one unit of blanks; texts of any length are cut, stored and read back
    whole; a null doc_id stays null; other columns, whatever their names, are ignored; an empty table gives
    an empty result.
    """
    return reconstruct(*store(docs))
