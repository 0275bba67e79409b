"""Best-fit packing of token pieces by exact-complement hashing.

The plan is made over the histogram of piece lengths, which has at most ``capacity`` entries however
many documents there are: each step of the plan fixes a combination of lengths that fills a sequence
and uses it as often as the availability counts allow, so every step exhausts a length and the plan
stays below a few times ``capacity`` steps. Pieces take their places by their rank within their
length, which is found by a range-partitioned sort and one count for each partition.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import CACHE_CHUNKS, CACHE_WORDS, default_vocabulary, library_encoder, text_batches
from .shared import discard, materialise, shuffle_partitions

CAPACITY = 4096
#: Chunks and words that a worker's encoder remembers, and fewer for workers whose memory other stages have filled too.
CACHE, SMALL_CACHE = (CACHE_CHUNKS, CACHE_WORDS), (400_000, 250_000)


class ComplementIndex:
    """Which single lengths, pairs and triples of available lengths sum to a given gap.

    The counts are the hash from a length to its availability. For a sum the first valid pair is
    remembered and checked against the counts before use; when it has run out the next is searched.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.pair_at: dict[int, int] = {}

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if 0 < gap < len(self.counts) and self.counts[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """(a, b) with a >= b and a + b == gap. Availability only falls, so a sum's search resumes where it ended."""
        if gap < 2:
            return None
        a = self.pair_at.get(gap, min(gap - 1, len(self.counts) - 1))
        counts = self.counts
        while 2 * a >= gap:
            if counts[a] > (2 * a == gap) and counts[gap - a] > 0:
                self.pair_at[gap] = a
                return a, gap - a
            a -= 1
        self.pair_at[gap] = 0
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """(a, b, c) with a >= b >= c that sum to gap."""
        if gap < 3:
            return None
        for a in np.flatnonzero(self.counts[1 : gap - 1])[::-1] + 1:
            a = int(a)
            if 3 * a < gap:
                break
            rest = gap - a
            low = self.counts[1:rest]
            fits = (low > 0) & (low[::-1] > 0)
            for b in np.flatnonzero(fits)[::-1] + 1:
                b, c = int(b), rest - int(b)
                if b < c:
                    break
                if b <= a and all(self.counts[x] >= (a, b, c).count(x) for x in (a, b, c)):
                    return a, b, c
        return None


@dataclass(frozen=True)
class Step:
    """``times`` sequences, each filled with pieces of these lengths in this order."""

    lengths: tuple[int, ...]
    times: int


def best_fit_steps(counts: np.ndarray, capacity: int) -> list[Step]:
    """Best fit decreasing over a histogram: each piece goes to the smallest gap that holds it.

    Sequences of the same content are one entry. A length fills the entries of a gap as often as it
    fits before the next larger gap is touched, so each length adds at most three entries.
    """
    waiting: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []

    def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if times:
            if gap and not waiting[gap]:
                insort(gaps, gap)
            waiting[gap].append((lengths, times))

    for x in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[x])
        while n:
            k = bisect_left(gaps, x)
            gap = gaps[k] if k < len(gaps) else capacity
            fits = gap // x
            if k < len(gaps):
                lengths, times = waiting[gap].pop()
                if not waiting[gap]:
                    gaps.pop(k)
            else:
                lengths, times = (), -(-n // fits)
            whole, rest = divmod(min(n, times * fits), fits)
            n -= whole * fits + rest
            put(gap - fits * x, lengths + (x,) * fits, whole)
            if rest:
                put(gap - rest * x, lengths + (x,) * rest, 1)
            put(gap, lengths, times - whole - bool(rest))
    return [Step(lengths, times) for entries in waiting for lengths, times in entries]


def complement_steps(histogram: dict[int, int], capacity: int, largest: int) -> list[Step]:
    """Longest pieces first, their gap closed exactly by up to ``largest`` (3 at most) pieces where the
    availability counts have such a combination; the rest is packed best fit."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    steps: list[Step] = []
    index = ComplementIndex(counts)
    searches = (index.single, index.pair, index.triple)[:largest]
    for first in range(capacity, 0, -1):
        gap = capacity - first
        while counts[first] > 0:
            counts[first] -= 1  # not available to its own complement
            found = () if not gap else next((x for search in searches if (x := search(gap))), None)
            counts[first] += 1
            if found is None:
                break
            lengths = (first, *found)
            times = min(int(counts[x]) // lengths.count(x) for x in set(lengths))
            for x in lengths:
                counts[x] -= times
            steps.append(Step(lengths, times))
    return steps + best_fit_steps(counts, capacity)


def plan_steps(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Combinations that use up all pieces of the histogram, in as few sequences as four plans give.

    The plans close gaps by triples, pairs and singles, by pairs and singles, by singles, and by none:
    on flat distributions exact triples use up the small pieces that other gaps need. The last plan is
    best fit decreasing, so the result never needs more sequences than that.
    """
    least = -(-sum(length * n for length, n in histogram.items()) // capacity)
    best: list[Step] | None = None
    for largest in (3, 2, 1, 0):
        steps = complement_steps(histogram, capacity, largest)
        if best is None or sum(s.times for s in steps) < sum(s.times for s in best):
            best = steps
        if sum(s.times for s in best) == least:
            break
    return best or []


def plan_places(steps: list[Step]) -> dict[str, np.ndarray]:
    """Runs of places, sorted by length and rank: pieces of ``length`` from ``rank`` on, ``times`` of
    them, go to sequences ``sequence``, ``sequence`` + 1, ... at ``offset``."""
    next_rank: dict[int, int] = {}
    runs, sequence = [], 0
    for step in steps:
        offset = 0
        for x in step.lengths:
            rank = next_rank.get(x, 0)
            runs.append((x, rank, step.times, sequence, offset))
            next_rank[x] = rank + step.times
            offset += x
        sequence += step.times
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    return {name: table[:, k].copy() for k, name in enumerate(("length", "rank", "times", "sequence", "offset"))}


def token_pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY, cache: tuple[int, int] = CACHE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids with ``end_id`` appended.

    Only documents of more than ``capacity`` ids are cut; null texts count as empty (the end id alone).
    """
    path, end = vocabulary or default_vocabulary(), np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = library_encoder(path, *cache)
        for batch in text_batches(batches):
            keys, piece, start, length, crc = [], [], [], [], []
            for key, raw in zip(batch.column(0).to_pylist(), encoder.encode_batch(batch.column(1).to_pylist()), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    keys.append(key)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def assign_places(pieces: DataFrame, capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """``pieces`` (with a column ``length`` between 1 and ``capacity``) with sequence_id and offset.

    The driver holds the histogram of lengths, the plan made from it and one count for each partition.
    Columns named sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = plan_places(plan_steps(histogram, capacity))
    names = pieces.columns
    at = names.index("length")
    mark_part, mark_place = (next(c for c in (f"{'_' * k}{x}" for k in range(1, len(names) + 2)) if c not in names) for x in ("part", "place"))

    def mark(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))], names=[*names, mark_part, mark_place])
            seen += n

    schema = T.StructType([*pieces.schema.fields, T.StructField(mark_part, T.IntegerType()), T.StructField(mark_place, T.LongType())])
    # The hash beside the length lets pieces of one very common length fill many partitions.
    others = F.xxhash64(*[F.col(f"`{c}`") for c in names if c != "length"])
    dealt = pieces.repartitionByRange(partitions or shuffle_partitions(spark), F.col("length"), others).sortWithinPartitions("length")
    ranked, _ = materialise(dealt.mapInArrow(mark, schema), "ranked")
    sizes = {r[0]: r[1] for r in ranked.groupBy(F.col(f"`{mark_part}`")).agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    shorter, total = np.zeros(capacity + 2, np.int64), 0
    for length in range(capacity + 1):
        shorter[length] = total
        total += histogram.get(length, 0)
    # Runs of one length follow each other by rank, so their ranks counted over all lengths ascend.
    begins = shorter[places["length"]] + places["rank"]

    def place(batches):
        for batch in batches:
            part = batch.column(len(names)).to_numpy(zero_copy_only=False)
            rank = np.array([before[p] for p in part.tolist()], np.int64) + batch.column(len(names) + 1).to_numpy()
            run = np.searchsorted(begins, rank, side="right") - 1
            sequence = places["sequence"][run] + rank - begins[run]
            assert (places["length"][run] == batch.column(at).to_numpy()).all(), "the pieces' order and the plan differ"
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(places["offset"][run])], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY, cache: tuple[int, int] = CACHE) -> DataFrame:
    """Pieces of all documents with their sequence and place: as few sequences as the plan can make.

    Null texts count as empty, which is the end id alone; texts of any length are encoded whole and only
    then cut; repeated rows are packed each; a null doc_id stays null; other columns, whatever their names,
    are ignored; an empty table gives an empty result.
    """
    pieces, written = materialise(token_pieces(docs, vocabulary, end_id, capacity, cache), "pieces")
    packed = assign_places(pieces, capacity)
    discard(docs.sparkSession, written)
    return packed
