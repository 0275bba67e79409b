"""SimHash near-duplicate detection with a pigeonring filter.

A fingerprint has 64 bits in 8 segments that form a ring. If two fingerprints differ in at most 4
bits, there is a segment from which every chain of l consecutive segments differs in at most
l * 4 / 8 bits. So, counted from that segment: it is equal itself, of the next two segments one at
least is equal, of the next four two at least are, and of the next six three. Two fingerprints are
compared only if they agree in a start segment and two (for very many fingerprints three) of the
following that fit this; then the budgets of all chains from that start are checked, and at last the
full distance. Every pair within the distance is found with either number.

Exact copies fall together before any of this, as the work is on distinct fingerprints. Fingerprints
that share a key are linked by a forest, not by all their pairs: a fingerprint already reached is not
compared again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_batches
from .places import keep, placed
from .shared import discard, materialise

SHINGLE, SEED, BITS, DISTANCE = 4, 42, 64, 4
SEGMENTS, WIDTH = 8, 8


def followers(n: int) -> list[tuple[int, ...]]:
    """Choices of n equal segments behind a start, as places from it: j or more of them among the first 2j."""
    return [c for c in combinations(range(1, 2 * n + 1), n) if all(c[j] <= 2 * (j + 1) for j in range(n))]


#: Distinct fingerprints up to which keys hold two followers (24 bits); beyond it three (32 bits).
FEW = 1 << 23
#: Fingerprints of one key that are compared in one piece; more are compared block by block.
BLOCK = 2048
#: Shingles that are hashed and counted at a time.
STEP = 1 << 15


def shingle_hashes(text: str | None, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle, in arrays of at most STEP."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    for k in range(0, len(starts), STEP):
        a, b = starts[k : k + STEP].tolist(), ends[k : k + STEP].tolist()
        yield np.fromiter((xxh64_intdigest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half the shingles' hashes; no words give zero."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text):
        # Bit i of a little-endian word stands at place i of its unpacked bytes.
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
        n += len(hashes)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp): each document's fingerprint, as a signed 64-bit integer; and the long columns ``more``."""

    def run(batches):
        for batch in text_batches(batches):
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.astype(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *more])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`") for c in more))
    return source.mapInArrow(run, ", ".join(f"`{c}` long" for c in ("doc_id", "fp", *more)))


def _chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """For each chain from ``start``, shortest first: its bits and how many may differ."""
    masks, bits = [], 0
    for length in range(1, SEGMENTS + 1):
        bits |= (1 << WIDTH) - 1 << WIDTH * ((start + length - 1) % SEGMENTS)
        masks.append((np.uint64(bits), length * DISTANCE // SEGMENTS))
    return masks


CHAINS = [_chain_masks(start) for start in range(SEGMENTS)]


def near(a: np.ndarray, b: np.ndarray, start: int | np.ndarray) -> np.ndarray:
    """Which pairs keep the budgets of all chains from ``start``; the last chain is the whole distance."""
    differing = a ^ b
    passed = np.ones(differing.shape, bool)
    for k in range(1, SEGMENTS):
        if isinstance(start, np.ndarray):
            masks = np.array([CHAINS[s][k][0] for s in range(SEGMENTS)], np.uint64)[start]
        else:
            masks = CHAINS[start][k][0]
        passed &= np.bitwise_count(differing & masks) <= CHAINS[0][k][1]
    return passed


def forest(left: np.ndarray, right: np.ndarray | None, start: int) -> list[tuple[int, int]]:
    """Pairs that connect whatever is linked among ``left`` (or, with ``right``, between the two blocks).

    A breadth-first walk that compares a fingerprint only with those not yet reached; those it reaches
    are chained to each other, as for components it doesn't matter through whom they hang together.
    """
    found: list[tuple[int, int]] = []
    both = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(both), np.int8)
    side[len(left) :] = 1
    waiting = np.arange(len(both))
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            at = queue.pop()
            linked = near(both[waiting], both[at], start)
            if right is not None:
                linked &= side[waiting] != side[at]
            if linked.any():
                reached = waiting[linked].tolist()
                found.extend((int(both[x]), int(both[y])) for x, y in zip([at, *reached[:-1]], reached, strict=True))
                queue.extend(reached)
                waiting = waiting[~linked]
    return found


def keyed(nodes: DataFrame, n: int) -> DataFrame:
    """(key, fp): a row for each start segment and each choice of n followers.

    The key holds the choice's number and the chosen segments' bits.
    """
    segment = lambda k: F.shiftrightunsigned(F.col("fp"), WIDTH * (k % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))
    keys, choices = [], followers(n)
    for start in range(SEGMENTS):
        for number, choice in enumerate(choices, start * len(choices)):
            key = F.lit(number << (n + 1) * WIDTH).cast("long")
            for place, k in enumerate((0, *choice)):
                key = key + segment(start + k) * F.lit(1 << (n - place) * WIDTH).cast("long")
            keys.append(key)
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _runs(batches: Iterable[pa.RecordBatch], columns: int, block: int) -> Iterator[tuple[bool, tuple[np.ndarray, ...]]]:
    """Sorted batches regrouped into (False, arrays), in which no run of equal first ``columns`` is cut, and
    (True, arrays): a part of a run that is longer than ``block``, passed on without gathering it."""
    rest, crowded = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if crowded is not None:
            same = np.ones(len(arrays[0]), bool)
            for c, key in zip(arrays, crowded, strict=False):
                same &= c == key
            n = int(same.sum())
            if n:
                yield True, tuple(c[:n] for c in arrays)
            if n == len(same):
                continue
            arrays, crowded = [c[n:] for c in arrays], None
        if rest is not None:
            arrays = [np.concatenate(x) for x in zip(rest, arrays, strict=True)]
        differs = np.zeros(len(arrays[0]), bool)
        for c in arrays[:columns]:
            differs |= c != c[-1]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield False, tuple(c[:cut] for c in arrays)
        rest = [c[cut:] for c in arrays]
        if len(rest[0]) > block:
            yield True, tuple(rest)
            rest, crowded = None, tuple(c[-1] for c in arrays[:columns])
    if rest is not None and len(rest[0]):
        yield False, tuple(rest)


def starts(keys: np.ndarray, n: int) -> np.ndarray:
    """The start segments of keys with n followers."""
    return (keys >> (n + 1) * WIDTH) // len(followers(n))


PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])
#: Runs up to this long are compared pair by pair, all runs of a batch together.
SHORT = 16


def _compare(batches: Iterable[pa.RecordBatch], block: int, n: int) -> Iterator[pa.RecordBatch]:
    """Links within the runs of a key: (a, b, null). Members of runs above ``block`` come back as (fp, null, key)."""
    for crowded, (key, fp) in _runs(batches, 1, block):
        if crowded:
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(key)], schema=PAIR_SCHEMA)
            continue
        bits = fp.astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(first, len(key)))
        of = np.repeat(np.arange(len(first)), length)
        short = length[of] <= min(SHORT, block)
        start = starts(key, n)
        out_a, out_b = [], []
        for step in range(1, min(SHORT, int(length.max()))):
            at = np.flatnonzero(short[:-step] & (of[step:] == of[:-step]))
            at = at[near(bits[at], bits[at + step], start[at])] if len(at) else at
            out_a.append(fp[at])
            out_b.append(fp[at + step])
        pairs = []
        for k in np.flatnonzero((length > min(SHORT, block)) & (length <= block)):
            part = bits[first[k] : first[k] + length[k]]
            pairs += forest(part, None, int(start[first[k]]))
        if pairs:
            x = np.array(pairs, np.uint64).astype(np.int64)
            out_a.append(x[:, 0])
            out_b.append(x[:, 1])
        if out_a and sum(map(len, out_a)):
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=PAIR_SCHEMA)
        long = length[of] > block
        if long.any():
            yield pa.RecordBatch.from_arrays([pa.array(fp[long]), pa.nulls(int(long.sum()), pa.int64()), pa.array(key[long])], schema=PAIR_SCHEMA)


def _compare_blocks(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Links within and between two blocks of one key; rows (key, low, high, block, fp) sorted by the first three."""
    # Blocks hold about half of BLOCK each, by hash; what two of them hold is gathered.
    for _, (key, low, high, block, fp) in _runs(batches, 3, 1 << 62):
        bits = fp.astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        start = starts(key, n)
        for i, j in zip(first, [*first[1:], len(key)], strict=True):
            if low[i] == high[i]:
                pairs = forest(bits[i:j], None, int(start[i]))
            else:
                lower = block[i:j] == low[i]
                pairs = forest(bits[i:j][lower], bits[i:j][~lower], int(start[i]))
            if pairs:
                x = np.array(pairs, np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.nulls(len(x), pa.int64())], schema=PAIR_SCHEMA)


def links(nodes: DataFrame, block: int | None = None, n: int | None = None) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that connect all that differ in at most DISTANCE bits.

    Keys of up to ``block`` fingerprints are compared whole, larger ones block by block; the links are the same.
    """
    block, n = block or BLOCK, n or (2 if nodes.count() <= FEW else 3)
    dealt = keyed(nodes, n).repartition("key").sortWithinPartitions("key")
    compared, compared_uri = materialise(dealt.mapInArrow(lambda batches: _compare(batches, block, n), "a long, b long, key long"), "compared")
    found = compared.where("key is null").select("a", "b")
    crowded = compared.where("key is not null").select("key", F.col("a").alias("fp"))
    if crowded.limit(1).count():
        sizes = crowded.groupBy("key").agg(F.ceil(F.count("*") / F.lit(max(1, block // 2))).cast("int").alias("blocks"))
        rows = crowded.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        # A block meets each other block of its key and itself: n blocks give n rows for each row.
        rows = rows.select("key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp")
        dealt = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        found = found.unionByName(dealt.mapInArrow(lambda batches: _compare_blocks(batches, n), "a long, b long, key long").select("a", "b"))
    edges, _ = materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    discard(nodes.sparkSession, compared_uri)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of the edges (a, b), root being the smallest node.

    Each round every node takes the smallest label among itself, its neighbours and its label's own
    label, so labels reach over twice the distance of the round before. Rounds end when no label
    changes; each is written to the shared folder.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    labels, uri = materialise(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "root")
        # A root learns of the smaller roots that its members have seen, and members take it over below.
        lower = around.union(labels).groupBy("node").agg(F.min("root").alias("low"))
        seen, seen_uri = materialise(labels.join(lower, "node").select("node", "root", "low"), "seen")
        # Tables on both sides let adaptive execution split the root of a very large component.
        pulled, pulled_uri = materialise(seen.groupBy("root").agg(F.min("low").alias("best")), "pulled")
        down = F.least("low", "best")
        after, after_uri = materialise(seen.join(pulled.hint("merge"), "root").select("node", down.alias("root"), (down != F.col("root")).alias("changed")), "labels")
        discard(spark, seen_uri)
        discard(spark, pulled_uri)
        changed = after.where("changed").limit(1).count()
        discard(spark, uri)
        labels, uri = after.select("node", "root"), after_uri
        if not changed:
            return labels


def rooted(nodes: DataFrame) -> DataFrame:
    """``nodes``, of distinct fingerprints fp, with the column root, which tells their components apart."""
    roots = components(links(nodes.select("fp")))
    # Nodes without a link are components of their own; the join is on distinct fingerprints.
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Texts without words, null ones included, have fingerprint zero, which is linked like any other; texts
    of any length are hashed whole. Rows that repeat a doc_id give a row each, and rows of equal texts
    share their component. Null doc_ids are never a component's id unless it holds nothing else. Other
    columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    prints, _ = materialise(fingerprints(docs), "prints")
    nodes, nodes_uri = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    grouped, grouped_uri = materialise(rooted(nodes), "rooted")
    smallest, smallest_uri = materialise(grouped.groupBy("root").agg(F.min("rep").alias("component_id")), "smallest")
    named, _ = materialise(grouped.join(smallest.hint("merge"), "root").select("fp", "component_id"), "named")
    for uri in (nodes_uri, grouped_uri, smallest_uri):
        discard(docs.sparkSession, uri)
    # Both sides are read from tables and shuffled for this join, so a fingerprint that many rows share is split.
    found = prints.join(named.hint("merge"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component, that of smallest doc_id, with all columns.

    Of rows that repeat this doc_id in the component that of smallest fingerprint stays, then the first
    in its file. A row with a null doc_id stays only where its component has no other. Null and empty
    texts are one component, texts of any length are hashed whole, other columns pass unchanged whatever
    their names, and an empty table stays empty. Only fingerprints and places are shuffled; texts are
    read again where they lie.
    """
    found = placed(docs)
    spark, place = docs.sparkSession, ("file", "row")
    source = found.rows.select("doc_id", "text", F.col(f"`{found.file}`").alias("file"), F.col(f"`{found.row}`").alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "fp", *place))
    nodes, nodes_uri = materialise(fingerprints(source, *place).groupBy("fp").agg(first.alias("first")), "nodes")
    winners = rooted(nodes).groupBy("root").agg(F.min("first").alias("first"))
    staying, staying_uri = materialise(winners.select("first.file", "first.row"), "staying")
    kept = keep(found, staying)
    discard(spark, nodes_uri)
    discard(spark, staying_uri)
    return kept
