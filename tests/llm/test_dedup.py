"""Exact and near duplicates against brute force."""

import random
import re
import uuid

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.llm import exact_dedup, places, simhash
from vitrine.llm.queries import OP9_SQL

WORDS = [f"w{k}" for k in range(400)]


def near_copies(draw, n):
    """Texts with exact copies, copies in which a word or two differ, and a large group of both."""
    texts = [" ".join(draw.choice(WORDS) for _ in range(draw.randint(40, 300))) for _ in range(n)]
    for _ in range(n):
        words = draw.choice(texts).split()
        for _ in range(draw.randint(0, 2)):
            words[draw.randrange(len(words))] = draw.choice(WORDS)
        texts.append(" ".join(words))
    base = [draw.choice(WORDS) for _ in range(400)]
    for _ in range(n):
        copy = list(base)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(len(copy))] = draw.choice(WORDS)
        texts.append(" ".join(copy))
    return texts


def index(spark):
    return exact_dedup.DigestIndex(spark, f"test_{uuid.uuid4().hex[:8]}", buckets=3)


ROWS = [(1, "a b", "p"), (2, "ab", "q"), (3, " a\tb\n", "r"), (4, None, None), (5, "", "s"), (6, " ", "t"), (7, "c\x0b\x0c\rd", "u"), (8, "cd", "v"), (9, "x y", "w"), (9, "x y", "w"), (None, "solo", "z"), (10, "é b", "z")]


def test_exact_against_sql(spark):
    rows = [r for r in ROWS if r[0] is not None]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    found = sorted(tuple(r) for r in index(spark).ingest(frame).collect())
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert found == sorted(con.sql(OP9_SQL).fetchall())


def test_exact_batches(spark):
    known = index(spark)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, digest string")
    assert known.ingest(frame([])).count() == 0
    first = {r.doc_id: (r.keep_id, r.kept) for r in known.ingest(frame([(1, "a", "x"), (2, "b", "x"), (3, "a ", "x")])).collect()}
    assert first == {1: (3, False), 2: (2, True), 3: (3, True)}
    second = {r.doc_id: (r.keep_id, r.kept) for r in known.ingest(frame([(2, "b", "x"), (4, "a   ", "x"), (5, "c", "x"), (None, "c", "x")])).collect()}
    assert second == {2: (2, False), 4: (3, False), 5: (5, True), None: (5, False)}
    assert known.read().count() == 3
    plan = known.read().join(known.read().withColumnRenamed("keep_id", "k"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan or "bucket" in plan.lower()


def test_exact_stage(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, digest string")
    kept = exact_dedup.deduplicate(frame, index(spark))
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 6, 7, 9, 10]


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text("aB É\t\n\x0b\x1c\x85\xa0x", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(prints):
    values = np.array([f for _, f in prints], np.uint64)
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    low = {}
    for i, (k, _) in enumerate(prints):
        low[find(i)] = min(low.get(find(i), k), k)
    return {k: low[find(i)] for i, (k, _) in enumerate(prints)}


@pytest.mark.parametrize("block", [simhash.BLOCK, 24])
def test_components(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = random.Random(11)
    texts = [*near_copies(draw, 120), "", None, " ", "one", "one", "two words"]
    ids = draw.sample(range(10_000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, ["f"] * len(ids), strict=True)), "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs).collect()
    prints = [(k, brute_fingerprint(t)) for k, t in zip(ids, texts, strict=True)]
    assert {r.doc_id: r.fingerprint for r in found} == {k: f"{f:016x}" for k, f in prints}
    want = brute_components(prints)
    assert {r.doc_id: r.component_id for r in found} == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_every_pair_within_distance_shares_a_chain():
    draw = np.random.default_rng(2)
    a = draw.integers(0, 1 << 63, 4000, np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in draw.choice(64, draw.integers(0, 7), replace=False):
            b[k] ^= np.uint64(1 << int(bit))
    close = np.bitwise_count(a ^ b) <= 4
    segment = lambda x, k: (x >> np.uint64(8 * (k % 8))) & np.uint64(255)
    assert simhash.followers(2) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)] and len(simhash.followers(3)) == 14
    for n in (2, 3):
        found = np.zeros(len(a), bool)
        for start in range(8):
            for choice in simhash.followers(n):
                keyed = np.all([segment(a, start + k) == segment(b, start + k) for k in (0, *choice)], axis=0)
                found |= keyed & simhash.near(a, b, start)
        assert (found == close).all()


@pytest.mark.parametrize("n", [2, 3])
def test_blocks_of_one_key(spark, n):
    """Many distinct fingerprints under one key are compared block by block, over a long chain too."""
    base = 0x0123456789ABCDEF
    prints = [base ^ (k << 40) for k in range(300)] + [(1 << 62) + 7 * k**3 for k in range(50)]
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    roots = simhash.components(simhash.links(nodes, block=16, n=n)).collect()
    group = {}
    for r in roots:
        group.setdefault(r.root, set()).add(r.node)
    want = {}
    for k, v in brute_components([(int(np.uint64(p).astype(np.int64)), p) for p in prints]).items():
        want.setdefault(v, set()).add(k)
    assert sorted(map(sorted, group.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_empty_and_null(spark):
    schema = "doc_id long, text string, component_id long"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert simhash.deduplicate(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e", 1), (5, "a b c d e", 1), (None, "z y x w v u t", 2), (5, "a b c d e", 1)], schema)
    found = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(rows).collect())
    assert found == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert sorted((r.doc_id or -1) for r in simhash.deduplicate(rows).collect()) == [-1, 5]


def test_repeated_ids_of_different_texts(spark):
    draw = random.Random(8)
    a, b, c, d = (" ".join(draw.choice(WORDS) for _ in range(80)) for _ in range(4))
    rows = [(None, a, "a"), (None, b, "b"), (None, b, "b"), (7, c, "c"), (7, d, "d"), (9, c, "c"), (None, d, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.note, r.doc_id) for r in kept.collect()) == [("a", None), ("b", None), ("c", 7), ("d", 7)]
    alone = simhash.deduplicate(docs.where("note = 'a' or note = 'd'"))
    assert sorted((r.note, r.doc_id) for r in alone.collect()) == [("a", None), ("d", 7)]


def test_a_batch_that_comes_again(spark):
    known = index(spark)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    decided = lambda rows, batch: sorted(tuple(r) for r in known.ingest(frame(rows), batch).collect())
    first, second = [(1, "a"), (2, "b"), (3, "a ")], [(4, "b"), (5, "c")]
    once = decided(first, "one")
    assert [r[3] for r in once] == [False, True, True]
    assert decided(first, "one") == once and known.read().count() == 2
    later = decided(second, "two")
    assert [(r[0], r[1], r[3]) for r in later] == [(4, 2, False), (5, 5, True)]
    # As if the job had failed behind the write of half of its digests.
    known.drop()
    known._write(spark.createDataFrame([], "digest binary, keep_id long, n_points long, batch string"), known.table, 3)
    known._write(exact_dedup.winners(exact_dedup.digests(frame(first))).limit(1).selectExpr("digest", "keep_id", "n_points", "'one' AS batch"), known.table, 3)
    assert decided(first, "one") == once and known.read().count() == 2 == known.read().select("digest").distinct().count()
    kept = lambda rows, batch: sorted(r.doc_id for r in exact_dedup.deduplicate(frame(rows), known, batch).collect())
    assert kept(second, "two") == [5] == kept(second, "two") and kept(second, "three") == []
    known.drop()


def test_index_is_rebuilt(spark):
    known = index(spark)
    frame = spark.createDataFrame([(k, f"text {k % 40}") for k in range(60)], "doc_id long, text string")
    known.ingest(frame, "one").count()
    before = sorted(map(tuple, known.read().collect()))
    known.rebuild(8)
    assert known._bucket_count() == 8 and sorted(map(tuple, known.read().collect())) == before
    spark.sql(f"ALTER TABLE {known.table} RENAME TO {known.table}_rebuilt")  # as if a rebuild had ended behind its drop
    assert not known.ingest(frame, "two").where("kept").count()
    assert exact_dedup.buckets_for(10) == 8 and exact_dedup.buckets_for(8 * 4_000_000 + 1) == 16
    known.drop()


LONG = "some words that go on " * 30_000


def test_long_texts(spark):
    rows = [(1, LONG), (2, LONG + " end"), (3, LONG.replace(" ", "  ")), (4, "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    known = index(spark)
    assert {r.doc_id: r.keep_id for r in known.ingest(frame).collect()} == {1: 3, 2: 2, 3: 3, 4: 4}
    known.drop()
    found = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(frame).collect()}
    assert {k: f for k, (f, _) in found.items()} == {k: simhash.fingerprint(t) for k, t in rows} and found[3][1] == found[2][1] == 1


def test_places(spark, tmp_path):
    """Rows are found again whatever the splits, in files, in memory, and under clashing names."""
    rows = spark.range(5000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 50) AS text", "id AS _file", "'m' AS _metadata")
    rows.repartition(7).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    rows.write.json(str(tmp_path / "j"))
    lines = spark.read.schema(rows.schema).json(str(tmp_path / "j"))
    for frame, straight in ((stored, True), (lines, False), (stored.where("doc_id % 2 = 0"), True), (stored.repartition(3), False), (rows, False), (stored.union(stored), False)):
        assert places._places_known(frame) == straight
        found = places.placed(frame)
        assert len({*found.columns, found.file, found.row}) == 6
        wanted = found.rows.where("doc_id % 10 = 4").select(F.col(found.file).alias("file"), F.col(found.row).alias("row"))
        for size in ("20k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            kept = places.keep(found, wanted)
            assert kept.columns == rows.columns
            assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in frame.where("doc_id % 10 = 4").collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert places.keep(places.placed(stored), wanted.limit(0)).count() == 0


def test_shards_are_looked_up(spark):
    rows = [(f, r, f * 1000 + r) for f in (-5, 3, 9) for r in range(0, 400, 3)]
    shards = places.write_shards(spark.createDataFrame(rows, "file long, row long, value long"), "test")
    reader = places.ShardReader(shards)
    files, numbers = np.repeat(np.array([9, -5, 4, 3]), 500), np.tile(np.arange(500), 4)
    hit, value = reader.find(files, numbers)
    known = {(f, r): v for f, r, v in rows}
    assert hit.tolist() == [(f, r) in known for f, r in zip(files.tolist(), numbers.tolist())]
    assert value.tolist() == [known.get((f, r), 0) for f, r in zip(files.tolist(), numbers.tolist())]
