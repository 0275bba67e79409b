"""BPE encoders against the tokenizers library; token files and packing against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vitrine.llm import bpe, packing, token_files

PATH = bpe.default_vocabulary()
CHARS = "abAB'sStTlLrReEvVmMdD \t\n\x0b\x0c\x1c\x1d\x1f\x85\xa0 　<|>éÉ́ΣςİıſKÅ①٣中🙂‍\x00\x01$&%_-.,!?09½ß"
TEXTS = st.lists(st.sampled_from([*CHARS, "<|endoftext|>", "<|startoftext|>", "endoftext", "the", "it's"]), max_size=14).map("".join)


def ids_of(text):
    return bpe.library_tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_encoders_match_library(text):
    want = ids_of(text)
    for encoder in (bpe.trie_encoder(PATH), bpe.library_encoder(PATH)):
        assert np.frombuffer(encoder.encode_bytes(text), "<u4").tolist() == want
    raw = np.array(want, "<u4").tobytes()
    decoded = bpe.library_tokenizer(PATH).decode(want, skip_special_tokens=False)
    assert bpe.decoder(PATH).digest(raw, step=3) == hashlib.sha256(decoded.encode()).hexdigest()


def test_long_texts_and_small_caches():
    draw = random.Random(5)
    words = ["".join(draw.choice("etaoin'sé1&") for _ in range(draw.randint(1, 9))) for _ in range(3000)]
    text = " ".join(draw.choice(words) for _ in range(60_000))
    unbroken = "ab1" * 500_000
    encoder = bpe.TrieEncoder(PATH, cache_chunks=50, cache_words=20)
    for x in (text, "short", unbroken, None, ""):
        assert np.frombuffer(encoder.encode_bytes(x), "<u4").tolist() == ids_of(x)
    assert [np.frombuffer(r, "<u4").tolist() for r in encoder.encode_batch(["a", text * 4, None, "b"])] == [ids_of(x) for x in ("a", text * 4, "", "b")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


ROWS = [(3, "the cat", "x"), (1, None, "x"), (2, "", None), (3, "the cat", "y"), (None, "a dog's life", "z"), (7, "word " * 9000, "x")]


def test_encode_and_digests(spark):
    found = bpe.encode(frame(spark, ROWS)).collect()
    assert sorted((r.doc_id or -1, list(r.ids)) for r in found) == sorted((k or -1, ids_of(t)) for k, t, _ in ROWS)
    rows = bpe.encode_decode_digests(frame(spark, ROWS)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256) for r in rows) == sorted((k or -1, len(ids_of(t)), hashlib.sha256(np.array(ids_of(t), "<u4").tobytes()).hexdigest()) for k, t, _ in ROWS)
    assert bpe.encode_decode_digests(frame(spark, [])).count() == 0


def test_token_files(spark):
    files = token_files.write_token_files(frame(spark, ROWS))
    rows = sorted(token_files.read_token_files(spark, files, keep_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 7]
    start = 0
    for r in rows:
        ids = ids_of(next(t for k, t, _ in ROWS if k == r.doc_id)) + [1]
        assert (r.start, r.n_tokens, list(r.ids)) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    prefix = files.shards[-1][0]
    reader = token_files.ShardReader(prefix, files.form)
    assert reader.ids(len(reader) - 1).tolist()[-1] == 1
    with pytest.raises(ValueError, match="dictionary"):
        token_files.ShardReader(prefix, token_files.IdFormat(files.form.width, b"another"))
    empty = token_files.write_token_files(frame(spark, []))
    assert empty.shards == [] and token_files.read_token_files(spark, empty).count() == 0


def test_dictionary_shrinks_short_documents(spark):
    draw = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(draw.choice("the cat sat on a mat and then it ran home again".split()) for _ in range(60))) for k in range(400)], "doc_id long, text string")
    form = token_files.train_format(docs, PATH, 1)
    ids = np.array(ids_of("the cat sat on a mat and then it ran home again " * 3), form.dtype).tobytes()
    assert form.dictionary and len(form.compressor().compress(ids)) < len(token_files.IdFormat(2).compressor().compress(ids))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=20))
def test_plan_uses_every_piece(histogram):
    steps = packing.plan_steps(histogram, 64)
    used = collections.Counter()
    for step in steps:
        assert sum(step.lengths) <= 64 and step.times > 0
        for x in step.lengths:
            used[x] += step.times
    assert used == histogram
    total = sum(k * n for k, n in histogram.items())
    assert sum(s.times for s in steps) >= math.ceil(total / 64)


def best_fit_decreasing(histogram, capacity):
    gaps = []
    for x in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= x]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_plan_is_as_good_as_best_fit():
    draw = random.Random(1)
    for spread in (64, 200, 4096):
        histogram = collections.Counter(min(4096, int(draw.expovariate(1 / spread)) + 1) for _ in range(3000))
        assert sum(s.times for s in packing.plan_steps(histogram)) <= best_fit_decreasing(histogram, 4096)


@pytest.mark.parametrize("kind", ["flat", "log-normal", "middling", "small", "two"])
def test_plan_needs_no_more_than_best_fit_decreasing(kind):
    draw = random.Random(kind)
    make = {"flat": lambda: draw.randint(1, 4096), "log-normal": lambda: int(draw.lognormvariate(6, 1.2)) + 1, "middling": lambda: draw.randint(500, 2500), "small": lambda: draw.randint(1, 60), "two": lambda: draw.choice((1500, 2600))}[kind]
    for n in (5, 400, 3000):
        histogram = collections.Counter(min(4096, make()) for _ in range(n))
        own = sum(s.times for s in packing.best_fit_steps(np.bincount(list(histogram.elements()), minlength=4097), 4096))
        assert own == best_fit_decreasing(histogram, 4096)
        assert sum(s.times for s in packing.plan_steps(histogram)) <= own


def test_places_of_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(k % 7 + 1, k, "a", "b", -1) for k in range(300)], "length long, _part long, _place string, __part string, offset long")
    packed = packing.assign_places(rows, 10).collect()
    assert len(packed) == 300 and packed[0].asDict().keys() == {"length", "_part", "_place", "__part", "sequence_id", "offset"}
    assert len({(r.sequence_id, r.offset) for r in packed}) == 300


def test_residual_gap_equal_to_a_taken_length():
    assert packing.plan_steps({4: 1, 3: 1, 2: 1}, 10) == [packing.Step((4, 3, 2), 1)]


def test_exact_complements():
    index = packing.ComplementIndex(np.bincount([3, 3, 5, 9], minlength=21))
    assert index.single(9) == (9,) and index.single(4) is None
    assert index.pair(6) == (3, 3) and index.pair(10) is None and index.pair(14) == (9, 5)
    assert index.triple(11) == (5, 3, 3) and index.triple(9) is None


def check_packing(rows, texts):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert total == sum(len(ids_of(t)) + 1 for t in texts)
    return len(by), math.ceil(total / 4096)


def test_pack(spark):
    rows = packing.pack(frame(spark, ROWS)).collect()
    check_packing(rows, [t for _, t, _ in ROWS])
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 7)
    assert long == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 809)]
    assert packing.pack(frame(spark, [])).count() == 0


def test_pack_one_very_common_length(spark):
    texts = ["the cat"] * 3000 + ["the cat sat " * (k % 50) for k in range(600)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    used, least = check_packing(rows, texts)
    assert used <= least + 1
