"""BPE encoding and decoding with vocabularies in the tokenizers library's JSON format.

Two encoders give the same ids:

* ``TrieEncoder`` inserts the distinct words of a batch into a trie and walks it depth first. At
  each node it keeps the last token of the node's prefix, so the encoding of a prefix that many
  words share is computed once.
* ``LibraryEncoder`` hands distinct words to the tokenizers library.

Both work on whitespace-free chunks of the raw text, which normalisation and pre-tokenisation never
look across, and keep a bounded cache from chunk to ids. Empty and null texts have no ids. Texts of
any length are read in segments, so memory is bounded by the longest run without white space.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: The white space of the vocabularies' patterns, and the separators that str.split() also takes.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
CONTROL_SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = re.compile(f"[{SPACES}]+")
BEYOND = re.compile("[^\x00-\u017f]")

#: Characters of a text that are split at once; chunks and words that a cache holds.
SEGMENT_CHARS = 1 << 20
CACHE_CHUNKS, CACHE_WORDS = 700_000, 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def chunk_lists(text: str) -> Iterator[list[str]]:
    """Lists of the text's maximal runs without white space, in order."""
    start, n = 0, len(text)
    while start < n:
        end = min(n, start + SEGMENT_CHARS)
        if end < n:
            cut = SPACE.search(text, end)
            end = cut.start() if cut else n
        part = text[start:end] if start or end < n else text
        if CONTROL_SEPARATORS.search(part):
            yield [x for x in SPACE.split(part) if x]
        else:
            yield part.split()
        start = end


class ChunkEncoder:
    """Texts to ids through a bounded cache of chunks; subclasses encode the chunks it lacks.

    A chunk's ids are kept as little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        self.path, self.cache_chunks = path, cache_chunks
        self.cache: dict[str, bytes] = {}

    def encode_chunks(self, chunks: list[str]) -> Iterable[bytes]:
        raise NotImplementedError

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Encode distinct chunks that the cache lacks, and keep them."""
        new = list(chunks)
        found = dict(zip(new, self.encode_chunks(new), strict=True))
        if len(self.cache) + len(found) > self.cache_chunks:
            self.cache.clear()
        self.cache.update(found)
        return found

    def encode_lists(self, lists: list[list[str]]) -> Iterator[bytes]:
        """Ids of each list of chunks; the lists' unknown chunks are learnt together."""
        got = [list(map(self.cache.get, chunks)) for chunks in lists]
        lacking = [None in ids for ids in got]
        unknown: set[str] = set()
        for chunks, ids in zip(compress(lists, lacking), compress(got, lacking), strict=True):
            unknown.update(compress(chunks, map(is_, ids, repeat(None))))
        new = self.learn(unknown) if unknown else {}
        for chunks, ids, some in zip(lists, got, lacking, strict=True):
            if some:
                at = -1
                for _ in range(ids.count(None)):
                    at = ids.index(None, at + 1)
                    ids[at] = new[chunks[at]]
            yield b"".join(ids)

    def encode_batch(self, texts: Iterable[str | None], group_chars: int = 1 << 21) -> Iterator[bytes]:
        """Ids of each text; neighbouring texts share a lookup of what is unknown."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > group_chars:
                yield from self.encode_lists(group)
                group, size = [], 0
                yield b"".join(x for part in chunk_lists(text) for x in self.encode_lists([part]))
                continue
            if size + len(text) > group_chars:
                yield from self.encode_lists(group)
                group, size = [], 0
            group.append([x for part in chunk_lists(text) for x in part] if len(text) > SEGMENT_CHARS else next(chunk_lists(text), []))
            size += len(text)
        yield from self.encode_lists(group)

    def encode_bytes(self, text: str | None) -> bytes:
        return next(iter(self.encode_batch([text])))


class MergeTable:
    """Symbols, merges and the check whether two tokens may stand side by side.

    A sequence of tokens is the encoding of its text exactly if each pair of neighbours is: merging
    the pair's symbols by rank, leftmost first, must never join across their border.
    """

    NEVER = 1 << 60

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.rank = {pair: k for k, pair in reversed(list(enumerate(merges)))}
        self.longest = max(map(len, vocab), default=1)
        self.sides: dict[str, tuple[list, list] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merge(self, symbols: list[str]) -> list[tuple]:
        """Trees (token, left, right, rank) of the symbols' encoding."""
        trees = [(s, None, None, -1) for s in symbols]
        while len(trees) > 1:
            best = min(range(len(trees) - 1), key=lambda k: self.rank.get((trees[k][0], trees[k + 1][0]), self.NEVER))
            rank = self.rank.get((trees[best][0], trees[best + 1][0]), self.NEVER)
            if rank == self.NEVER:
                break
            a, b = trees[best], trees[best + 1]
            trees[best : best + 2] = [(a[0] + b[0], a, b, rank)]
        return trees

    def edges(self, token: str) -> tuple[list, list] | None:
        """The token's leftmost and its rightmost pieces as they grow, each with the rank at which it
        is joined to the next; None for a token that its own symbols don't merge into."""
        if token not in self.sides:
            trees = self.merge(self.symbols(token))
            if len(trees) != 1:
                self.sides[token] = None
            else:
                found = []
                for side in (1, 2):
                    path, tree, absorbed = [], trees[0], self.NEVER
                    while tree is not None:
                        path.append((tree[0], absorbed))
                        absorbed, tree = tree[3], tree[side]
                    found.append(path[::-1])
                self.sides[token] = (found[0], found[1])
        return self.sides[token]

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` can follow ``left`` in an encoding."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._fits(left, right)
        return known

    def _fits(self, left: str, right: str) -> bool:
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return False
        ends, starts, rank = a[1], b[0], self.rank
        i = j = 0
        while True:
            (x, x_rank), (y, y_rank) = ends[i], starts[j]
            across = rank.get((x, y))
            # Of equal ranks the leftmost pair merges first: x with its left neighbour before x with y.
            if across is not None and across < x_rank and across <= y_rank:
                return False
            if x_rank == y_rank == self.NEVER:
                return True
            if x_rank <= y_rank:
                i += 1
            else:
                j += 1


class WordEncoder(ChunkEncoder):
    """Chunks are normalised and cut into words as the vocabulary's file says; subclasses encode words.

    All chunks of a call are cut by one pass of the file's pattern over their lines. A line's end stands
    in the ids as a number that no token has, and there they are parted again.
    """

    LINE, LINE_ID = "\n", 0xFFFFFFFF

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS, cache_words: int = CACHE_WORDS):
        super().__init__(path, cache_chunks)
        import json

        import regex

        self.tokenizer = library_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        self.normalise = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.words_of = regex.compile(f"(?:{self.spec['pre_tokenizer']['pretokenizers'][0]['pattern']['Regex']})|{self.LINE}").findall
        self.marks = [t["content"] for t in self.spec.get("added_tokens", ())]
        self.hint = os.path.commonprefix(self.marks)
        self.letters = {b: c for b, c in enumerate(byte_alphabet()) if chr(b) != c}
        self.cache_words = cache_words
        self.words: dict[str, bytes] = {}

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        text = self.LINE.join(chunks)
        if (not self.marks or self.hint not in text) and not BEYOND.search(text):
            # Below U+0180 all characters are composed already and lower-case alike in every library.
            return self.encode_lines(text.lower())
        plain, other, found = [], [], {}
        for chunk in chunks:
            if self.marks and self.hint in chunk and any(m in chunk for m in self.marks):
                found[chunk] = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                (other if BEYOND.search(chunk) else plain).append(chunk)
        if plain:
            found.update(zip(plain, self.encode_lines(self.LINE.join(plain).lower()), strict=True))
        if other:
            found.update(zip(other, self.encode_lines(self.LINE.join(map(self.normalise, other))), strict=True))
        return [found[x] for x in chunks]

    def encode_lines(self, text: str) -> list[bytes]:
        """Ids of each line of a normalised text."""
        words = self.words_of(text)
        distinct = set(words)
        if len(self.words) + len(distinct) > self.cache_words:
            self.words.clear()
        known = self.words
        known[self.LINE] = self.LINE_ID.to_bytes(4, "little")
        distinct.difference_update(known)
        if distinct:
            new = list(distinct)
            spelt = [w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(self.letters) for w in new]
            codes = self.encode_words(spelt)
            known.update(zip(new, map(codes.__getitem__, spelt), strict=True))
        raw = b"".join(map(known.__getitem__, words))
        ends = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == self.LINE_ID)).tolist()
        return [raw[i:j] for i, j in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True)]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words in the byte alphabet."""
        raise NotImplementedError


class LibraryEncoder(WordEncoder):
    """Distinct words encoded by the tokenizers library's BPE model."""

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        tokenize = self.tokenizer.model.tokenize
        return {w: array("I", [t.id for t in tokenize(w)]).tobytes() for w in words}


class TrieEncoder(WordEncoder):
    """Distinct words in a trie, encoded by one depth-first walk that passes last-token states down."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS, cache_words: int = CACHE_WORDS):
        super().__init__(path, cache_chunks, cache_words)
        model = self.spec["model"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.table = MergeTable(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.codes = {t: k.to_bytes(4, "little") for t, k in model["vocab"].items()}

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct byte-alphabet words; a shared prefix is encoded once."""
        # The trie's many small dictionaries hold no cycles: collecting garbage meanwhile finds nothing.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._walk(words)
        finally:
            if collecting:
                gc.enable()

    def _walk(self, words: list[str]) -> dict[str, bytes]:
        root: dict = {}
        for word in words:
            node = root
            for char in word[:-1]:
                found = node.get(char)
                if found is None:
                    found = node[char] = {}
                node = found
            node[word[-1] + "\0"] = word  # a leaf: the last symbol carries the end of the word
        ending, codes, fits, edges = self.table.end, self.codes, self.table.fits, self.table.edges
        out: dict[str, bytes] = {}
        # States along the path to the node at hand: for each length of its prefix the last token,
        # where that token begins, and the whole encoding.
        tokens, begins, encoded = [""], [0], [b""]
        todo = [(root, "", "", 0, b"")]
        while todo:
            node, text, token, begin, code = todo.pop()
            depth = len(text)
            tokens[depth:], begins[depth:], encoded[depth:] = [token], [begin], [code]
            for symbol, below in node.items():
                leaf = len(symbol) > 1
                whole = text + symbol[0] + ending if leaf else text + symbol
                # Of the tokens that end here, exactly one may follow the last token of what stands
                # before it. Most often it grows the token of the node above or begins after it.
                for at in (begin, *range(depth, begin, -1), *range(begin - 1, -1, -1)):
                    piece = whole[at:]
                    if piece in codes and (fits(tokens[at], piece) if at else edges(piece) is not None):
                        break
                else:
                    raise ValueError(f"no encoding of {whole!r}: the vocabulary lacks a byte")
                if leaf:
                    out[below] = encoded[at] + codes[piece]
                else:
                    todo.append((below, whole, piece, at, encoded[at] + codes[piece]))
        return out


@lru_cache(maxsize=1)
def byte_alphabet() -> tuple[str, ...]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in plain else chr(next(spare)) for b in range(256))


class Decoder:
    """decode(ids, skip_special_tokens=False) for vocabularies without a decoder: tokens joined by a space."""

    def __init__(self, path: str):
        tokenizer = library_tokenizer(path)
        if tokenizer.decoder is not None:
            raise ValueError("the vocabulary has a decoder of its own; use the library's decode()")
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [(tokenizer.id_to_token(k) or "").encode("utf-8") for k in range(size)]

    def decode_bytes(self, ids: array | list[int]) -> bytes:
        return b" ".join(map(self.pieces.__getitem__, ids))

    def digest(self, raw_ids: bytes, step: int = 1 << 18) -> str:
        """SHA-256 of the decoded text, in pieces of ``step`` ids."""
        state, n = hashlib.sha256(), len(raw_ids) // 4
        for k in range(0, n, step):
            part = array("I", raw_ids[4 * k : 4 * min(n, k + step)])
            state.update(self.decode_bytes(part) if not k else b" " + self.decode_bytes(part))
        return state.hexdigest()


@lru_cache(maxsize=4)
def trie_encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


@lru_cache(maxsize=4)
def library_encoder(path: str, cache_chunks: int = CACHE_CHUNKS, cache_words: int = CACHE_WORDS) -> LibraryEncoder:
    return LibraryEncoder(path, cache_chunks, cache_words)


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def text_batches(batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of few rows and, but for a single longer text, at most ``size`` bytes of text,
    so that the Python copies of texts and what is made of them stay small."""
    for batch in batches:
        taken = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                taken += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        sums = np.cumsum(taken)
        k = 0
        while k < batch.num_rows:
            before = int(sums[k - 1]) if k else 0
            end = min(k + rows, max(k + 1, int(np.searchsorted(sums, before + size, side="right"))))
            yield batch.slice(k, end - k)
            k = end


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", encoder: Callable = trie_encoder) -> DataFrame:
    """``docs`` with one more column, ``ids`` (array of int): the encoding of each whole text.

    Null and empty texts get an empty array; repeated rows and any other columns pass unchanged. A
    column named ``ids`` in ``docs`` is replaced.
    """
    path = vocabulary or default_vocabulary()
    kept = [c for c in docs.columns if c != "ids"]
    source = docs.select(*(docs[f"`{c}`"] for c in kept))
    from pyspark.sql import types as T

    schema = T.StructType([*source.schema.fields, T.StructField("ids", T.ArrayType(T.LongType(), False), False)])
    at = kept.index(text)

    def run(batches):
        work = encoder(path)
        for batch in text_batches(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in work.encode_batch(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int64()))], names=[*kept, "ids"])

    return source.mapInArrow(run, schema)


def encode_decode_digests(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its number of ids, SHA-256 of the ids and of the text decoded from them.

    Null and empty texts have 0 ids and the digests of nothing; texts of any length are encoded whole.
    Repeated rows give repeated results, a null key stays null, other columns, whatever their names, are
    ignored, and an empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        work, back = trie_encoder(path), decoder(path)
        for batch in text_batches(batches):
            n, first, second = [], [], []
            for raw in work.encode_batch(batch.column(1).to_pylist()):
                n.append(len(raw) // 4)
                first.append(hashlib.sha256(raw).hexdigest())
                second.append(back.digest(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
