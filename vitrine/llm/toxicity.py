"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear in hashed words and word beginnings and in whether they occur again. It learns from confirmed toxic
documents and from unlabelled text, of which a known share (the class prior) is toxic too. The risk
of the clean class is estimated as the unlabelled risk less the prior's share of the positive one;
where a step would take it below zero it is pushed back up instead (the non-negative estimator).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import chunk_lists, text_batches
from .quality import held_out
from .shared import hash_sample, materialise

FLAG = 0.3
#: Bounds of a fit, as ``train`` takes them: confirmed documents, unlabelled ones (both drawn by id hash), weights.
#: Fewer weights leave out the least significant features, so they change the model.
POSITIVES, UNLABELLED, FEATURES = 4_000, 8_000, 4_000
BITS = 24
PREFIXES = (4, 5, 6, 7, 8)
#: A word or beginning is a feature once for each of these numbers of times that it occurs.
LEVELS = (1, 2, 3)
#: Confirmed documents that a feature must be in, and how many standard errors it must stand out by: lower bounds
#: let in what a few documents share by chance.
LEAST_DOCS, LEAST_Z = 3, 3.5
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000


def word_hashes(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings."""
    from xxhash import xxh32_intdigest

    names = [f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]
    return [xxh32_intdigest(x) >> (32 - BITS) for x in names]


def word_counts(text: str | None) -> Counter:
    """Lower-case words without marks at their edges, and how often they occur."""
    chunks: Counter = Counter()
    for part in chunk_lists(text or ""):
        chunks.update(part)
    found: Counter = Counter()
    for chunk, n in chunks.items():
        word = chunk.lower()
        if word := word if word.isalnum() else EDGES.sub("", word):
            found[word] += n
    return found


def feature_id(hashed: int, level: int) -> int:
    """A feature's number: its hash and the place of its level in LEVELS."""
    return hashed * 4 + level


def document_features(text: str | None) -> np.ndarray:
    """Sorted distinct features of a text."""
    counts: Counter = Counter()
    for word, n in word_counts(text).items():
        for h in word_hashes(word):
            counts[h] += n
    return np.unique(np.array([feature_id(h, k) for h, n in counts.items() for k, least in enumerate(LEVELS) if n >= least], np.int32))


@dataclass
class PuModel:
    """Weights of the kept features, a bias, and the cut that scores show as FLAG."""

    weights: dict[int, float]
    bias: float
    cut: float
    memory: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.hashes = {f // 4 for f in self.weights}

    def raw(self, text: str | None) -> float:
        """Bias and the weights of the text's features."""
        memory, counts = self.memory, Counter()
        for word, n in word_counts(text).items():
            part = memory.get(word)
            if part is None:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                part = memory[word] = tuple(h for h in word_hashes(word) if h in self.hashes)
            for h in part:
                counts[h] += n
        return self.bias + math.fsum(self.weights.get(feature_id(h, k), 0.0) for h, n in counts.items() for k, least in enumerate(LEVELS) if n >= least)

    def score(self, text: str | None) -> float:
        """Between 0 and 1, rising with the raw value, FLAG at the cut."""
        z = self.raw(text) - self.cut + math.log(FLAG / (1 - FLAG))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def choose_features(names: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, n_positive: int, n_unlabelled: int, prior: float, keep: int = FEATURES) -> np.ndarray:
    """Features that stand out in confirmed documents against unlabelled ones, sorted: those in LEAST_DOCS or
    more and with the ``keep`` largest significances of the two shares' difference. ``positive`` and
    ``unlabelled`` count the documents that have a feature."""
    a, b = positive / max(1, n_positive), unlabelled / max(1, n_unlabelled)
    clean = np.maximum((b - prior * a) / max(1e-6, 1 - prior), 0)  # the share among clean documents
    spread = np.sqrt(a * (1 - a) / max(1, n_positive) + (clean * (1 - clean) + 1 / max(1, n_unlabelled)) / max(1, n_unlabelled))
    z = np.where(positive >= LEAST_DOCS, (a - clean) / np.maximum(spread, 1e-9), 0)
    order = np.lexsort((names, -z))[:keep]
    return np.sort(names[order[z[order] > LEAST_Z]])


def chosen_features(counted: DataFrame, n_positive: int, n_unlabelled: int, prior: float, keep: int = FEATURES) -> np.ndarray:
    """``choose_features`` of a table (f, p, u): only what is chosen reaches the driver."""
    n, m = max(1, n_positive), max(1, n_unlabelled)
    a, b = F.col("p") / n, F.col("u") / m
    clean = F.greatest((b - prior * a) / max(1e-6, 1 - prior), F.lit(0.0))
    spread = F.sqrt(a * (1 - a) / n + (clean * (1 - clean) + 1 / m) / m)
    z = (a - clean) / F.greatest(spread, F.lit(1e-9))
    best = counted.where(F.col("p") >= LEAST_DOCS).select("f", z.alias("z")).where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "f").limit(keep)
    return np.sort(np.array([r.f for r in best.collect()], np.int64))


@dataclass(frozen=True)
class Bags:
    """Which kept features (places ``at``) which of ``n`` documents (``of``, ascending) have."""

    at: np.ndarray
    of: np.ndarray
    n: int

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.of, w[self.at], minlength=self.n)[: self.n] + b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def risk(w: np.ndarray, b: float, positive: Bags, unlabelled: Bags, prior: float) -> tuple[float, float, np.ndarray]:
    """The positive part of the risk, the clean part before it is bounded by zero, and the gradient of a step.

    With losses l(+) = log(1 + exp(-g)) and l(-) = log(1 + exp(g)) the positive part is prior * E+[l(+)] and
    the clean part Eu[l(-)] - prior * E+[l(-)]. While the clean part is not negative the step goes down
    their sum; else it goes up the clean part alone.
    """
    gp, gu = positive.margins(w, b), unlabelled.margins(w, b)
    mean = lambda x: float(x.mean()) if len(x) else 0.0
    first, clean = prior * mean(np.logaddexp(0, -gp)), mean(np.logaddexp(0, gu)) - prior * mean(np.logaddexp(0, gp))
    on_positive, on_unlabelled = prior * (sigmoid(gp) - 1) / max(1, positive.n), sigmoid(gu) / max(1, unlabelled.n)
    corrected = -prior * sigmoid(gp) / max(1, positive.n)
    sp, su = (on_positive + corrected, on_unlabelled) if clean >= 0 else (-corrected, -on_unlabelled)
    spread = lambda bags, slopes: np.bincount(bags.at, slopes[bags.of], minlength=len(w))[: len(w)]
    return first, clean, np.append(spread(positive, sp) + spread(unlabelled, su), sp.sum() + su.sum())


def fit_bags(kept: np.ndarray, positive: Bags, unlabelled: Bags, prior: float, rounds: int = 400, rate: float = 0.1, sparse: float = 1e-4) -> PuModel:
    """Full-batch Adam on the non-negative risk, and soft thresholds that keep weights of no use at zero.

    Without confirmed documents nothing is flagged.
    """
    if not positive.n:
        return PuModel({}, -10.0, 0.0)
    w, b = np.zeros(len(kept)), math.log(prior / (1 - prior))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, rounds + 1):
        _, _, gradient = risk(w, b, positive, unlabelled, prior)
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse, 0)
        b -= step[-1]
    cut = best_cut(positive.margins(w, b), unlabelled.margins(w, b), prior)
    return PuModel({int(k): float(x) for k, x in zip(kept, w, strict=True) if x}, float(b), cut)


def bounded(prior: float) -> float:
    return min(max(prior, 1e-4), 0.9)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, keep: int = FEATURES) -> PuModel:
    """The model from the feature sets of few documents, as ``train`` makes it of tables."""
    prior = bounded(prior)
    found, p = np.unique(np.concatenate([*positive, np.zeros(0, np.int32)]), return_counts=True)
    seen, u = np.unique(np.concatenate([*unlabelled, np.zeros(0, np.int32)]), return_counts=True)
    place = np.minimum(np.searchsorted(seen, found), max(0, len(seen) - 1))
    also = np.where(seen[place] == found, u[place], 0) if len(seen) else np.zeros(len(found), np.int64)
    kept = choose_features(found, p, also, len(positive), len(unlabelled), prior, keep)
    bags = [[np.flatnonzero(np.isin(kept, r, assume_unique=True)) for r in rows] for rows in (positive, unlabelled)]
    return fit_bags(kept, *(Bags(np.concatenate([*x, np.zeros(0, np.int64)]), np.repeat(np.arange(len(x)), [len(y) for y in x]).astype(np.int64), len(x)) for x in bags), prior)


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The cut of largest F1, with precision estimated from the prior: recall * prior / share flagged."""
    places = np.unique(np.concatenate([positive, unlabelled]))
    middle = (places[1:] + places[:-1]) / 2 if len(places) > 1 else places
    recall = 1 - np.searchsorted(np.sort(positive), middle) / len(positive)
    flagged = 1 - np.searchsorted(np.sort(unlabelled), middle) / max(1, len(unlabelled))
    hit = np.minimum(prior * recall, flagged)
    f1 = 2 * hit / np.maximum(prior + flagged, 1e-9)
    return float(middle[int(np.argmax(f1))])


def sampled_features(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """(id, y, x): features of confirmed (y 1) and of unlabelled documents (y 0) of the training folds, and the class prior.

    The prior is the share of toxic ones among the labelled training documents. Ids of confirmed
    documents and of the unlabelled sample are chosen first, in bounded number, and broadcast; an id
    that several rows have counts once, with the smallest of their feature sets.
    """
    train = ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()
    known = labels.where(train & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_y"))
    stats = known.agg(F.count("*").alias("n"), F.sum("_y").alias("k")).first()
    prior = (stats["k"] or 0) / stats["n"] if stats["n"] else 0.0
    toxic = hash_sample(known.where("_y = 1"), positives, "_id", salt="toxic")
    ids = docs.where(train).select(F.col("doc_id").cast("long").alias("_id")).distinct()
    drawn = hash_sample(ids, unlabelled, "_id", salt="unlabelled").withColumn("_y", F.lit(0))
    chosen = toxic.unionByName(drawn)  # a confirmed document may also be drawn: unlabelled text holds the prior's share of them
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "text")

    def run(batches):
        for batch in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([document_features(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))], names=["id", "y", "x"])

    rows = source.mapInArrow(run, "id long, y int, x array<int>").groupBy("id", "y").agg(F.min("x").alias("x"))
    return materialise(rows, "toxicity-sample")[0], prior


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> PuModel:
    """The model for ``docs`` from at most about so many documents, and with at most so many weights.

    Features are counted and chosen by Spark; the driver gets the chosen ones, and then, for each document
    of the sample, which of them it has.
    """
    sample, prior = sampled_features(docs, labels, positives, unlabelled)
    prior = bounded(prior)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    counted = sample.select("y", F.explode("x").alias("f")).groupBy("f").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("u"))
    kept = chosen_features(counted, sizes.get(1, 0), sizes.get(0, 0), prior, features)

    def places(batches):
        for batch in batches:
            lists = batch.column(2)
            found, of = lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy()
            at = np.minimum(np.searchsorted(kept, found), max(0, len(kept) - 1))
            same = kept[at] == found if len(kept) else np.zeros(len(found), bool)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[same], minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[same].astype(np.int32)))], names=["id", "y", "x"])

    rows = sample.mapInArrow(places, "id long, y int, x array<int>").toArrow().sort_by([("y", "ascending"), ("id", "ascending")]).combine_chunks()

    def bags(label: int) -> Bags:
        lists = rows.filter(pc.equal(rows.column("y"), label)).column("x").combine_chunks()
        return Bags(lists.flatten().to_numpy().astype(np.int64), pc.list_parent_indices(lists).to_numpy().astype(np.int64), len(lists))

    return fit_bags(kept, bags(1), bags(0), prior)


def with_scores(docs: DataFrame, model: PuModel, name: str = "toxicity_score") -> DataFrame:
    """``docs`` with their whole texts' scores in column ``name``, which is replaced if it is there."""
    kept = [c for c in docs.columns if c != name]
    source = docs.select(*(f"`{c}`" for c in kept))
    at = kept.index("text")

    def run(batches):
        for batch in text_batches(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([model.score(t) for t in batch.column(at).to_pylist()], pa.float64())], names=[*kept, name])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts get the score of a text without features; texts of any length are read whole.
    Rows that repeat an id give a row each. A null id is in no fold that is held out and teaches nothing.
    Other columns, whatever their names, are ignored; an empty table gives an empty result, and without
    confirmed documents nothing is flagged.
    """
    model = train(docs, labels)
    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= FLAG).cast("int").alias("predicted"))
