"""Quality scores by Bradley-Terry ranking.

Each pair of a good and a poor labelled document is a comparison that the good one won. The score is
linear in features of the text, and logistic loss on the pairs' feature differences fits its weights.
A document is accepted if its score reaches a quantile of the labelled documents' scores, the share
of poor ones among them; scores are shown on a scale from 0 to 1 where that quantile is ACCEPT.

Every labelled document outside the held-out fold and every pair of them counts. A pair's loss depends on
the difference of two scores alone, so a document's sum over all of the other class is the other class's
histogram of scores, folded with the loss; no pair is made. Each Newton step passes twice over the rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import text_batches
from .places import keep, placed
from .shared import discard, materialise

ACCEPT = 0.7
#: Words of a window, rows of a block, labelled rows up to which the driver makes the passes over them itself.
SPAN, ROWS, GATHER = 32, 8_192, 65_536
#: Steps of the histograms of scores, for the loss and its gradient (whose error is below 1e-8) and for its curvature.
FINE, COARSE = 1 / 32, 1 / 4

_SYMBOLS = "#$%&*+<=>@[\\]^_`{|}~/"
_CLASSES = np.zeros(65_536, np.int8)
for _k in range(65_536):
    _c = chr(_k)
    _CLASSES[_k] = 1 if _c.isupper() else 2 if _c.isalpha() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c in _SYMBOLS else 6

NAMES = ("log_words", "word_length", "word_spread", "upper", "digits", "symbols", "marks", "symbol_words", "capital_words", "word_repeats", "pair_repeats", "top_word", "stutters", "line_repeats", "line_length", "worst_symbols", "worst_capitals", "worst_variety", "bad_spans", "entropy", "alpha_words", "long_words")


def features(text: str | None) -> list[float]:
    """Numbers that describe a text's form; all are 0 for a text without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    classes = np.bincount(_CLASSES[codes], minlength=7) / len(codes)
    used = np.bincount(codes & 0xFF, minlength=256)
    share = used[used > 0] / len(codes)
    lengths = np.fromiter(map(len, words), np.int64, n)
    symbol = np.fromiter((w[-1] in _SYMBOLS or w[-2:] == "!!" for w in words), bool, n)
    capital = np.fromiter((w.isupper() and len(w) > 1 for w in words), bool, n)
    alpha = sum(w.isalpha() or w[:-1].isalpha() for w in words) / n
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = text.split("\n")
    spans = np.arange(0, n, SPAN)
    size = np.minimum(SPAN, n - spans)
    s_span = np.add.reduceat(symbol, spans, dtype=np.int64) / size
    c_span = np.add.reduceat(capital, spans, dtype=np.int64) / size
    variety = np.array([len(set(words[k : k + SPAN])) for k in spans.tolist()]) / size
    whole = size >= min(n, SPAN // 2)  # a short last span tells little
    return [
        math.log1p(n), float(lengths.mean()), float(lengths.std()), classes[1], classes[3], classes[5], classes[6], float(symbol.mean()), float(capital.mean()),
        1 - len(counts) / n, 1 - pairs / max(1, n - 1), max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), math.log1p(len(text) / len(lines)),
        float(s_span[whole].max()), float(c_span[whole].max()), float(variety[whole].min()), float(((s_span > 0.3) | (c_span > 0.5) | (variety < 0.5))[whole].mean()),
        float(-(share * np.log2(share)).sum()), alpha, float((lengths > 20).mean()),
    ]


@dataclass(frozen=True)
class RankModel:
    """Weights of the scaled features, and the accepting quantile with the unit that scores are shown in."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    quantile: float
    unit: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (expand((x - self.centre) / self.scale) * self.weights).sum(1)  # unlike a product of matrices the same in any block

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, rising with the raw score, ACCEPT exactly at the quantile."""
        z = (self.raw(x) - self.quantile) / self.unit + math.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def expand(z: np.ndarray) -> np.ndarray:
    """Scaled features and their bent forms, so that the linear score can punish both ends of a range."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, np.abs(z), np.maximum(z - 2, 0), np.maximum(-z - 2, 0)], axis=1)


#: The sum, or what ``join`` makes, of a function's arrays over all blocks of rows x with labels y.
Over = Callable[..., np.ndarray]


def over_arrays(x: np.ndarray, y: np.ndarray) -> Over:
    def over(f: Callable, join: Callable = np.add) -> np.ndarray:
        return reduce(join, (f(x[k : k + ROWS], y[k : k + ROWS]) for k in range(0, max(1, len(y)), ROWS)))

    return over


def over_table(rows: DataFrame) -> Over:
    """Passes over rows (y, x): each task gives the driver one array."""

    def over(f: Callable, join: Callable = np.add) -> np.ndarray:
        def run(batches):
            total = None
            for batch in batches:
                x, y = matrix(batch.column(1)), batch.column(0).to_numpy()
                for k in range(0, len(y), ROWS):
                    part = f(x[k : k + ROWS], y[k : k + ROWS])
                    total = part if total is None else join(total, part)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

        found = rows.select("y", "x").mapInArrow(run, "v array<double>").toArrow().column(0)
        return reduce(join, (v.values.to_numpy() for v in found))

    return over


def matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy().reshape(len(x), len(NAMES))


def between(s: np.ndarray, step: float, half: int, cubic: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each score its nodes among those from -half to half steps, and their weights in cubic or linear interpolation."""
    at = np.floor(s / step)
    f = s / step - at
    shares = [-f * (f - 1) * (f - 2) / 6, (f + 1) * (f - 1) * (f - 2) / 2, -(f + 1) * f * (f - 2) / 2, (f + 1) * f * (f - 1) / 6] if cubic else [1 - f, f]
    return at.astype(np.int64)[:, None] + half + (np.arange(-1, 3) if cubic else np.arange(2)), np.stack(shares, axis=1)


def folded(shares: np.ndarray, kernel: Callable, step: float) -> np.ndarray:
    """At each node a the sum over nodes b of shares[b] * kernel(a's score less b's)."""
    n = len(shares)
    size = 1 << (3 * n).bit_length()
    line = np.fft.rfft(shares, size) * np.fft.rfft(kernel(np.arange(1 - n, n) * step), size)
    return np.fft.irfft(line, size)[n - 1 : 2 * n - 1]


def upset(t: np.ndarray) -> np.ndarray:
    """The chance that the good document of a pair loses, from how far its score lies above the other's."""
    return 1 / (1 + np.exp(np.clip(t, -35, 35)))


def all_pairs(over: Over, centre: np.ndarray, scale: np.ndarray, counts: np.ndarray, ridge: float) -> np.ndarray:
    """The weights of least mean loss over all pairs of a row of class 1 and one of class 0, by Newton steps.

    ``counts`` are the classes' rows. The curvature is that of scores on the coarse nodes, never negative.
    """
    caps = np.repeat([6.0, 6.0, 4.0, 4.0], len(NAMES))  # of the expanded features

    def state(w: np.ndarray):
        reach = float(np.abs(w) @ caps)  # no score lies beyond
        fine, coarse = max(FINE, reach / 2**15), max(COARSE, reach / 2**10)
        halves = [math.ceil(reach / step) + 2 for step in (fine, coarse)]

        def histograms(x, y):
            s, out = (expand((x - centre) / scale) * w).sum(1), []
            for step, half, cubic in ((fine, halves[0], True), (coarse, halves[1], False)):
                at, shares = between(s, step, half, cubic)
                out += [np.bincount(at[y == c].ravel(), shares[y == c].ravel(), 2 * half + 1) / counts[c] for c in (0, 1)]
            return np.concatenate(out)

        poor, good, poor_coarse, good_coarse = np.split(over(histograms), np.cumsum([2 * halves[0] + 1] * 2 + [2 * halves[1] + 1]))
        loss = float(good @ folded(poor, lambda t: np.logaddexp(0, -t), fine)) + ridge / 2 * float(w @ w)
        chance = folded(good, lambda t: upset(-t), fine), folded(poor, upset, fine)  # by class: of an upset against all of the other

        def steep(t):
            return upset(t) * upset(-t)

        bend = folded(good_coarse, steep, coarse), folded(poor_coarse, steep, coarse)
        used = np.flatnonzero(poor_coarse + good_coarse)
        first, nodes = int(used[0]), int(used[-1] - used[0]) + 1

        def slopes(x, y):
            z = expand((x - centre) / scale)
            s, n = (z * w).sum(1), len(w)
            gradient, curve, sums = np.zeros(n), np.zeros((n, n)), []
            for c in (0, 1):
                zc, sc = z[y == c], s[y == c]
                at, shares = between(sc, fine, halves[0], True)
                gradient += (1 - 2 * c) / counts[c] * ((chance[c][at] * shares).sum(1) @ zc)
                at, shares = between(sc, coarse, halves[1], False)
                curve += (zc * ((bend[c][at] * shares).sum(1) / counts[c])[:, None]).T @ zc
                spread = np.zeros((len(sc), nodes + 1))
                for k in (0, 1):
                    spread[np.arange(len(sc)), at[:, k] - first] += shares[:, k]
                sums.append(spread[:, :nodes].T @ zc / counts[c])
            return np.concatenate([gradient, curve.ravel(), *(a.ravel() for a in sums)])

        def newton():
            n = len(w)
            gradient, curve, low, high = np.split(over(slopes), np.cumsum([n, n * n, nodes * n]))
            t = np.arange(nodes) * coarse
            cross = low.reshape(nodes, n).T @ steep(t[:, None] - t) @ high.reshape(nodes, n)
            return np.linalg.solve(curve.reshape(n, n) - cross - cross.T + ridge * np.eye(n), gradient + ridge * w)

        return loss, newton

    w = np.zeros(len(caps))
    loss, newton = state(w)
    for _ in range(40):
        step = newton()
        if np.abs(step).max() < 1e-6:
            return w - step
        for k in range(12):  # a step that overshoots is halved
            tried, following = state(nearer := w - step / 2**k)
            if tried <= loss + 1e-9:
                break
        w, loss, newton = nearer, tried, following
    return w


def at_reach(over: Over, raw: Callable, targets: list[tuple[float, float, float]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each (weight of a row of class 0, of class 1, reach) the smallest score up to which the weights reach it,
    with the classes' rows below it and at it.

    Exact: the scores' bits are found from the highest on, 9 and then 11 in a pass.
    """
    prefix, below, at = np.zeros(len(targets), np.uint64), np.zeros((len(targets), 2)), np.zeros((len(targets), 2))
    top = np.uint64(1 << 63)
    for shift in (55, 44, 33, 22, 11, 0):

        def digits(x, y, shift=shift, prefix=prefix):
            bits = (raw(x) + 0.0).view(np.uint64)
            keys = np.where(bits & top, ~bits, bits | top)  # in the order of the scores
            out = np.zeros((len(prefix), 2, 2048))
            for k, wanted in enumerate(prefix):
                for c in (0, 1):
                    own = keys[y == c]
                    if shift < 55:
                        own = own[own >> np.uint64(shift + 11) == wanted]
                    out[k, c] = np.bincount((own >> np.uint64(shift) & np.uint64(2047)).astype(np.int64), minlength=2048)
            return out.ravel()

        counts = over(digits).reshape(len(targets), 2, 2048)
        found = []
        for k, (poor, good, reach) in enumerate(targets):
            passed = below[k][:, None] + np.cumsum(counts[k], axis=1)
            some = np.flatnonzero(counts[k].sum(0))
            enough = some[poor * passed[0, some] + good * passed[1, some] >= reach]
            found.append(int(enough[0] if len(enough) else some[-1]))
            at[k] = counts[k][:, found[-1]]
            below[k] = passed[:, found[-1]] - at[k]
        prefix = (prefix << np.uint64(9 if shift == 55 else 11)) | np.array(found, np.uint64)
    scores = np.where(prefix & top, prefix ^ top, ~prefix).view(np.float64)
    return list(zip(scores.tolist(), below, at, strict=True))


def quantile_and_unit(over: Over, raw: Callable, counts: np.ndarray, share: float) -> tuple[float, float]:
    """The middle of the two scores, poor rows first among equal ones, between which the classes' weights (share and
    1 - share) pass ``share``; an eighth of the distance of the 10th and the 90th percentile."""
    poor, good = share / counts[0], (1 - share) / counts[1]
    ranks = [(counts.sum() - 1) * q for q in (0.1, 0.9)]
    targets = [(1.0, 1.0, f(r) + 0.5) for r in ranks for f in (math.floor, math.ceil)]
    (score, below, at), *ends = at_reach(over, raw, [(poor, good, share - 1e-9), *targets])
    need = share - 1e-9 - poor * below[0] - good * below[1]
    last = need > poor * at[0] + good * (at[1] - 1) if at[1] else need > poor * (at[0] - 1)
    following = float(over(lambda x, y: np.array([np.min((s := raw(x))[s > score], initial=np.inf)]), np.minimum)[0]) if last else score
    low, high = (a[0] + (b[0] - a[0]) * (r - math.floor(r)) for a, b, r in zip(ends[::2], ends[1::2], ranks, strict=True))
    return (score + following) / 2 if math.isfinite(following) else score, max(1e-9, (high - low) / 8)


def fit_over(over: Over, poor_share: float | None = None, ridge: float = 1e-3, weigh: Callable | None = None) -> RankModel:
    """The model of all rows that ``over`` passes over; its weights are those of ``weigh(centre, scale)`` if given.

    Without both classes all weights are 0 and every document is accepted.
    """
    sums = over(lambda x, y: np.array([np.sum(y == 0), np.sum(y == 1), len(y), *x.sum(0)], float))
    counts, n = sums[:2], max(1.0, sums[2])
    centre = sums[3:] / n
    scale = np.sqrt(over(lambda x, y: ((x - centre) ** 2).sum(0)) / n) + 1e-6 if sums[2] else np.ones(len(NAMES))
    if not counts.all():
        return RankModel(centre, scale, np.zeros(4 * len(NAMES)), 0.0, 1.0)
    weights = weigh(centre, scale) if weigh else all_pairs(over, centre, scale, counts, ridge)
    # The rows may hold the classes in other shares than the labels do; weights set that right.
    share = counts[0] / counts.sum() if poor_share is None else poor_share
    return RankModel(centre, scale, weights, *quantile_and_unit(over, RankModel(centre, scale, weights, 0.0, 1.0).raw, counts, share))


def fit(x: np.ndarray, y: np.ndarray, poor_share: float | None = None, pairs: int | None = None, ridge: float = 1e-3, seed: int = 7) -> RankModel:
    """Bradley-Terry weights from rows x with labels y (1 wins against 0), by Newton steps, over all pairs or,
    if ``pairs`` is given, over so many drawn ones (``train`` never draws)."""

    def drawn(centre, scale):
        z = expand((x - centre) / scale)
        draw = np.random.default_rng(seed)
        d = z[draw.choice(np.flatnonzero(y == 1), pairs)] - z[draw.choice(np.flatnonzero(y == 0), pairs)]
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = upset(d @ w)
            gradient = -(p @ d) / pairs + ridge * w
            curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
            step = np.linalg.solve(curve, gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return w

    return fit_over(over_arrays(x, y), poor_share, ridge, drawn if pairs else None)


def held_out(key: Column) -> Column:
    """The fold that no label is learnt from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with the features of their whole texts, ``x``, in place of ``text``."""
    kept = [c for c in docs.columns if c != "text"]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in text_batches(batches):
            x = pa.array([features(t) for t in batch.column(len(kept)).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x], names=[*kept, "x"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def labelled_rows(described: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, float]:
    """(y, x) of every training document among ``described`` (doc_id, x), and the share of class 0 among all
    training labels.

    Ids, labels and features are shuffled, texts aren't. Labels other than 0 and 1 and null ids are passed over; an id
    with several labels counts with its largest, and an id that several rows have counts once, with the smallest
    of their features.
    """
    teaches = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    known = labels.where(F.col(label).isin(0, 1) & teaches).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = described.where(teaches).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("x").alias("x"))
    return rows.join(known, "_id").select("y", "x"), counts.get(0, 0) / max(1, sum(counts.values()))


def gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = rows.toArrow()
    y = found.column("y").to_numpy().astype(np.int64)
    x = np.concatenate([np.zeros((0, len(NAMES))), *map(matrix, found.column("x").chunks)])
    order = np.lexsort((*x.T, y))  # the same model whatever the order of tasks
    return x[order], y[order]


def labelled_features(docs: DataFrame, labels: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray, float]:
    """What ``labelled_rows`` gives, gathered: features, labels and the share, for as many documents as the driver can hold."""
    rows, share = labelled_rows(with_features(docs.select("doc_id", "text")), labels, label)
    return *gathered(rows), share


def train_described(described: DataFrame, labels: DataFrame) -> RankModel:
    """The model of all labelled rows of ``described`` (doc_id, x) outside the held-out fold. More than GATHER of them
    stay in a table, and tasks make the passes; the model is the same but for rounding."""
    rows, share = labelled_rows(described, labels, "quality")
    table, uri = materialise(rows, "quality-labelled")
    model = fit(*gathered(table), share) if table.count() <= GATHER else fit_over(over_table(table), share)
    discard(table.sparkSession, uri)
    return model


def train(docs: DataFrame, labels: DataFrame) -> RankModel:
    """The model for ``docs`` from all their labelled rows outside the held-out fold."""
    described, uri = materialise(with_features(docs.select("doc_id", "text")), "quality-features")
    model = train_described(described, labels)
    discard(docs.sparkSession, uri)
    return model


def with_scores(described: DataFrame, model: RankModel, name: str = "quality_score") -> DataFrame:
    """Rows with features ``x``, as ``with_features`` makes them, with their scores in column ``name`` instead."""
    kept = [c for c in described.columns if c != "x"]
    source = described.select(*(f"`{c}`" for c in kept), "x")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(matrix(batch.column(len(kept)))))], names=[*kept, name])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts are scored by their all-zero features; texts of any length are read whole, once: model and
    scores come from a table of features in the shared folder. Rows that repeat an id give a row each. A null id is in
    no fold that is held out and teaches nothing. Other columns, whatever their names, are ignored; an empty table gives
    an empty result, and without labels of both classes every document is accepted.
    """
    described, _ = materialise(with_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "quality-features")
    scored = with_scores(described, train_described(described, labels), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model accepts, with their columns as they were; nulls, empty and long texts,
    repeated rows and an empty table are as in ``score``."""
    own = placed(docs)
    narrow = own.rows.select("doc_id", "text", F.col(f"`{own.file}`").alias("file"), F.col(f"`{own.row}`").alias("row"))
    described, uri = materialise(with_features(narrow), "quality-features")
    scored = with_scores(described, train_described(described, labels), "score")
    kept = keep(own, scored.where(F.col("score") >= ACCEPT))
    discard(docs.sparkSession, uri)
    return kept
