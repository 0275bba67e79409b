"""String ratios, as Column functions for names and as plain functions for Arrow batches.

ratio = 100 * 2 * LCS / (both lengths), rounded; token_sort compares the sorted words, token_set the
common words with what each side has beside them. Assumed of the conventional library that these
follow: words are lower-cased runs of word characters with `_` among them, results are rounded to
whole numbers with ties to even, two empty strings have ratio 100 and no words token_set 0.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- plain functions -------------------------------------------------------------------------------


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time as bits of one number."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & where.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def raw_ratio(a: str, b: str) -> float:
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def ratio(a: str, b: str) -> int:
    return round(raw_ratio(a, b))


_NOT_WORD = re.compile(r"(?ui)\W")


def processed(text: str) -> str:
    return _NOT_WORD.sub(" ", text).lower().strip()


def token_sort_ratio(a: str, b: str) -> int:
    return ratio(*(" ".join(sorted(processed(x).split())) for x in (a, b)))


def token_set_ratio(a: str, b: str) -> int:
    left, right = (set(processed(x).split()) for x in (a, b))
    if not left or not right:
        return 0
    common, only_a, only_b = left & right, sorted(left - right), sorted(right - left)
    if common and not (only_a and only_b):
        return 100
    both = " ".join(sorted(common))
    rest_a, rest_b = " ".join(only_a), " ".join(only_b)
    head = len(both) + 1 if both else 0
    size_a, size_b = head + len(rest_a), head + len(rest_b)
    apart = len(rest_a) + len(rest_b) - 2 * lcs_length(rest_a, rest_b)
    best = 100.0 * (1 - apart / (size_a + size_b))
    if both:  # the common words against each whole side differ in that side's rest alone
        best = max(best, *(100.0 * (1 - (n - len(both)) / (n + len(both))) for n in (size_a, size_b)))
    return round(best)


@lru_cache(maxsize=1 << 16)
def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance with unit costs."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


# -- columns ---------------------------------------------------------------------------------------


def lcs(a: Column, b: Column) -> Column:
    """Longest common subsequence of two short strings.

    ``ends[k]`` is where the shortest beginning of ``b`` ends that has a common subsequence of k + 1
    characters with ``a`` so far; each character moves the ends to its next places and may add one.
    """
    far = 1 << 30
    after = lambda ends, k, c: F.pmod(F.position(c, b, F.coalesce(F.get(ends, k), F.lit(0)) + 1) - 1, F.lit(far)) + 1

    def step(ends: Column, c: Column) -> Column:
        moved = F.transform(ends, lambda e, k: F.least(e, after(ends, k - 1, c)))
        return F.concat(moved, F.filter(F.array(after(ends, F.size(ends) - 1, c)), lambda e: e < far))

    letters = F.filter(F.split(a, ""), lambda c: c != "")
    return F.size(F.aggregate(letters, F.array().cast("array<int>"), step))


def ratio_column(a: Column, b: Column) -> Column:
    size = F.length(a) + F.length(b)
    return F.when(size == 0, F.lit(100)).otherwise(F.bround(200 * lcs(a, b) / size, 0).cast("int"))


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]", " "))), " +"), lambda w: w != "")


def token_sort_column(a: Column, b: Column) -> Column:
    return ratio_column(*(F.array_join(F.array_sort(words(x)), " ") for x in (a, b)))


def token_set_column(a: Column, b: Column) -> Column:
    left, right = F.array_distinct(words(a)), F.array_distinct(words(b))
    common = F.array_join(F.array_sort(F.array_intersect(left, right)), " ")
    rest_a, rest_b = (F.array_join(F.array_sort(F.array_except(x, y)), " ") for x, y in ((left, right), (right, left)))
    head = F.when(common != "", F.length(common) + 1).otherwise(0)
    size_a, size_b = head + F.length(rest_a), head + F.length(rest_b)
    apart = F.length(rest_a) + F.length(rest_b) - 2 * lcs(rest_a, rest_b)
    between = 100 * (1 - apart / (size_a + size_b))
    against = lambda n: 100 * (1 - (n - F.length(common)) / (n + F.length(common)))
    best = F.when(common == "", between).otherwise(F.greatest(between, against(size_a), against(size_b)))
    inside = (common != "") & ((rest_a == "") | (rest_b == ""))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0).when(inside, 100).otherwise(F.bround(best, 0).cast("int"))


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def multiset_matches(a: Column, b: Column) -> Column:
    """Tokens of ``a`` that find a token of ``b`` of their own."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(count(a, t), count(b, t)))


def greedy_pairs(wanted: Column, offered: Column, least: float = 0.8) -> Column:
    """Pairs made greedily: each wanted token in turn takes the most similar token left, the first of
    equals, if the similarity is at least ``least``."""
    start = F.struct(F.transform(offered, lambda y, i: F.struct(i.alias("i"), y.alias("y"))).alias("left"), F.lit(0).alias("n"))

    def step(state: Column, x: Column) -> Column:
        rated = F.transform(state["left"], lambda o: F.struct(edit_similarity(x, o["y"]).alias("sim"), (-o["i"]).alias("first")))
        best = F.array_max(rated)
        hit = F.coalesce(best["sim"] >= least, F.lit(False))
        left = F.when(hit, F.filter(state["left"], lambda o: o["i"] != -best["first"])).otherwise(state["left"])
        return F.struct(left.alias("left"), (state["n"] + hit.cast("int")).alias("n"))

    return F.aggregate(wanted, start, step, lambda s: s["n"])
