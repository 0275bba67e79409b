"""Secret scans with DataFrame functions alone.

Three base patterns find assigned, access-key and hexadecimal secrets. Beside them, two character
Markov models, one of random strings and one of ordinary identifiers, are trained from labelled
samples, and long words whose log-likelihood ratio is in favour of the random model are added.

Positions come from the pieces between matches: split() and regexp_extract_all() walk a text in the
same way, so each match begins behind all pieces and matches before it. These sums are made by
doubling steps over the array, without moving rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in their order, patterns, the group whose length counts, least lengths.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: Words that the Markov models judge, and how clear (in nats a character) their ratio must be.
WORD, WORD_LEAST = r"[A-Za-z0-9+/_-]{16,}", 16
CLEAR = 0.5
#: Characters that the models tell apart: ASCII codes; the start of a word has code 0.
CODES = 128
#: How many random strings are generated; identifiers are taken from all documents.
RANDOM_STRINGS = 20_000
MASK = "[SECRET]"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# -- Markov models ---------------------------------------------------------------------------------


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """(value, label 1): hexadecimal, base64 and upper-case strings made from hashes of numbers."""
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    packed = F.translate(F.base64(F.unhex(digest)), "\r\n=", "")
    forms = F.array(F.substring(digest, 1, 40), packed, F.translate(packed, "+/", "-_"), F.upper(F.translate(packed, "+/", "XY")))
    return spark.range(n).select(F.element_at(forms, (F.col("id") % 4 + 1).cast("int")).alias("value"), F.lit(1).alias("label"))


def neighbours(docs: DataFrame) -> DataFrame:
    """(k, a, b): each word of all documents with its place and the next word, null behind the last."""
    words = docs.select(F.regexp_extract_all(text_of(), F.lit(r"\b[A-Za-z]{3,15}\b"), F.lit(0)).alias("a"))
    pairs = words.select("a", F.slice("a", F.lit(2), F.size("a")).alias("b")).select(F.arrays_zip("a", "b").alias("p"))
    return pairs.select(F.posexplode("p").alias("k", "p")).select("k", "p.a", "p.b")


def ordinary_identifiers(docs: DataFrame) -> DataFrame:
    """(value, label 0): words, and names joined from neighbouring words (the last with itself), of all documents."""
    rows = neighbours(docs).withColumn("b", F.coalesce("b", "a"))
    joined = F.array(F.col("a"), F.concat_ws("_", F.lower("a"), F.lower("b")), F.concat(F.lower("a"), F.initcap("b")), F.concat_ws("-", "a", "b"), F.concat_ws("/", F.lower("a"), F.lower("b")), F.upper(F.concat_ws("_", "a", "b")))
    return rows.select(F.element_at(joined, (F.col("k") % 6 + 1).cast("int")).alias("value"), F.lit(0).alias("label"))


def identifier_parts(docs: DataFrame) -> DataFrame:
    """(value, inner, n, label 0): the transitions of the values of ``ordinary_identifiers``, counted.

    Words are counted by their pairs of letters, by the form they are joined in and by where the pair
    stands, so the aggregate has a bounded number of keys however many words there are; what the forms
    make of a pair is worked out on the counts. An ``inner`` value's first character is the one before.
    """
    size, at = F.length("a"), F.col("i")
    last = F.coalesce("b", "a")
    rows = neighbours(docs).select((F.col("k") % 6).alias("form"), (F.col("k") == 0).alias("first"), F.col("b").isNull().alias("end"), "a", last.alias("b"), F.explode(F.sequence(F.lit(0), size)).alias("i"))
    pair = F.when(at == 0, F.left("a", F.lit(1))).when(at == size, F.concat(F.right("a", F.lit(1)), F.left("b", F.lit(1)))).otherwise(F.substring(F.col("a"), at, F.lit(2)))
    kind = F.when(at == 0, "start").when(at == size, "joint").when(at == 1, "head").otherwise("body")
    counted = rows.groupBy("form", "first", "end", kind.alias("kind"), pair.alias("pair")).agg(F.count("*").alias("n"))
    form, low, high = F.col("form"), F.lower("pair"), F.upper("pair")
    as_first = F.when(form.isin(0, 3), F.col("pair")).when(form == 5, high).otherwise(low)
    x, y = (lambda c: F.left(c, F.lit(1))), (lambda c: F.right(c, F.lit(1)))

    def as_second(of: Column) -> Column:
        capital = F.when(F.col("kind") == "head", F.concat(x(high), y(low))).otherwise(low)
        return F.when(of.isin(1, 4), low).when(of == 2, capital).when(of == 3, F.col("pair")).when(of == 5, high)

    inside = F.col("kind").isin("head", "body")
    mark = F.when(form.isin(1, 5), "_").when(form == 3, "-").when(form == 4, "/")  # none joins form 2, and form 0 is one word
    values = (
        (F.when(F.col("kind") == "start", as_first), False), (F.when(inside, as_first), True),
        (F.when(inside & ~F.col("first"), as_second((form + 5) % 6)), True), (F.when(inside & F.col("end"), as_second(form)), True),
        (F.when((F.col("kind") == "joint") & (form == 2), F.concat(x(low), y(high))), True),
        (F.when(F.col("kind") == "joint", F.concat(x(as_first), mark)), True), (F.when(F.col("kind") == "joint", F.concat(mark, y(as_first))), True),
    )
    parts = F.array(*(F.struct(v.alias("value"), F.lit(inner).alias("inner"), F.col("n")) for v, inner in values))
    return counted.select(F.inline(parts)).where(F.col("value").isNotNull()).groupBy("value", "inner").agg(F.sum("n").alias("n")).withColumn("label", F.lit(0))


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratios (random over ordinary) of a character after another, by CODES * first + second."""

    ratios: tuple[float, ...]

    def column(self) -> Column:
        """One constant, folded when the plan is optimised."""
        return F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")


def train(samples: DataFrame, prior: float = 0.5) -> MarkovPair:
    """First-order models of both classes from rows (value, label): 1 random, 0 ordinary.

    A column ``n`` tells how often a value counts, ``inner`` whether it is a part as in ``identifier_parts``.
    Transitions are counted by Spark; the driver gets at most 2 * CODES * CODES counts. Add-``prior``
    smoothing over the characters either class uses covers what was not seen; a class without
    samples is uniform. Characters beyond ASCII end the value's part that counts.
    """
    value = F.coalesce(F.col("value").cast("string"), F.lit(""))
    times = F.col("n") if "n" in samples.columns else F.lit(1)
    inner = F.col("inner") if "inner" in samples.columns else F.lit(False)
    begin = F.when(inner, F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    codes = F.concat(begin, F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c)))
    steps = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counted = samples.where(value != "").select("label", times.cast("long").alias("n"), F.explode(steps).alias("s")).where(F.col("s.a").between(0, CODES - 1) & F.col("s.b").between(1, CODES - 1) & F.col("label").isin(0, 1))
    counts = {(r["label"], r["a"], r["b"]): r["n"] for r in counted.groupBy("label", "s.a", "s.b").agg(F.sum("n").alias("n")).collect()}
    letters = max(1, len({b for _, _, b in counts}))
    totals: dict[tuple[int, int], int] = {}
    for (label, a, _), n in counts.items():
        totals[label, a] = totals.get((label, a), 0) + n
    log = lambda label, a, b: math.log((counts.get((label, a, b), 0) + prior) / (totals.get((label, a), 0) + prior * letters))
    return MarkovPair(tuple(round(log(1, a, b) - log(0, a, b), 6) for a in range(CODES) for b in range(CODES)))


def ratio(word: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of an ASCII word's characters."""
    codes = F.concat(F.array(F.lit(0)), F.transform(F.split(word, ""), lambda c: F.ascii(c)))
    # split(word, "") of a word of n characters may end in an empty string, of code 0: it adds nothing.
    steps = F.zip_with(F.slice(codes, F.lit(1), F.length(word)), F.slice(codes, F.lit(2), F.length(word)), lambda a, b: F.element_at(table, a * CODES + b + 1))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.length(word)


# -- spans -----------------------------------------------------------------------------------------


def running_sums(values: Column) -> Column:
    """Sums of an array up to and with each place, in as many passes as its size has binary digits."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(values))
    return F.aggregate(steps, values, lambda sums, d: F.transform(sums, lambda x, i: x + F.when(i >= d, F.get(sums, i - d)).otherwise(F.lit(0))))


SPAN = "struct<start:int,rank:int,end:int,kind:string,keep:boolean,value:string>"


def _spans(found: Column, ends: Column, counted: Column, kind: str, rank: int, least: int) -> Column:
    span = lambda m, k: F.struct((F.get(ends, k) - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.get(ends, k).alias("end"), F.lit(kind).alias("kind"), (F.get(counted, k) >= least).alias("keep"), m.alias("value"))
    return F.filter(F.transform(found, span), lambda s: s["keep"])


def with_spans(rows: DataFrame, text: str, patterns: dict[str, tuple[str, int, int]], name) -> DataFrame:
    """``rows`` with a column ``name(kind)`` for each kind: array of its matches' spans, in order.

    A pattern comes with the group whose length counts and the least length; shorter matches are left
    out. Columns are made step by step, since an expression that stands in several places, or in a
    function of array items, is evaluated each time. Texts without a match cost one pass of the pattern.
    """
    part = lambda kind, what: f"{name(kind)}_{what}"
    none = F.array().cast("array<int>")
    rows = rows.withColumns({part(k, "found"): F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for k, (p, _, _) in patterns.items()})
    steps = {}
    for kind, (pattern, group, _) in patterns.items():
        found = F.col(part(kind, "found"))
        lengths = F.transform(found, lambda m: F.length(m))
        # From the end of a match to the end of the next: the piece between them and the match.
        paired = F.zip_with(F.slice(F.split(F.col(text), pattern), F.lit(1), F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
        counted = lengths if group == 0 else F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)), lambda g: F.length(g))
        steps[part(kind, "steps")] = F.when(F.size(found) > 0, paired).otherwise(none)
        steps[part(kind, "counted")] = F.when(F.size(found) > 0, counted).otherwise(none)
    rows = rows.withColumns(steps)
    rows = rows.withColumns({part(k, "ends"): running_sums(F.col(part(k, "steps"))) for k in patterns})
    made = {}
    for rank, (kind, (_, _, least)) in enumerate(patterns.items()):
        found, ends, counted = (F.col(part(kind, x)) for x in ("found", "ends", "counted"))
        made[name(kind)] = _spans(found, ends, counted, kind, rank, least)
    return rows.withColumns(made).drop(*(part(k, x) for k in patterns for x in ("found", "steps", "counted", "ends")))


def outside(word: Column, base: Column) -> Column:
    """The parts of a word's span, of WORD_LEAST or more characters, that no span of ``base`` covers; ``base`` is in order."""
    touching = F.filter(base, lambda s: (s["start"] < word["end"]) & (word["start"] < s["end"]))
    part = lambda a, b: F.struct(a.alias("start"), word["rank"].alias("rank"), b.alias("end"), word["kind"].alias("kind"), word["keep"].alias("keep"), F.substring(word["value"], a - word["start"] + 1, b - a).alias("value"))
    grown = lambda acc, b: F.when(b - acc["at"] >= WORD_LEAST, F.concat(acc["parts"], F.array(part(acc["at"], b)))).otherwise(acc["parts"])
    begin = F.struct(word["start"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("parts"))
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), grown(acc, s["start"]).alias("parts"))
    return F.aggregate(touching, begin, step, lambda acc: grown(acc, word["end"]))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: MarkovPair, clear: float = CLEAR) -> DataFrame:
    """``docs`` with column ``secrets``: array of spans (start, rank, end, kind, keep, value), by start and kind.

    Places are code points, ends exclusive. Base kinds come as the patterns say; kind ``markov`` holds
    words, or what base spans leave of them, of WORD_LEAST or more characters whose mean ratio is at least ``clear``. Null and empty texts have no
    spans. A column named secrets in ``docs`` is replaced; all others pass unchanged.
    """
    columns = [c for c in docs.columns if c != "secrets"]
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    text, base, words = (prefix + x for x in ("text", "base", "words"))
    rows = docs.select(*(f"`{c}`" for c in columns), text_of().alias(text))
    patterns = dict(KINDS)
    # Asked for at once, the least length spares all short matches: a run of digits is matched whole
    # either way, and a run too short for its first AKIA is so for each later one.
    patterns["hex"] = (r"[0-9a-f]{16,}", 0, 16)
    patterns["access"] = (r"AKIA[A-Z0-9]{14,}", 0, 18)
    patterns["markov"] = (WORD, 0, WORD_LEAST)
    rows = with_spans(rows, text, patterns, lambda kind: f"{base}_{kind}")
    rows = rows.withColumn(base, F.array_sort(F.concat(*(F.col(f"{base}_{kind}") for kind in KINDS))))
    found = F.col(f"{base}_markov")
    rows = rows.withColumn(words, F.when(F.size(base) == 0, found).otherwise(F.flatten(F.transform(found, lambda w: outside(w, F.col(base))))))
    table = model.column()
    added = F.filter(F.col(words), lambda w: ratio(w["value"], table) >= clear)
    return rows.select(*(f"`{c}`" for c in columns), F.array_sort(F.concat(F.col(base), added)).alias("secrets"))


def default_model(docs: DataFrame) -> MarkovPair:
    """A model from generated random strings and the identifiers of all ``docs``."""
    generated = random_strings(docs.sparkSession).withColumns({"inner": F.lit(False), "n": F.lit(1).cast("long")})
    return train(generated.unionByName(identifier_parts(docs)))


def report(docs: DataFrame, model: MarkovPair | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``.

    Null and empty texts have no spans; texts of any length are searched whole; spans that begin at one place
    are listed by kind. Repeated rows give a row each, a null doc_id stays null, other columns, whatever their
    names, are ignored, and an empty table gives an empty result.
    """
    model = model or default_model(docs)
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["rank"] < len(KINDS))
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, model: MarkovPair | None = None, mask: str = MASK) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mask`` and n_chars, if it is there, brought up to date.

    Overlapping spans are replaced together. Documents without secrets are unchanged, null texts stay null.
    """
    columns = docs.columns
    rows = scan(docs, model or default_model(docs))
    text, spans = F.col("text").cast("string"), F.col("secrets")
    # Walk the spans by start: keep the text up to a span that begins behind all before it, with a mask there.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))).otherwise(acc["parts"]).alias("parts"))
    walked = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    rows = rows.withColumn("text", F.when(F.size(spans) > 0, walked).otherwise(text))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rows.select(*(f"`{c}`" for c in columns))
