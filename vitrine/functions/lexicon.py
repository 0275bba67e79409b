"""Brand aliases, product types and stop words, and how runs of a name's words are resolved by them.

A dictionary is a table, of any size: (alias, brand_id, ord) for brands, (phrase) for types. Runs of
words are joined with it, so Spark broadcasts it while it is small and shuffles it when it isn't.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as t

#: Words that carry no meaning in a product name.
STOP_WORDS = (
    "مدل", "شماره", "حجم", "رنگ", "نوع", "سری", "مناسب", "برای", "حاوی", "با", "فاقد", "بدون", "و", "از", "در", "به",
    "های", "ها", "ی", "رایحه", "عطر", "بوی", "سبک", "تیپ", "کد", "ضد", "وزن", "سایز", "زنانه", "مردانه", "زن", "مرد",
    "دارای", "مخصوص", "عصاره", "انواع", "تیوپی", "شیشه", "شیشه ای", "کاسه", "کاسه ای", "پمپی", "استیکی", "ماژیکی",
    "اورجینال", "اصل", "ساعته",
)



@dataclass(frozen=True)
class Lexicon:
    """Aliases in order (of equal ones the last counts), types and stop words."""

    brands: tuple[tuple[str, str], ...] = ()
    types: tuple[str, ...] = ()
    stops: tuple[str, ...] = STOP_WORDS

    def frame(self, spark: SparkSession) -> DataFrame:
        """(alias, brand_id, ord)."""
        return spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(self.brands)], "alias string, brand_id string, ord long")

    def type_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(x,) for x in self.types], "phrase string")


def last_wins(dictionary: DataFrame) -> DataFrame:
    """(alias, brand_id): of the rows of an alias that with the largest ``ord``."""
    return dictionary.groupBy("alias").agg(F.max_by("brand_id", "ord").alias("brand_id"))


def load_lexicon(dictionary: DataFrame, types: DataFrame, stops: tuple[str, ...] = STOP_WORDS, most_bytes: int = 64 << 20) -> Lexicon:
    """A lexicon from tables (alias, brand_id, ord) and (phrase), for functions that carry it to every worker.

    It must not take more than ``most_bytes``; larger dictionaries stay tables, as ``names.features`` uses them.
    """
    size = lambda *columns: sum((F.octet_length(F.coalesce(c, F.lit(""))) + 64 for c in columns), F.lit(0))
    taken = sum(f.agg(F.coalesce(F.sum(size(*f.columns[:2])), F.lit(0))).first()[0] for f in (dictionary.select("alias", "brand_id"), types.select("phrase")))
    if taken > most_bytes:
        raise ValueError(f"a lexicon of {taken} bytes isn't broadcast")
    return Lexicon(tuple((r.alias, r.brand_id) for r in dictionary.orderBy("ord").collect()), tuple(r.phrase for r in types.collect()), stops)


# -- phrases that stand for something, in the three parsers' spellings -----------------------------


def _spelt(c: Column) -> Column:
    return F.array_join(t.tokens(c), " ")


def trie_phrases(brands: DataFrame, types: DataFrame) -> DataFrame:
    """(alias, id): lower-case words of aliases and types; a type takes a clashing alias's place."""
    named = brands.select(_spelt(F.lower("alias")).alias("alias"), F.lower("brand_id").alias("id"), F.lit(0).alias("rank"), "ord")
    kinds = types.select(_spelt(F.lower("phrase")).alias("alias"), F.lower(F.concat(F.lit("type_"), F.replace("phrase", F.lit(" "), F.lit("_")))).alias("id"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("ord"))
    both = named.unionByName(kinds).where("alias <> ''")
    return both.groupBy("alias").agg(F.max_by("id", F.struct("rank", "ord", "id")).alias("id"))


def slot_phrases(brands: DataFrame) -> DataFrame:
    """(alias, id): aliases of one or two words as they are spelt; longer ones are out of this parser's reach."""
    return last_wins(brands).select("alias", F.col("brand_id").alias("id")).where(F.size(F.split("alias", " ")) <= 2)


def regex_phrases(brands: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias, id) of brands and, for the second pass, of types, cleaned as names are."""
    named = brands.select(t.base_clean(F.col("alias")).alias("alias"), F.col("brand_id").alias("id"), "ord")
    kinds = types.select(t.base_clean(F.col("phrase")).alias("alias"), F.concat(F.lit("TYPE_"), F.upper(F.replace("phrase", F.lit(" "), F.lit("_")))).alias("id"))
    return named.where("alias <> ''").groupBy("alias").agg(F.max_by("id", F.struct("ord", "id")).alias("id")), kinds.where("alias <> ''").groupBy("alias").agg(F.max("id").alias("id"))


def segments(c: Column) -> Column:
    """A text as runs of word characters and single other characters, whose concatenation it is."""
    return F.regexp_extract_all(c, F.lit(f"{t.W}+|(?s:.)"), F.lit(0))


# -- runs of words ---------------------------------------------------------------------------------


def longest_run(phrases: DataFrame, pieces: Column) -> int:
    """The most pieces that a phrase has."""
    return phrases.agg(F.max(F.size(pieces))).first()[0] or 0


@dataclass(frozen=True)
class Pass:
    """One way to resolve the array column ``words``: runs of one to ``most`` words, joined by ``separator`` (and in
    lower case with ``fold``), that are phrases (alias, id) give the column ``out``."""

    words: str
    phrases: DataFrame
    most: int
    separator: str = " "
    out: str = "resolved"
    fold: bool = False


_ITEM = "array<struct<word:string,hit:boolean>>"


def _runs(one: Pass, number: int) -> Column:
    """The runs of a pass that may be phrases: struct(pass, p, n, alias)."""
    words, size = F.col(one.words), F.size(one.words)
    kind = "array<struct<pass:int,p:int,n:int,alias:string>>"
    shown = (lambda c: F.lower(c)) if one.fold else (lambda c: c)
    run = lambda p, n: F.struct(F.lit(number).alias("pass"), p.alias("p"), n.alias("n"), shown(F.array_join(F.slice(words, p + 1, n), one.separator)).alias("alias"))
    of_size = lambda n: F.when(n <= size, F.transform(F.sequence(F.lit(0), size - n), lambda p: run(p, n))).otherwise(F.array().cast(kind))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max(1, one.most))), of_size))
    if one.separator == "":  # a phrase with other characters at its ends may stand beside a word character
        word = lambda at: F.coalesce(F.get(words, at).rlike(f"^{t.W}"), F.lit(False))
        runs = F.filter(runs, lambda r: ~word(r["p"] - 1) & ~word(r["p"] + r["n"]))
    return runs


def _walked(one: Pass, number: int, hits: Column) -> Column:
    """Words from left to right, the longest phrase at each place put for its words."""
    found = F.filter(hits, lambda h: h["pass"] == number)
    item = lambda word, hit: F.array(F.struct(word.alias("word"), F.lit(hit).alias("hit")))

    def step(state: Column, x: Column) -> Column:
        best = F.array_max(F.transform(F.filter(state["found"], lambda h: h["p"] == x["p"]), lambda h: F.struct(h["n"].alias("n"), h["id"].alias("id"))))
        taken = F.struct((x["p"] + best["n"]).alias("next"), F.concat(state["out"], item(best["id"], True)).alias("out"), state["found"].alias("found"))
        left = F.struct((x["p"] + 1).alias("next"), F.concat(state["out"], item(x["w"], False)).alias("out"), state["found"].alias("found"))
        return F.when(x["p"] < state["next"], state).when(best.isNotNull(), taken).otherwise(left)

    start = F.struct(F.lit(0).alias("next"), F.array().cast(_ITEM).alias("out"), found.alias("found"))
    placed = F.transform(F.col(one.words), lambda w, p: F.struct(w.alias("w"), p.alias("p")))
    plain = F.transform(F.col(one.words), lambda w: F.struct(w.alias("word"), F.lit(False).alias("hit"))).cast(_ITEM)
    return F.when(hits.isNull(), plain).otherwise(F.aggregate(placed, start, step, lambda state: state["out"]))


def resolve(names: DataFrame, key: str, *passes: Pass) -> DataFrame:
    """``names`` with the column ``out`` of each pass: array of struct(word, hit), in which leftmost-longest runs
    that are phrases are replaced by their ids.

    The runs of all passes meet their tables in one join; ``key`` must be unique. Where words are segments of
    a text (separator ""), runs begin and end where no word character adjoins.
    """
    grams = F.flatten(F.array(*(_runs(one, k) for k, one in enumerate(passes))))
    tables = [one.phrases.select(F.lit(k).alias("pass"), "alias", "id") for k, one in enumerate(passes)]
    known = tables[0]
    for table in tables[1:]:
        known = known.unionByName(table)
    spread = names.select(key, F.explode(grams).alias("g")).select(key, "g.*")
    hits = spread.join(known, ["pass", "alias"]).groupBy(key).agg(F.collect_list(F.struct("pass", "p", "n", "id")).alias("_hits"))
    joined = names.join(hits, key, "left")
    return joined.withColumns({one.out: _walked(one, k, F.col("_hits")) for k, one in enumerate(passes)}).drop("_hits")


def longest_matches(names: DataFrame, dictionary: DataFrame, key: str, words: str) -> DataFrame:
    """``names`` with column ``resolved``: leftmost-longest dictionary phrases in the array ``words`` replaced by their ids.

    A row without words resolves to an empty array; ``key`` must be unique. Phrases compare in lower case.
    """
    phrases = last_wins(dictionary.select(_spelt(F.lower("alias")).alias("alias"), "brand_id", "ord")).withColumnRenamed("brand_id", "id")
    found = resolve(names, key, Pass(words, phrases, longest_run(phrases, F.split("alias", " ")), fold=True))
    return found.withColumn("resolved", F.transform("resolved", lambda x: x["word"]))
