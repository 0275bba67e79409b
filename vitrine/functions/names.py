"""Three independent parsers and scorers of product names, as DataFrame expressions.

``features`` parses each distinct name once, with the dictionaries as tables; ``scored`` joins the
features to pairs of names and rates them. A pair that a gate refuses costs no string ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuzzy, lexicon
from . import text as t

#: Spelt-out shade letters and what they stand for; a code is one of these before a number, letters
#: before a number, or both in one word.
SPELT_CODES = (("اس پی اف", "SPF"), ("ان سی", "NC"), ("ام", "M"))
CODE_WORDS = r"(?:(?:اس پی اف|ان سی|ام) [\p{Nd}¹²³⁰⁴-⁹₀-₉]+|[A-Z]+ [0-9]+[A-Z]*|[A-Z]{0,4}[0-9]+[A-Z]{0,4})"
#: Weights of brand, type, model, code, volume, and caps where one of them clashes.
WEIGHTS = (0.20, 0.15, 0.35, 0.20, 0.10)
CODE_CAP, VOLUME_CAP, BRAND_CAP, TYPE_CAP, TYPE_LEAST = 0.25, 0.30, 0.35, 0.40, 0.50
#: Least ratios of Latin and of Persian words, and the least length of a word that may differ.
LATIN_LEAST, FARSI_LEAST, NEAR_LENGTH = 88, 85, 5
#: Substitutions in a name whose brands and types are resolved, in their order.
SPELLINGS = (
    (r"(?<![\p{L}\p{N}_])ان[\s\p{Z}]*سی(?![\p{L}\p{N}_])", "nc"),
    (r"(?<![\p{L}\p{N}_])ام(?![\p{L}\p{N}_])", "m"),
    (t.REGEX_ML, "$1ml"),
    (t.REGEX_G, "$1g"),
    (r"(?U)(?<![\p{L}\p{N}_])([a-z]+)\s+(\d+)(?![\p{L}\p{N}_])", "$1$2"),
)
#: Brands, types, volumes, codes and Latin words in such a name.
ENTITY_BRAND = r"(?<![\p{L}\p{N}_])(BRAND_[A-Z0-9_]+)(?![\p{L}\p{N}_])"
ENTITY_TYPE = r"(?iu)(?<![\p{L}\p{N}_])(TYPE_[A-Z0-9_آ-ی]+)(?![\p{L}\p{N}_])"
VOLUME = r"(?<![\p{L}\p{N}_])(\p{Nd}+(?:ml|g))(?![\p{L}\p{N}_])"
MIXED_CODE = r"(?<![\p{L}\p{N}_])([a-z]+\p{Nd}+)(?![\p{L}\p{N}_])"
LONE_CODE = r"(?<![\p{L}\p{N}_])(\p{Nd}{2,4})(?![\p{L}\p{N}_])"
NAMED_CODE = r"(?<![\p{L}\p{N}_])(?:شماره|no)[\s\p{Z}]*(\p{Nd}{1})(?![\p{L}\p{N}_])"
LATIN = r"(?<![\p{L}\p{N}_])([a-z]+)(?![\p{L}\p{N}_])"


def without(words: Column, stops: tuple[str, ...]) -> Column:
    """Words that are no stop words; stop words of several words match none."""
    return F.filter(words, lambda w: ~w.isin(*stops)) if stops else words


def _words(resolved: str) -> Column:
    return F.transform(resolved, lambda x: x["word"])


# -- features of a name ----------------------------------------------------------------------------


def trie_words(name: Column) -> Column:
    return t.tokens(t.standard_units(t.base_clean(name)))


def trie_struct(resolved: str, stops: tuple[str, ...]) -> Column:
    """struct(tokens, brands, types, measures, codes, latin, farsi) of resolved words."""
    words = without(_words(resolved), tuple(x.lower() for x in stops))
    begins = lambda prefix: F.array_distinct(F.filter(words, lambda w: w.startswith(prefix)))
    return F.struct(words.alias("tokens"), begins("brand_").alias("brands"), begins("type_").alias("types"), t.measure_tokens(words).alias("measures"), t.code_tokens(words).alias("codes"), t.word_tokens(words).alias("latin"), t.persian_tokens(words).alias("farsi"))


def slot_words(cleaned: Column, stops: tuple[str, ...]) -> Column:
    return without(t.tokens(t.cut_volume(cleaned)), stops)


def slot_struct(resolved: str, cleaned: Column, types: Column, stops: tuple[str, ...]) -> Column:
    """struct(brand, type, model, code, volume) of resolved words; ``types`` is the array of those that are types.

    Codes are found in the words put together again, each match beginning and ending at a blank.
    """
    line = F.concat(F.lit(" "), F.array_join(_words(resolved), " "), F.lit(" "))
    code = F.regexp_extract(line, f"(?<= ){CODE_WORDS}(?= )", 0)
    shown = code
    for spelt, letters in SPELT_CODES:
        shown = F.regexp_replace(shown, f"^{spelt} ", letters)
    rest = F.filter(t.tokens(F.regexp_replace(line, f"(?<= ){CODE_WORDS}(?= )", "")), lambda w: ~w.startswith("BRAND_"))
    brand = F.get(F.filter(resolved, lambda x: x["hit"]), 0)["word"]
    return F.struct(brand.alias("brand"), F.array_sort(F.array_intersect(rest, types)).alias("type"), F.filter(rest, lambda w: ~F.array_contains(types, w)).alias("model"), F.when(code != "", F.concat(F.lit("CODE:"), F.replace(shown, F.lit(" "), F.lit("")))).alias("code"), t.volume_tag(cleaned).alias("volume"))


def regex_struct(resolved: str, stops: tuple[str, ...]) -> Column:
    """struct(text, brands, types, volumes, latin, codes) of a name's resolved segments."""
    line = F.array_join(_words(resolved), "")
    for pattern, put in SPELLINGS:
        line = F.regexp_replace(line, pattern, put)
    cleaned = tuple({x.replace(t.ZWNJ, " ").translate(_LETTERS).lower() for x in stops})
    whole = F.array_join(without(t.tokens(line), cleaned), " ")
    every = lambda c, pattern: F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))
    rest = whole
    for pattern in (ENTITY_BRAND, ENTITY_TYPE, VOLUME):
        rest = F.regexp_replace(rest, pattern, " ")
    codes = F.array_union(F.array_union(every(rest, MIXED_CODE), every(rest, LONE_CODE)), every(rest, NAMED_CODE))
    return F.struct(whole.alias("text"), every(whole, ENTITY_BRAND).alias("brands"), every(whole, ENTITY_TYPE).alias("types"), every(whole, VOLUME).alias("volumes"), every(rest, LATIN).alias("latin"), codes.alias("codes"))


_LETTERS = str.maketrans(t.ARABIC_LETTERS + t.PERSIAN_DIGITS, t.PERSIAN_LETTERS + t.DIGITS)


def features(names: DataFrame, brands: DataFrame, types: DataFrame, stops: tuple[str, ...] = lexicon.STOP_WORDS) -> DataFrame:
    """(name, trie, regex, slot): the three parsers' features of each distinct name in ``names`` (name); null counts as empty.

    ``brands`` has (alias, brand_id, ord), ``types`` (phrase). Runs of words are bounded by the longest phrase.
    Write the result to a table where it is used more than once.
    """
    rows = names.select(F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name")).distinct()
    blanks, segments = F.split("alias", " "), lexicon.segments(F.col("alias"))
    both, (named, kinds) = lexicon.trie_phrases(brands, types), lexicon.regex_phrases(brands, types)
    rows = rows.withColumn("_clean", t.slot_clean(F.col("name"))).withColumns({"_trie_words": trie_words(F.col("name")), "_slot_words": slot_words(F.col("_clean"), stops), "_segments": lexicon.segments(t.base_clean(F.col("name")))})
    rows = lexicon.resolve(
        rows, "name", lexicon.Pass("_trie_words", both, lexicon.longest_run(both, blanks), out="_trie"), lexicon.Pass("_slot_words", lexicon.slot_phrases(brands), 2, out="_slot"),
        lexicon.Pass("_segments", named, lexicon.longest_run(named, segments), separator="", out="_branded"),
    )
    # Types come second in the regex parser, in the text that brands are put into; the slot parser knows one-word types as they are spelt.
    rows = rows.select("name", "_clean", "_trie", "_slot", F.transform("_slot", lambda x: x["word"]).alias("_slot_words"), lexicon.segments(F.array_join(_words("_branded"), "")).alias("_segments"))
    spelt = types.select(F.col("phrase").alias("alias"), F.col("phrase").alias("id")).distinct()
    rows = lexicon.resolve(rows, "name", lexicon.Pass("_segments", kinds, lexicon.longest_run(kinds, segments), separator="", out="_regex"), lexicon.Pass("_slot_words", spelt, 1, out="_typed"))
    found = F.array_distinct(F.transform(F.filter("_typed", lambda x: x["hit"]), lambda x: x["word"]))
    return rows.select("name", trie_struct("_trie", stops).alias("trie"), regex_struct("_regex", stops).alias("regex"), slot_struct("_slot", F.col("_clean"), found, stops).alias("slot"))


# -- scores of a pair ------------------------------------------------------------------------------


def lacks(site: Column, target: Column, strict: bool = True) -> Column:
    """Whether the target has entities of which the site has none; a site without any passes unless ``strict``."""
    clash = (F.size(target) > 0) & ~F.arrays_overlap(site, target)
    return clash if strict else clash & (F.size(site) > 0)


def near(word: Column, text: Column, least: int) -> Column:
    """Whether some stretch of ``text`` as long as the word has at least that ratio to it.

    A ratio lets few characters stand outside the common subsequence, and the edit distance is at most their
    number, so it refuses most stretches cheaply.
    """
    size, stray = F.length(word), 1 - (least - 0.5) / 100.0
    stretches = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), lambda k: F.substring(text, k, size))
    alike = lambda x: F.when(F.levenshtein(word, x) <= (size + F.length(x)) * stray, fuzzy.ratio_column(word, x) >= least).otherwise(False)
    return F.exists(stretches, alike)


def missing(words: Column, text: Column, least: int) -> Column:
    """Whether a word neither occurs in the text nor, if it is long enough, nearly so."""
    return F.exists(words, lambda w: F.when(F.contains(text, w), False).when(F.length(w) < NEAR_LENGTH, True).otherwise(~near(w, text, least)))


def residual(a: Column, b: Column) -> Column:
    return (fuzzy.token_set_column(a, b) * 0.4 + fuzzy.token_sort_column(a, b) * 0.6) / 100.0


def trie_score(site: Column, target: Column, blank: Column) -> Column:
    text, other = F.array_join(site["tokens"], " "), F.array_join(target["tokens"], " ")
    clash = lacks(site["brands"], target["brands"]) | lacks(site["types"], target["types"], strict=False) | lacks(site["measures"], target["measures"]) | lacks(site["codes"], target["codes"])
    clash = clash | missing(target["latin"], text, LATIN_LEAST) | missing(target["farsi"], text, FARSI_LEAST)
    return F.when(blank, 0.0).when(site["tokens"] == target["tokens"], 1.0).when(clash, 0.0).otherwise(F.round(residual(text, other), 4))


def regex_score(site: Column, target: Column) -> Column:
    apart = lambda x: (F.size(site[x]) > 0) & (F.size(target[x]) > 0) & ~F.arrays_overlap(site[x], target[x])
    codes = (F.size(site["codes"]) + F.size(target["codes"]) > 0) & ~F.arrays_overlap(site["codes"], target["codes"])
    return F.when(apart("brands") | apart("types") | apart("volumes") | apart("latin") | codes, 0.0).otherwise(residual(site["text"], target["text"]))


def model_coverage(site: Column, target: Column) -> Column:
    """Share of the target's model words that the site has, exactly or nearly, each word used once."""
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    beyond = lambda words, others: F.filter(words, lambda w, k: count(F.slice(words, 1, k + 1), w) > count(others, w))
    unmet, spare = beyond(target, site), beyond(site, target)
    size = F.size(target)
    share = F.least(F.lit(1.0), (size - F.size(unmet)) / size + fuzzy.greedy_pairs(unmet, spare, 0.80) / size)
    return F.when(size == 0, F.when(F.size(site) == 0, 1.0).otherwise(0.0)).when(F.size(site) < size, share * F.size(site) / size).otherwise(share)


def agreement(site: Column, target: Column, site_only: float, target_only: float) -> Column:
    """1 if equal or both missing, 0 if they differ."""
    return F.when(site.eqNullSafe(target), 1.0).when(site.isNull(), target_only).when(target.isNull(), site_only).otherwise(0.0)


def slot_score(site: Column, target: Column, blank: Column) -> Column:
    brand, kind = agreement(site["brand"], target["brand"], 0.5, 0.5), fuzzy.jaccard(site["type"], target["type"])
    code, volume = agreement(site["code"], target["code"], 0.8, 0.3), agreement(site["volume"], target["volume"], 0.7, 0.7)
    parts = (brand, kind, model_coverage(site["model"], target["model"]), code, volume)
    total = sum((weight * part for weight, part in zip(WEIGHTS, parts, strict=True)), F.lit(0.0))
    caps = [F.when(clash, cap) for clash, cap in ((code == 0, CODE_CAP), (volume == 0, VOLUME_CAP), (brand == 0, BRAND_CAP), (kind < TYPE_LEAST, TYPE_CAP))]
    return F.when(blank, 0.0).otherwise(F.round(F.least(total, *caps), 4))


def scored(pairs: DataFrame, known: DataFrame, site: str = "site", target: str = "target") -> DataFrame:
    """``pairs`` with columns trie, regex and slot, from the ``features`` of their names.

    Each pair of names is rated once, whatever number of rows it stands in; null names count as empty.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    side = lambda name: known.select(F.col("name").alias(f"_{name}"), *(F.col(x).alias(f"_{name}_{x}") for x in ("trie", "regex", "slot")))
    distinct = pairs.select(text(site).alias("_site"), text(target).alias("_target")).distinct()
    both = distinct.join(side("site"), "_site").join(side("target"), "_target")
    empty, blank = (F.col("_site") == "") | (F.col("_target") == ""), (F.size(t.tokens(F.col("_site"))) == 0) | (F.size(t.tokens(F.col("_target"))) == 0)
    rated = both.select(
        "_site", "_target", trie_score(F.col("_site_trie"), F.col("_target_trie"), empty).alias("trie"),
        regex_score(F.col("_site_regex"), F.col("_target_regex")).alias("regex"), slot_score(F.col("_site_slot"), F.col("_target_slot"), blank).alias("slot"),
    )
    keyed = pairs.withColumns({"_site": text(site), "_target": text(target)})
    return keyed.join(rated, ["_site", "_target"]).drop("_site", "_target")
