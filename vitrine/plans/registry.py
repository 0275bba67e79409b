"""Registered queries and the SQL that gives the same rows.

SQL is written over tokens and without look-around, apart from the Spark expressions it checks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, lexicon, names
from ..functions import text as t
from ..operators import extract, matching, relax, state
from ..sources import stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- scans, filters, state -------------------------------------------------------------------------


@query("SELECT doc_id, lang, length(text) AS size FROM documents WHERE lower(trim(coalesce(text, ''))) NOT IN ('', 'nan')")
def nonblank_scan(spark, sf):
    return table(spark, sf, "documents").where(~t.is_blank(F.col("text"))).select("doc_id", "lang", F.length("text").alias("size"))


@query("""
SELECT d.doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, CAST(NULL AS VARCHAR) AS note, false AS done,
       coalesce(quality IS NOT NULL AND toxic IS NOT NULL, false) AS labelled
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def header_fill(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")), "doc_id", "left")
    filled = state.fill_header(joined, ["quality", "toxic", "note"])
    return filled.withColumn("done", state.processed(F.col("quality"), F.col("toxic"), F.col("note"))).withColumn("labelled", state.processed(F.col("quality"), F.col("toxic")))


def _rows(spark, sf):
    return table(spark, sf, "part").select("p_partkey", state.row_id(F.col("p_name"), F.col("p_partkey").cast("string")).alias("row_id"))


@query("SELECT p_partkey, p_name || '::' || p_partkey AS row_id FROM part WHERE p_partkey % 3 <> 0")
def row_state_anti(spark, sf):
    rows = _rows(spark, sf)
    return state.remaining(rows, rows.where("p_partkey % 3 = 0"), "row_id").select("p_partkey", "row_id")


@query("SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 4 = 1)")
def url_semi(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return state.seen(pages, pages.where("page_id % 4 = 1"), "url").select("page_id", "url")


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 1)")
def url_anti(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return state.remaining(pages, pages.where("page_id % 4 = 1"), "url").select("page_id", "url")


def _entries(spark, sf):
    flag = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "view", F.lit(None)).otherwise(False)
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("/u/"), F.col("user_id").cast("string"))).alias("product_url"), flag.cast("boolean").alias("is_scraped"), F.lit(None).cast("string").alias("scrap_directory"))


@query("SELECT count(*) AS pending FROM events WHERE event_type NOT IN ('purchase', 'error')")
def pending_count(spark, sf):
    return state.pending(_entries(spark, sf)).agg(F.count("*").alias("pending"))


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE '/u/' || user_id END AS product_url,
                  CASE event_type WHEN 'purchase' THEN true WHEN 'view' THEN NULL ELSE false END AS was FROM events),
     r AS (SELECT *, row_number() OVER (PARTITION BY product_url ORDER BY event_id) AS k FROM e),
     u AS (SELECT '/u/' || user_id AS url, min('d' || lpad(CAST(user_id AS VARCHAR), 4, '0')) AS dir FROM events WHERE user_id % 5 = 0 GROUP BY user_id)
SELECT event_id, product_url, CASE WHEN k = 1 AND dir IS NOT NULL THEN true ELSE was END AS is_scraped, CASE WHEN k = 1 THEN dir END AS scrap_directory
FROM r LEFT JOIN u ON product_url = url""")
def first_match_update(spark, sf):
    updates = table(spark, sf, "events").where("user_id % 5 = 0").select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("product_url"), F.concat(F.lit("d"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("scrap_directory"))
    return state.first_match_update(_entries(spark, sf), updates, "product_url", ["event_id"]).select("event_id", "product_url", "is_scraped", "scrap_directory")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name, p_brand FROM part")
def sheet_write_back(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return state.write_back(parts, parts.where("p_partkey % 2 = 0").withColumn("p_name", F.upper("p_name")), "p_partkey", ["p_name"])


def _records(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, "timeout").when(F.col("page_id") % 7 == 1, "  ").alias("error"), F.when(F.col("page_id") % 11 == 0, " ").otherwise(F.col("url")).alias("name_fa"))
    return pages.withColumn("is_failed", state.is_failed(F.col("error"), F.col("name_fa")))


@query("SELECT page_id, page_id % 7 = 0 OR page_id % 11 = 0 AS is_failed, CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN 'failed-product' ELSE sha256(CAST(page_id AS VARCHAR)) END AS folder FROM pages")
def failed_split(spark, sf):
    return _records(spark, sf).select("page_id", "is_failed", F.when(F.col("is_failed"), "failed-product").otherwise(state.stable_id(F.col("page_id").cast("string"))).alias("folder"))


@query("SELECT count(*) AS attempted, count(*) FILTER (page_id % 7 <> 0 AND page_id % 11 <> 0) AS succeeded, count(*) FILTER (page_id % 7 = 0 OR page_id % 11 = 0) AS failed FROM pages")
def run_counts(spark, sf):
    return state.run_counts(_records(spark, sf))


@query("SELECT event_id, event_type || ' 429 Quota' AS message, event_type = 'error' AS retryable FROM events")
def retryable_errors(spark, sf):
    events = table(spark, sf, "events")
    message = F.concat("event_type", F.lit(" 429 Quota"))
    return events.select("event_id", message.alias("message"), t.retryable(F.when(F.col("event_type") == "error", message).otherwise(F.col("event_type")), ("429", "403", "quota", "exhausted", "rate limit", "too many requests")).alias("retryable"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS again FROM events")
def json_props(spark, sf):
    parsed = F.from_json("props", "k long")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), F.to_json(F.struct(parsed["k"].alias("k"))).alias("again"))


@query("SELECT event_id, list_filter(list_transform(string_split(event_type || ' , ,' || user_id, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM events")
def list_split(spark, sf):
    raw = F.concat("event_type", F.lit(" , ,"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "").alias("parts"))


# -- scalar functions ------------------------------------------------------------------------------


@query("""
SELECT doc_id, md5(translate(replace(lower(text), '‌', ' '), 'يك۰۱۲۳۴۵۶۷۸۹', 'یک0123456789')) AS base,
       md5(upper(translate(translate(text, 'أإآٱـ', 'اااا'), 'يك۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', 'یک01234567890123456789'))) AS slot
FROM (SELECT doc_id, translate(text, 'ßİ', 'si') AS text FROM documents)""")
def char_fold(spark, sf):
    # The two letters whose other case is two characters long differ between engines; both sides fold them first.
    text = F.translate("text", "ßİ", "si")
    return table(spark, sf, "documents").select("doc_id", F.md5(t.base_clean(text)).alias("base"), F.md5(t.slot_clean(text)).alias("slot"))


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[·•]\s*', '', 'g'), '[\n\r\t]+', ' ', 'g'), ' {2,}', ' ', 'g'))) AS block FROM documents""")
def clean_block(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(t.clean_block(F.col("text"))).alias("block"))


def _sized(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, (" ml", "ML", " gram", "g", " oz"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), unit).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN p_name || ' ' || p_size || 'ml' WHEN p_partkey % 5 < 4 THEN p_name || ' ' || p_size || 'g' ELSE p_name || ' ' || p_size || ' oz' END AS name FROM part")
def unit_standardise(spark, sf):
    return _sized(spark, sf).select("p_partkey", F.trim(F.regexp_replace(t.standard_units(F.col("name")), " +", " ")).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'VOL:' || p_size || 'ML' WHEN 1 THEN 'VOL:' || p_size || 'ML' WHEN 3 THEN 'VOL:' || p_size || 'G' WHEN 4 THEN 'VOL:' || p_size || 'OZ' END AS volume FROM part")
def unit_extract(spark, sf):
    return _sized(spark, sf).select("p_partkey", t.volume_tag(t.slot_clean(F.col("name"))).alias("volume"))


@query("""
SELECT p_partkey, CASE WHEN p_size < 10 THEN ['nc' || p_size] ELSE ['nc' || p_size, CAST(p_size AS VARCHAR)] END AS codes, [p_size || 'ml'] AS measures,
       list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 3) AS latin
FROM part""")
def code_tokens(spark, sf):
    name = F.concat_ws(" ", F.lower("p_name"), F.concat(F.lit("nc"), "p_size"), F.when(F.col("p_size") >= 10, F.col("p_size").cast("string")), F.concat("p_size", F.lit("ml")))
    words = table(spark, sf, "part").select("p_partkey", t.tokens(name).alias("w"))
    return words.select("p_partkey", t.code_tokens(F.col("w")).alias("codes"), t.measure_tokens(F.col("w")).alias("measures"), t.word_tokens(F.col("w")).alias("latin"))


#: White space beyond ASCII that words are split at too.
_WIDE = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


@query(f"SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(trim(lower(translate(text, '{_WIDE}', '{' ' * len(_WIDE)}'))), '\\s+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}')))) AS latin FROM documents")
def word_classes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(t.word_tokens(t.tokens(F.lower("text")))).alias("latin"))


@query("SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS price, CAST(NULL AS BIGINT) AS missing FROM part")
def parse_price(spark, sf):
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    shown = F.concat(F.translate(F.format_number(cents, 0), "0123456789,", "۰۱۲۳۴۵۶۷۸۹٬"), F.lit(" تومان"))
    return table(spark, sf, "part").select("p_partkey", t.parse_price(shown).alias("price"), t.parse_price(F.lit("تماس بگیرید")).alias("missing"))


@query("SELECT p_partkey, p_size / 10.0 AS rate, p_size AS reviews FROM part")
def rating_parse(spark, sf):
    rate, reviews = F.concat(F.lit("rated "), F.format_number(F.col("p_size") / 10, 1), F.lit(" of 5")), F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(",123 reviews)"))
    return table(spark, sf, "part").select("p_partkey", t.first_decimal(F.translate(rate, "0123456789", t.PERSIAN_DIGITS)).alias("rate"), t.first_integer(reviews).alias("reviews"))


@query("SELECT page_id, regexp_replace(url, '[?]w=[0-9]+', '?w=800', 'g') || '.jpg?w=800' AS first, regexp_replace(url, '[?]w=[0-9]+', '?w=800', 'g') || '.jpg?h=2&w=150' AS second FROM pages")
def upscale_url(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", t.upscale_image(F.concat("url", F.lit(".jpg?w=150"))).alias("first"), t.upscale_image(F.concat("url", F.lit(".jpg?h=2&w=150"))).alias("second"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://shop.example/p/' || page_id END AS url FROM pages")
def absolute_url(spark, sf):
    href = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("//p/"), F.col("page_id").cast("string")))
    return table(spark, sf, "pages").select("page_id", t.absolute_url(href, "https://shop.example/").alias("url"))


@query(r"""
SELECT page_id, coalesce(url_decode(list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '')[-1]), 'unknown-product') AS slug FROM pages""")
def url_slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.url_slug(F.col("url")).alias("slug"))


@query(r"""SELECT page_id, left(trim(regexp_replace(regexp_replace(url || ' ..', '[<>:"/\\|?*\x00-\x1f]', '-', 'g'), '-{2,}', '-', 'g'), ' .'), 120) AS folder FROM pages""")
def sanitize_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.folder_name(F.concat("url", F.lit(" .."))).alias("folder"))


# -- ratios over pairs of names --------------------------------------------------------------------


def name_pairs(spark, sf) -> DataFrame:
    """Distinct pairs of a part's name (a) and its brand's first part's name (b): as many as there are names, not their square."""
    parts = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    first = parts.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("b"))
    return parts.join(first, "p_brand").select(F.col("p_name").alias("a"), "b").distinct()


_PAIRS = "(SELECT DISTINCT p_name AS a, first_value(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)"


def _lcs_sql(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE list_reduce(list_transform(string_split({a}, ''), lambda c: [ascii(c)]), lambda prev, c: list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), "
        f"lambda acc, j: list_append(acc, greatest(prev[j[1] + 1], acc[len(acc)], prev[j[1]] + CASE WHEN ascii(substr({b}, j[1], 1)) = c[1] THEN 1 ELSE 0 END)), [0::BIGINT]), list_transform(range(0, length({b}) + 1), lambda j: 0::BIGINT))[-1] END"
    )


def _ratio_sql(a: str, b: str) -> str:
    return f"CAST(round_even(200.0 * ({_lcs_sql(a, b)}) / (length({a}) + length({b})), 0) AS INT)"


@query(f"SELECT a, b, levenshtein(a, b) AS distance, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity FROM {_PAIRS}")
def levenshtein_pairs(spark, sf):
    return name_pairs(spark, sf).select("a", "b", F.levenshtein("a", "b").alias("distance"), F.round(fuzzy.edit_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""
SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) AS jaccard, list_sort(list_intersect(x, y)) AS common, list_sort(list_filter(x, lambda w: NOT list_contains(y, w))) AS only_a
FROM (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM {_PAIRS})""")
def jaccard_tokens(spark, sf):
    x, y = F.split("a", " "), F.split("b", " ")
    return name_pairs(spark, sf).select("a", "b", F.round(fuzzy.jaccard(x, y), 6).alias("jaccard"), F.array_sort(F.array_intersect(x, y)).alias("common"), F.array_sort(F.array_except(x, y)).alias("only_a"))


@query(f"SELECT a, b, {_ratio_sql('a', 'b')} AS ratio FROM {_PAIRS}")
def indel_ratio(spark, sf):
    return name_pairs(spark, sf).select("a", "b", fuzzy.ratio_column(F.col("a"), F.col("b")).alias("ratio"))


@query(f"SELECT a, b, {_ratio_sql('x', 'y')} AS ratio FROM (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS x, array_to_string(list_sort(string_split(b, ' ')), ' ') AS y FROM {_PAIRS})")
def token_sort_ratio(spark, sf):
    return name_pairs(spark, sf).select("a", "b", fuzzy.token_sort_column(F.col("a"), F.col("b")).alias("ratio"))


def _set_ratio_sql(x: str, y: str) -> str:
    """Token set ratio of two lists of distinct words."""
    text = lambda words: f"coalesce(array_to_string(list_sort({words}), ' '), '')"
    rest = lambda a, b: f"list_filter({a}, lambda q: NOT list_contains({b}, q))"
    i, u, v = text(f"list_intersect({x}, {y})"), text(rest(x, y)), text(rest(y, x))
    head = f"CASE WHEN {i} = '' THEN 0 ELSE length({i}) + 1 END"
    m, o, n = f"({head} + length({u}))", f"({head} + length({v}))", f"length({i})"
    between = f"100 * (1 - (length({u}) + length({v}) - 2 * ({_lcs_sql(u, v)})) / ({m} + {o}))"
    against = lambda size: f"CASE WHEN {i} = '' THEN 0 ELSE 100 * (1 - ({size} - {n}) / ({size} + {n})) END"
    return f"CASE WHEN {i} <> '' AND ({u} = '' OR {v} = '') THEN 100 ELSE CAST(round_even(greatest({between}, {against(m)}, {against(o)}), 0) AS INT) END"


@query(f"SELECT a, b, {_set_ratio_sql('x', 'y')} AS ratio FROM (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM {_PAIRS})")
def token_set_ratio(spark, sf):
    return name_pairs(spark, sf).select("a", "b", fuzzy.token_set_column(F.col("a"), F.col("b")).alias("ratio"))


@query(f"SELECT a, b, len(list_intersect(string_split(a || ' ' || a, ' '), string_split(b, ' '))) AS hits FROM {_PAIRS}")
def multiset_match(spark, sf):
    a = F.split(F.concat_ws(" ", "a", "a"), " ")
    return name_pairs(spark, sf).select("a", "b", fuzzy.multiset_matches(a, F.split("b", " ")).cast("long").alias("hits"))


# Two words a side: the first takes its best, the second what is left.
@query(f"""
WITH w AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM {_PAIRS}),
     s AS (SELECT a, b, x, y, 1 - levenshtein(x[1], y[1]) / greatest(length(x[1]), length(y[1])) AS s11, 1 - levenshtein(x[1], y[2]) / greatest(length(x[1]), length(y[2])) AS s12,
                  1 - levenshtein(x[2], y[1]) / greatest(length(x[2]), length(y[1])) AS s21, 1 - levenshtein(x[2], y[2]) / greatest(length(x[2]), length(y[2])) AS s22 FROM w)
SELECT a, b, CASE WHEN greatest(s11, s12) >= 0.5 THEN 1 + CASE WHEN CASE WHEN s11 >= s12 THEN s22 ELSE s21 END >= 0.5 THEN 1 ELSE 0 END
             ELSE CASE WHEN greatest(s21, s22) >= 0.5 THEN 1 ELSE 0 END END AS hits FROM s""")
def greedy_fuzzy_pairing(spark, sf):
    return name_pairs(spark, sf).select("a", "b", fuzzy.greedy_pairs(F.split("a", " "), F.split("b", " "), 0.5).alias("hits"))


# -- dictionaries ----------------------------------------------------------------------------------

_ALIASES = (("red plate", "BRAND_RP", 0), ("red", "BRAND_RED", 1), ("small", "BRAND_OLD", 2), ("small", "BRAND_SMALL", 3), ("gizmo", "BRAND_GIZMO", 4), ("hot gear", "BRAND_HG", 5), ("Gear Hot", "BRAND_GH", 6))
_VALUES = ", ".join(f"('{a.lower()}', '{b}', {k})" for a, b, k in _ALIASES)


def _dictionary(spark):
    return spark.createDataFrame(list(_ALIASES), "alias string, brand_id string, ord long")


@query(f"SELECT alias, max_by(brand_id, ord) AS brand_id FROM (VALUES {', '.join(str(x) for x in _ALIASES)}) v(alias, brand_id, ord) GROUP BY alias")
def dict_last_wins(spark, sf):
    return lexicon.last_wins(_dictionary(spark))


# Names of two words: the whole name, or word by word.
@query(f"""
WITH d AS (SELECT alias, max_by(brand_id, ord) AS id FROM (VALUES {_VALUES}) v(alias, brand_id, ord) GROUP BY alias),
     p AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, CASE WHEN b.id IS NOT NULL THEN [b.id] ELSE [coalesce(x.id, w[1]), coalesce(y.id, w[2])] END AS resolved
FROM p LEFT JOIN d b ON b.alias = p_name LEFT JOIN d x ON x.alias = w[1] LEFT JOIN d y ON y.alias = w[2]""")
def dict_longest_match(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    return lexicon.longest_matches(parts, _dictionary(spark), "p_partkey", "w").select("p_partkey", "resolved")


_STOP_SQL = ", ".join(f"'{w}'" for w in lexicon.STOP_WORDS)


@query(f"SELECT p_partkey, list_filter(string_split(p_name || ' مدل ' || p_size || ' شیشه ای با ' || p_brand, ' '), lambda w: w NOT IN ({_STOP_SQL})) AS words FROM part")
def stopwords(spark, sf):
    """The library's stop words go; those of two words never match one."""
    name = F.concat_ws(" ", "p_name", F.lit("مدل"), "p_size", F.lit("شیشه ای با"), "p_brand")
    return table(spark, sf, "part").select("p_partkey", names.without(t.tokens(name), lexicon.STOP_WORDS).alias("words"))


# -- the three scorers -----------------------------------------------------------------------------

_KINDS, _STOPS = ("WIDGET", "PLATE", "RING", "GIZMO", "GEAR BOX"), ("NEW", "HOUSE RULES")


def _brands(spark) -> DataFrame:
    """Two aliases for each brand: AORIA, and AORIA HOUSE, whose second word is an alias of its own; the first alias's first row is out of date."""
    number = F.col("id").cast("int")
    name = F.concat(F.char(number + 65), F.lit("ORIA"))
    rows = F.array(
        F.struct(name.alias("alias"), F.lit("BRAND_OUTDATED").alias("brand_id")), F.struct(name.alias("alias"), F.concat(F.lit("BRAND_"), name).alias("brand_id")),
        F.struct(F.concat(name, F.lit(" HOUSE")).alias("alias"), F.concat(F.lit("BRAND_"), name).alias("brand_id")), F.struct(F.lit("HOUSE").alias("alias"), F.lit("BRAND_HOUSE").alias("brand_id")),
    )
    return spark.range(26).select(F.posexplode(rows).alias("ord", "r"), "id").select("r.*", (F.col("id") * 4 + F.col("ord")).alias("ord"))


def _types(spark) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _KINDS], "phrase string")


def _items(spark, sf) -> DataFrame:
    """Parts with what their names are made of: an alias (none for every 11th part), adjective, noun (with an s for every 10th), shade and size."""
    words, key = F.split("p_name", " "), F.col("p_partkey")
    house = F.concat(F.char(F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") + 65), F.lit("ORIA"))
    parts = table(spark, sf, "part").select("p_brand", key, house.alias("house"), words[0].alias("adj"), words[1].alias("noun"), (F.col("p_size") % 3).cast("string").alias("shade"), (F.col("p_size") % 4 * 10 + 10).cast("string").alias("amount"))
    noun = F.when(key % 10 == 3, F.concat("noun", F.lit("s"))).otherwise(F.col("noun"))
    site = F.concat_ws(" ", F.when(key % 11 != 0, F.when(key % 2 == 0, F.col("house")).otherwise(F.concat(F.lower("house"), F.lit(" House")))), "adj", noun, F.concat(F.lit("NC"), "shade"), "amount", F.lit("ml"))
    return parts.withColumn("site", site)


def _cards(spark, sf) -> DataFrame:
    """Targets are the first part of each brand, under three names; its listing is the brand's other parts, on pages of 250 keys, all of them read."""
    items = _items(spark, sf)
    own = items.groupBy(F.col("p_brand").alias("row_id")).agg(F.min_by(F.struct("house", "adj", "noun", "shade", "amount"), "p_partkey").alias("t"), F.min("p_partkey").alias("own")).select("row_id", "own", "t.*")
    title = F.concat_ws(" ", "adj", "noun", "house", F.concat(F.lit("NC"), "shade"), F.concat("amount", F.lit("ml")))
    spelt = F.concat_ws(" ", F.concat("house", F.lit(" HOUSE")), F.lower("adj"), F.upper("noun"), F.lit("NC"), "shade", "amount", F.lit("ml"))
    targets = own.select("row_id", title.alias("title"), F.array(spelt, F.concat_ws(" ", "noun", "house", F.concat("amount", F.lit("ML")))).alias("names"), "own")
    listed = items.join(own.select(F.col("row_id").alias("p_brand"), "own"), "p_brand").where("p_partkey <> own")
    href = F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit("/p/"), F.floor(F.col("p_partkey") / 2).cast("string")))
    listings = listed.select(F.col("p_brand").alias("row_id"), F.floor(F.col("p_partkey") / 250).cast("int").alias("page_num"), F.col("p_partkey").alias("pos"), F.col("site").alias("name"), href.alias("href"))
    return matching.candidates(targets, listings, pages=(1 << 31) - 1)


def _known(spark, named: DataFrame) -> DataFrame:
    """Features of all names, written once as both sides of each pair read them."""
    folder = _folder(spark, "features")
    names.features(named, _brands(spark), _types(spark), _STOPS).write.parquet(folder)
    return spark.read.parquet(folder)


_SCORES = ("slot", "regex", "trie")


def _scored(spark, sf) -> DataFrame:
    """Cards against their targets' names, rated by all three scorers over features of each distinct name."""
    cards = _cards(spark, sf)
    known = _known(spark, cards.select("name").union(cards.select(F.col("target_name").alias("name"))))
    return names.scored(cards, known, "name", "target_name")


# What names are made of, in SQL: nothing is parsed, so the parsers are checked against how the names were put together.
_ITEMS_SQL = """
i AS (SELECT p_brand AS row_id, p_partkey, chr(65 + CAST(regexp_extract(p_brand, '[0-9]+') AS INT)) || 'ORIA' AS house, string_split(p_name, ' ')[1] AS adj, string_split(p_name, ' ')[2] AS noun,
             CAST(p_size % 3 AS VARCHAR) AS shade, CAST(p_size % 4 * 10 + 10 AS VARCHAR) AS amount FROM part),
m AS (SELECT row_id, p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN house END AS house, nullif(adj, 'new') AS adj, noun || CASE WHEN p_partkey % 10 = 3 THEN 's' ELSE '' END AS noun, shade, amount,
             concat_ws(' ', CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN house ELSE lower(house) || ' House' END END, adj, noun || CASE WHEN p_partkey % 10 = 3 THEN 's' ELSE '' END, 'NC' || shade, amount, 'ml') AS name FROM i),
st AS (SELECT *, noun IN ('widget', 'plate', 'ring', 'gizmo') AS typed FROM m),
f AS (SELECT row_id, min(p_partkey) AS own FROM i GROUP BY row_id),
e0 AS (SELECT i.row_id, own, house, nullif(adj, 'new') AS adj, noun, noun IN ('widget', 'plate', 'ring', 'gizmo') AS typed, shade, amount,
              concat_ws(' ', adj, noun, house, 'NC' || shade, amount || 'ml') AS title, concat_ws(' ', house || ' HOUSE', lower(adj), upper(noun), 'NC', shade, amount, 'ml') AS spelt, concat_ws(' ', noun, house, amount || 'ML') AS short
       FROM i JOIN f ON i.row_id = f.row_id AND p_partkey = own),
e AS (SELECT row_id, own, house, adj, noun, typed, shade, amount, 0 AS name_pos, title AS target_name FROM e0 UNION ALL SELECT row_id, own, house, adj, noun, typed, shade, amount, 1, spelt FROM e0
      UNION ALL SELECT row_id, own, house, NULL, noun, typed, NULL, amount, 2, short FROM e0),
c AS (SELECT e.row_id, e.name_pos, e.target_name, p_partkey // 250 AS page_num, p_partkey AS pos, st.name, '/p/' || (p_partkey // 2) AS href, st.house AS sh, e.house AS eh, st.adj AS sa, e.adj AS ea, st.noun AS sn, e.noun AS en,
             st.typed AS sy, e.typed AS ey, st.shade AS sc, e.shade AS ec, st.amount AS sv, e.amount AS ev
      FROM st JOIN e ON st.row_id = e.row_id WHERE p_partkey <> own AND p_partkey % 9 <> 0)"""


def _present(*items: str) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


# Resolved words of the site's and the target's name; the trie parser leaves a code written apart as two words.
_WORDS_SQL = f"""
w AS (SELECT *, {_present("'brand_' || lower(sh)", "sa", "CASE WHEN sy THEN 'type_' ELSE '' END || sn", "'nc' || sc", "sv || 'ml'")} AS x,
             {_present("'brand_' || lower(eh)", "ea", "CASE WHEN ey THEN 'type_' ELSE '' END || en", "'nc' || ec", "ev || 'ml'")} AS y,
             {_present("'brand_' || lower(eh)", "ea", "CASE WHEN ey THEN 'type_' ELSE '' END || en", "CASE WHEN name_pos = 1 THEN 'nc' ELSE 'nc' || ec END", "CASE WHEN name_pos = 1 THEN ec END", "ev || 'ml'")} AS z FROM c)"""


def _residual_sql(x: str, y: str) -> str:
    """0.4 of the set ratio and 0.6 of the sort ratio of two word lists."""
    text = lambda words: f"coalesce(array_to_string(list_sort({words}), ' '), '')"
    return f"(0.4::DOUBLE * ({_set_ratio_sql(x, y)}) + 0.6::DOUBLE * {_ratio_sql(text(x), text(y))}) / 100"


_MODEL = lambda a, y, n: f"{_present(a, f'CASE WHEN NOT {y} THEN {n} END')}"
_ALIKE = "CASE WHEN {a} IS NOT DISTINCT FROM {b} THEN 1.0 WHEN {a} IS NULL THEN {target_only} WHEN {b} IS NULL THEN {site_only} ELSE 0.0 END"
_SLOT_SQL = f"""
p AS (SELECT *, {_ALIKE.format(a='sh', b='eh', target_only=0.5, site_only=0.5)}::DOUBLE AS pa, {_ALIKE.format(a='sc', b='ec', target_only=0.3, site_only=0.8)}::DOUBLE AS pd, CASE WHEN sv = ev THEN 1.0 ELSE 0.0 END::DOUBLE AS pe,
             CASE WHEN sy OR ey THEN CASE WHEN sy AND ey AND sn = en THEN 1.0 ELSE 0.0 END ELSE 1.0 END::DOUBLE AS pb, {_MODEL('sa', 'sy', 'sn')} AS sm, {_MODEL('ea', 'ey', 'en')} AS em,
             CASE WHEN NOT sy AND NOT ey AND sn <> en AND 1 - levenshtein(sn, en) / greatest(length(sn), length(en)) >= 0.8 THEN 1 ELSE 0 END AS fz FROM w),
q1 AS (SELECT *, CASE WHEN len(em) = 0 THEN CASE WHEN len(sm) = 0 THEN 1.0 ELSE 0.0 END ELSE (len(list_intersect(sm, em)) + fz) / len(em) * least(1.0, len(sm) / len(em)) END::DOUBLE AS pc FROM p),
s AS (SELECT *, round(least(0.2::DOUBLE * pa + 0.15::DOUBLE * pb + 0.35::DOUBLE * pc + 0.2::DOUBLE * pd + 0.1::DOUBLE * pe, CASE WHEN pd = 0 THEN 0.25 ELSE 1 END, CASE WHEN pe = 0 THEN 0.3 ELSE 1 END, CASE WHEN pa = 0 THEN 0.35 ELSE 1 END, CASE WHEN pb < 0.5 THEN 0.4 ELSE 1 END), 4) AS s1,
             CASE WHEN sh <> eh OR (sy AND ey AND sn <> en) OR sv <> ev OR sc IS DISTINCT FROM ec OR (len(list_filter([sa, CASE WHEN NOT sy THEN sn END], lambda q: q IS NOT NULL)) > 0 AND len(list_filter([ea, CASE WHEN NOT ey THEN en END], lambda q: q IS NOT NULL)) > 0 AND NOT list_has_any(sm, em)) THEN 0
                  ELSE {_residual_sql('x', 'y')} END AS s2,
             CASE WHEN sh IS DISTINCT FROM eh OR (sy AND ey AND sn <> en) OR sv <> ev OR (ec IS NOT NULL AND (name_pos = 1 OR sc <> ec))
                       OR len(list_filter(em, lambda q: NOT contains(array_to_string(x, ' '), q))) > 0 THEN 0 ELSE round({_residual_sql('x', 'z')}, 4) END AS s3 FROM q1)"""
_RATED_SQL = f"{_ITEMS_SQL}, {_WORDS_SQL}, {_SLOT_SQL}"


def _one_score(spark, sf, kind: str) -> DataFrame:
    return _scored(spark, sf).select("row_id", "pos", "name_pos", F.round(kind, 6).alias("score"))


@query(f"WITH {_RATED_SQL} SELECT row_id, pos, name_pos, round(s1, 6) AS score FROM s")
def slot_score(spark, sf):
    return _one_score(spark, sf, "slot")


@query(f"WITH {_RATED_SQL} SELECT row_id, pos, name_pos, round(s2, 6) AS score FROM s")
def regex_score(spark, sf):
    return _one_score(spark, sf, "regex")


@query(f"WITH {_RATED_SQL} SELECT row_id, pos, name_pos, round(s3, 6) AS score FROM s")
def trie_score(spark, sf):
    return _one_score(spark, sf, "trie")


def _site_features(spark, sf) -> DataFrame:
    items = _items(spark, sf).select("p_partkey", F.col("site").alias("name"))
    return items.join(_known(spark, items.select("name")), "name")


@query(f"""WITH {_ITEMS_SQL} SELECT p_partkey, 'BRAND_' || house AS brand, CASE WHEN typed THEN [upper(noun)] ELSE [] END AS type, {_present('upper(adj)', 'CASE WHEN NOT typed THEN upper(noun) END')} AS model,
'CODE:NC' || shade AS code, 'VOL:' || amount || 'ML' AS volume FROM st""")
def parse_slots(spark, sf):
    return _site_features(spark, sf).select("p_partkey", "slot.*")


@query(f"""WITH {_ITEMS_SQL} SELECT p_partkey, {_present("'brand_' || lower(house)", 'adj', "CASE WHEN typed THEN 'type_' ELSE '' END || noun", "'nc' || shade", "amount || 'ml'")} AS tokens,
['nc' || shade] AS codes, [amount || 'ml'] AS measures, {_present('adj', 'CASE WHEN NOT typed THEN noun END')} AS latin FROM st""")
def parse_trie(spark, sf):
    return _site_features(spark, sf).select("p_partkey", "trie.tokens", "trie.codes", "trie.measures", "trie.latin")


@query(f"""WITH {_ITEMS_SQL} SELECT p_partkey, array_to_string({_present("'BRAND_' || house", 'adj', "CASE WHEN typed THEN 'TYPE_' || upper(noun) ELSE noun END", "'nc' || shade", "amount || 'ml'")}, ' ') AS text,
['nc' || shade] AS codes, [amount || 'ml'] AS volumes, {_present('adj', 'CASE WHEN NOT typed THEN noun END')} AS latin FROM st""")
def parse_regex(spark, sf):
    return _site_features(spark, sf).select("p_partkey", "regex.text", "regex.codes", "regex.volumes", "regex.latin")


# -- matching --------------------------------------------------------------------------------------

_CARD = ["row_id", "page_num", "pos", "name", "href"]
_SCORED_SQL = f"""{_RATED_SQL},
en AS (SELECT row_id, page_num, pos, name, href, coalesce(max((s1 + s2 + s3) / 3) FILTER (greatest(s1, s2, s3) > 0.6), 0) AS avg_score, coalesce(max(greatest(s1, s2, s3)) FILTER (greatest(s1, s2, s3) > 0.6), 0) AS max_score
       FROM s GROUP BY row_id, page_num, pos, name, href)"""


def _shown(cards: DataFrame, *more: str) -> DataFrame:
    return cards.select("row_id", "pos", "href", F.round("avg_score", 6).alias("avg_score"), F.round("max_score", 6).alias("max_score"), *more)


_SHOWN = "row_id, pos, href, round(avg_score, 6) AS avg_score, round(max_score, 6) AS max_score"


@query(f"WITH {_SCORED_SQL} SELECT row_id, pos, name_pos, round(s1, 6) AS s1, round(s2, 6) AS s2, round(s3, 6) AS s3 FROM s WHERE greatest(s1, s2, s3) > 0.6")
def gate_any(spark, sf):
    rows = _scored(spark, sf)
    return rows.where(matching.passes_gate(*(F.col(x) for x in _SCORES))).select("row_id", "pos", "name_pos", *(F.round(x, 6).alias(f"s{k}") for k, x in enumerate(_SCORES, 1)))


def _ensemble(spark, sf):
    return matching.ensemble(_scored(spark, sf), _CARD, _SCORES)


@query(f"WITH {_SCORED_SQL} SELECT {_SHOWN} FROM en")
def ensemble_card(spark, sf):
    return _shown(_ensemble(spark, sf))


@query(f"WITH {_SCORED_SQL} SELECT {_SHOWN} FROM en WHERE avg_score > 0.7 OR max_score > 0.7")
def candidate_filter(spark, sf):
    return _shown(matching.qualified(_ensemble(spark, sf)))


def _best_sql(by: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {by} DESC, page_num, pos) AS k FROM q) WHERE k = 1"


_QUALIFIED = f"{_SCORED_SQL}, q AS (SELECT * FROM en WHERE avg_score > 0.7 OR max_score > 0.7)"


@query(f"WITH {_QUALIFIED} SELECT {_SHOWN} FROM ({_best_sql('avg_score')})")
def best_by_avg(spark, sf):
    return _shown(matching.best(matching.qualified(_ensemble(spark, sf)), "avg_score", "row_id", ["page_num", "pos"]))


@query(f"WITH {_QUALIFIED} SELECT {_SHOWN} FROM ({_best_sql('max_score')})")
def best_by_max(spark, sf):
    return _shown(matching.top_by_window(matching.qualified(_ensemble(spark, sf)), "max_score", "row_id", ["page_num", "pos"]))


def _emit_sql(shadow: str) -> str:
    return f"""WITH {_QUALIFIED}, x AS ({_best_sql('avg_score')}), y AS ({_best_sql('max_score')})
SELECT {_SHOWN}, 'avg' AS reason FROM x WHERE avg_score >= 0.7
UNION ALL SELECT y.row_id, y.pos, y.href, round(y.avg_score, 6), round(y.max_score, 6), 'max' FROM y JOIN x USING (row_id) WHERE y.max_score >= 0.7 AND NOT ({shadow})"""


@query(_emit_sql("y.href = x.href"))
def emit_parity(spark, sf):
    return _shown(matching.emitted(matching.qualified(_ensemble(spark, sf)), "row_id", ["page_num", "pos"], "href", parity=True), "reason")


@query(_emit_sql("y.href = x.href AND x.avg_score >= 0.7"))
def emit_fixed(spark, sf):
    return _shown(matching.emitted(matching.qualified(_ensemble(spark, sf)), "row_id", ["page_num", "pos"], "href"), "reason")


@query("""
WITH f AS (SELECT p_brand, min_by(p_name, p_partkey) AS title, min(p_partkey) AS own FROM part GROUP BY p_brand),
     s AS (SELECT p_brand, title, p_partkey, p_name, 1 - levenshtein(p_name, title) / greatest(length(p_name), length(title)) AS sim FROM part JOIN f USING (p_brand) WHERE p_partkey <> own),
     r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sim DESC, p_partkey) AS k FROM s WHERE sim > 0.6)
SELECT p_brand, title, p_partkey, p_name, round(sim, 6) AS similarity FROM r WHERE k = 1""")
def brand_blocked_match(spark, sf):
    """The most similar other part of each brand's first part."""
    parts = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    first = parts.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("title"), F.min("p_partkey").alias("own"))
    scored = parts.join(first, "p_brand").where("p_partkey <> own").withColumn("sim", fuzzy.edit_similarity(F.col("p_name"), F.col("title"))).where(F.col("sim") > matching.GATE)
    return matching.best(scored, "sim", "p_brand", ["p_partkey"]).select("p_brand", "title", "p_partkey", "p_name", F.round("sim", 6).alias("similarity"))


# -- pages -----------------------------------------------------------------------------------------


def _plain_sql(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, char in extract.ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim({out})"


_H1 = _plain_sql("regexp_extract(html, '(?s)<h1\\b[^>]*>(.*?)</h1>', 1)")


_TITLE = _plain_sql("regexp_extract(html, '(?s)<title\\b[^>]*>(.*?)</title>', 1)")


@query(f"SELECT page_id, nullif({_TITLE}, '') AS title, nullif({_H1}, '') AS heading FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", extract.element(F.col("html"), "title").alias("title"), extract.element(F.col("html"), "h1").alias("heading"))


@query("SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*?href=\"([^\"]*)\"', 1) AS links, coalesce(list_filter(regexp_extract_all(regexp_extract(html, '(?s)<nav\\b[^>]*>(.*?)</nav>', 1), '(?s)<a\\b[^>]*>(.*?)</a>', 1), lambda x: trim(x) <> '')[1], '') AS brand FROM pages")
def html_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", extract.links(F.col("html")).alias("links"), F.coalesce(extract.breadcrumb(F.col("html"))[0], F.lit("")).alias("brand"))


_BLOCK = lambda x: rf"trim(regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[·•]\s*', '', 'g'), '[\n\r\t]+', ' ', 'g'), ' {{2,}}', ' ', 'g'))"
_PIECES = r"list_transform(regexp_split_to_array(html, '<(?:h2|h3|p)\b[^>]*>')[2:], lambda x: regexp_extract(x, '(?s)^(.*?)(?:</(?:h2|h3|p)\s*>|$)', 1))"


@query(f"SELECT page_id, list_filter(list_transform({_PIECES}, lambda x: {_BLOCK(_plain_sql('x'))}), lambda x: x <> '') AS blocks FROM pages")
def html_blocks(spark, sf):
    return table(spark, sf, "pages").select("page_id", extract.blocks(F.col("html")).alias("blocks"))


@query()
def html_blocks_exact(spark, sf):
    return table(spark, sf, "pages").select("page_id", extract.blocks_exact(F.col("html")).alias("blocks"))


def _marked(mark: str, inside: Column, tag: str = "span") -> Column:
    """A component's div with one element in it."""
    return F.concat(F.lit(f'<div class="x" data-sentry-component="{mark}"><{tag} class="y">'), inside, F.lit(f"</{tag}></div>"))


def _shop_pages(spark, sf) -> DataFrame:
    """(p_partkey, url, html): product pages made of parts. Every second page uses the fallback places, every
    third has a struck price, every fifth two colours, every seventh is unavailable, every 13th a challenge."""
    key, digits = F.col("p_partkey"), lambda c: F.translate(c.cast("string"), "0123456789", t.PERSIAN_DIGITS)
    span = lambda mark, inside: F.concat(F.lit(f'<span class="a {mark} b">'), inside, F.lit("</span>"))
    second, cents = key % 2 == 1, F.round(F.col("p_retailprice") * 100).cast("long")
    shown = F.concat(F.translate(F.format_number(cents, 0), "0123456789,", t.PERSIAN_DIGITS + "٬"), F.lit(" تومان"))
    less = F.concat(F.translate(F.format_number(cents - 50, 0), "0123456789,", t.PERSIAN_DIGITS + "٬"), F.lit(" تومان"))
    final = F.when(key % 3 == 0, less).otherwise(shown)
    crumbs = F.concat(F.lit('<a href="/">'), "p_brand", F.lit('</a><i>/</i><a href="/t"> </a><a href="/t">'), "p_type", F.lit(" &amp; more</a>"))
    pictures = F.concat(F.lit('<figure aria-label="open-gallery-modal"><img src="/i/'), key.cast("string"), F.lit('.jpg?w=150"><img alt="" src="https://cdn.example/'), key.cast("string"), F.lit('.png"></figure><figure><img src="/other.jpg"></figure>'))
    colours = F.when(key % 5 == 0, '<button data-sentry-component="ColorVariant" aria-label=" T06 "></button><button aria-label="" data-sentry-component="ColorVariant"></button>').otherwise("")
    usage = F.lit('<div data-headlessui-state="open"><p>closed first</p></div>'), F.lit('<div data-headlessui-state="a open"><p>use •  daily</p></div>'), F.lit('<div data-sentry-component="HowToUse"><p>apply</p><p> </p><h3>rinse</h3></div>')
    parts = [
        F.lit('<!DOCTYPE html><html><body><div id="root">'),
        F.when(second, F.concat(F.lit("<nav>"), crumbs, F.lit("</nav>"))).otherwise(F.concat(F.lit('<div data-sentry-component="PDPBreadcrumb">'), crumbs, F.lit('</div><div data-sentry-component="Next">'))),
        F.concat(F.lit("<h1 id=t> "), "p_name", F.lit("\n</h1><h1>no</h1>")),
        F.when(second, span("name-en", F.upper("p_name"))).otherwise(span("text-text-mediumGray", F.upper("p_name"))),
        F.when(second, span("rate", digits(F.format_number(F.col("p_size") / 10, 1)))).otherwise(_marked("StarRate", F.concat(digits(F.format_number(F.col("p_size") / 10, 1)), F.lit(" امتیاز")))),
        F.when(second, span("reviews", digits(F.col("p_size")))).otherwise(_marked("CommentsCounter", F.concat(digits(F.col("p_size")), F.lit(" دیدگاه")))),
        F.when(key % 4 != 0, _marked("WishlistCount", F.concat("p_size", F.lit(" likes")))).otherwise(""),
        F.concat(F.lit('<div data-test="pdp-buy-box"><b>'), F.when(key % 7 == 0, extract.UNAVAILABLE).otherwise("موجود"), F.lit('</b></div><div data-sentry-component="Price">')),
        F.when(key % 3 == 0, F.concat(F.when(second, F.concat(F.lit("<del>"), shown, F.lit("</del>"))).otherwise(span("line-through", shown)), span("bg-alert-error-dark", F.lit("۲۵٪")))).otherwise(""),
        F.when(second, span("price", final)).otherwise(F.concat(F.lit('<div data-test="pdp-price"><span data-test="pdp-price">'), final, F.lit("</span></div>"))),
        pictures, colours, F.lit('<div data-sentry-component="Description"><h2>About</h2><p>the '), F.col("p_name"), F.lit("<br>\nof "), F.col("p_brand"), F.lit("<p>open</div>"),
        F.when(key % 4 == 1, F.concat(usage[0], usage[1])).when(key % 4 == 2, F.concat(usage[0], usage[2], usage[1])).otherwise(""),
        F.when(key % 13 == 0, '<div data-sentry-component="Foot">Just a moment...</div>').otherwise(""), F.lit("</div></body></html>"),
    ]
    # Parts are spread, not the pages made of them; both extractions take a page once, so none is stored.
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    spread = rows.repartition(max(32, 4 * spark.sparkContext.defaultParallelism), "p_partkey")
    return spread.select(key, F.concat(F.lit("https://shop.example/p/"), key.cast("string")).alias("url"), F.concat(*parts).alias("html"))


_SHOP = "https://shop.example/c/list"
_RECORD_SQL = """
SELECT p_partkey, 'https://shop.example/p/' || p_partkey AS url, 'q' AS query_name, sha256('https://shop.example/p/' || p_partkey) AS product_id, p_name AS name_fa, upper(p_name) AS name_en, p_brand AS brand, p_type || ' & more' AS category,
       CAST(p_size / 10.0 AS DOUBLE) AS rate, p_size AS review_count, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS wishlist_count, p_partkey % 7 <> 0 AS is_out_of_stuck, p_partkey % 7 <> 0 AS in_stock, p_partkey % 3 = 0 AS has_discount,
       CASE WHEN p_partkey % 3 = 0 THEN 25 END AS discount_percentage, CAST(round(p_retailprice * 100) AS BIGINT) AS real_price, CASE WHEN p_partkey % 3 = 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) - 50 END AS discounted_price,
       CASE WHEN p_partkey % 5 = 0 THEN 'T06,color_1' ELSE 'default' END AS colours, ['/i/' || p_partkey || '.jpg?w=800', 'https://cdn.example/' || p_partkey || '.png'] AS images,
       [sha256('https://shop.example/i/' || p_partkey || '.jpg?w=800'), sha256('https://cdn.example/' || p_partkey || '.png')] AS image_ids, ['About', 'the ' || p_name || ' of ' || p_brand, 'open'] || CASE WHEN p_partkey % 4 = 1 THEN ['closed first', 'use daily'] WHEN p_partkey % 4 = 2 THEN ['closed first'] ELSE [] END AS product_intro,
       CASE p_partkey % 4 WHEN 1 THEN ['use daily'] WHEN 2 THEN ['apply', 'rinse'] || ['use daily'] ELSE [] END AS usage_instructions, CASE WHEN p_partkey % 13 = 0 THEN 'challenge page' END AS error FROM part"""


def _flat_record(rows: DataFrame, record: str = "r") -> DataFrame:
    colours = F.array_join(F.map_keys("image_urls"), ",").alias("colours")
    flat = rows.select("p_partkey", f"{record}.*")
    return flat.select(*(c for c in flat.columns if c != "image_urls"), colours, F.get(F.map_values("image_urls"), 0).alias("images"))


@query(_RECORD_SQL)
def html_record(spark, sf):
    record = extract.product(F.col("html"), F.col("url"), F.lit("q"), _SHOP)
    return _flat_record(_shop_pages(spark, sf).select("p_partkey", record.alias("r")))


@query(_RECORD_SQL)
def html_record_sql(spark, sf):
    """The same records by the function for SQL text."""
    from ..operators import sql

    sql.register(spark, lexicon.Lexicon(), _SHOP)
    return _flat_record(_shop_pages(spark, sf).selectExpr("p_partkey", "extract_product(html, url, 'q') AS r"))


def _listing_pages(spark, sf) -> DataFrame:
    """Pages of three parts each as listing html, with unclosed articles; every ninth card has no link."""
    card = F.concat(F.lit("<article class=c><h3> "), "p_name", F.lit(" &amp; co</h3><h3>no</h3>"), F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit('<a class="l" href="'), F.when(F.col("p_partkey") % 2 == 0, "/p/").otherwise("https://shop.example/p/"), F.col("p_partkey").cast("string"), F.lit('">go</a>'))).otherwise(""), F.when(F.col("p_partkey") % 2 == 0, "</article>").otherwise(""))
    rows = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 3).alias("page"), "p_partkey", card.alias("card"))
    return rows.groupBy("page").agg(F.concat(F.lit("<ul>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "card"))), lambda x: x["card"]), "\n"), F.lit("</ul>")).alias("html"))


_CARDS_SQL = "SELECT p_partkey // 3 AS page, p_partkey % 3 AS pos, p_name || ' & co' AS name, CASE WHEN p_partkey % 9 <> 0 THEN 'https://shop.example/p/' || p_partkey END AS href FROM part"


@query(_CARDS_SQL)
def listing_cards(spark, sf):
    return _listing_pages(spark, sf).select("page", F.posexplode(extract.cards(F.col("html"), "https://shop.example/")).alias("pos", "c")).select("page", "pos", "c.*")


@query(_CARDS_SQL)
def explode_cards(spark, sf):
    """The same cards by the table function for SQL text."""
    from ..operators import sql

    sql.register(spark, lexicon.Lexicon())
    view = f"listing_{uuid.uuid4().hex}"
    _listing_pages(spark, sf).createOrReplaceTempView(view)
    return spark.sql(f"SELECT page, pos, name, href FROM {view}, LATERAL explode_cards(html, 'https://shop.example/')")


@query("""
WITH p AS (SELECT p_brand AS row_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS page_num, p_size FROM part),
     s AS (SELECT *, CASE WHEN p_size = 50 THEN 'empty' WHEN p_size = 49 THEN 'no cards' WHEN p_size = 48 THEN 'no next page' WHEN p_size = 47 THEN 'next page disabled' WHEN page_num = 30 THEN 'page limit' END AS why FROM p WHERE page_num <= 30),
     b AS (SELECT row_id, coalesce(min(page_num) FILTER (p_size = 46), max(page_num) + 1) - 1 AS whole, min(page_num) FILTER (why IS NOT NULL AND p_size <> 46) AS stop FROM s GROUP BY row_id)
SELECT row_id, page_num, CASE WHEN page_num = stop THEN why WHEN page_num = least(whole, coalesce(stop, whole)) THEN 'not captured' END AS reason
FROM s JOIN b USING (row_id) WHERE page_num <= least(whole, coalesce(stop, whole)) AND coalesce(why, '') NOT IN ('empty', 'no cards')""")
def listing_stop(spark, sf):
    numbered = table(spark, sf, "part").withColumn("page_num", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    size = F.col("p_size")
    pages = numbered.where("p_size <> 46").select(F.col("p_brand").alias("row_id"), "page_num", (size == 50).alias("empty_marker"), F.when(size == 49, 0).otherwise(3).alias("cards"), (size != 48).alias("next_page"), (size == 47).alias("next_disabled"))
    return matching.pages_read(pages).select("row_id", "page_num", "reason")


@query("SELECT p_partkey, 'https://shop.example/p/' || p_partkey AS url, 'q' || p_brand AS query_name, CASE WHEN p_partkey % 2 = 0 THEN 'timeout ' || p_size ELSE 'unknown error' END AS error, true AS is_failed, '' AS name_fa, 0 AS pictures FROM part")
def failure_record(spark, sf):
    reason = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("timeout "), "p_size")).otherwise(" ")
    made = extract.failure(F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey").cast("string")), F.concat(F.lit("q"), "p_brand"), reason)
    rows = table(spark, sf, "part").select("p_partkey", made.alias("r")).select("p_partkey", "r.*")
    return rows.select("p_partkey", "url", "query_name", "error", state.is_failed(F.col("error"), F.col("name_fa")).alias("is_failed"), "name_fa", F.size("image_urls").alias("pictures"))


_RELATIVE = ("/i/x.jpg", "y.png?w=1", "../z//a", "//cdn.example/b", "https://cdn.example/c", "?q=1", "./d/../e/.")


@query("""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://shop.example/i/x.jpg' WHEN 1 THEN 'https://shop.example/c/y.png?w=1' WHEN 2 THEN 'https://shop.example/z//a' WHEN 3 THEN 'https://cdn.example/b'
WHEN 4 THEN 'https://cdn.example/c' WHEN 5 THEN 'https://shop.example/c/list?q=1' ELSE 'https://shop.example/c/e/' END AS joined FROM pages""")
def url_join(spark, sf):
    own = F.element_at(F.array(*map(F.lit, _RELATIVE)), (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", t.joined_url(own, _SHOP).alias("joined"))


# -- stores that are written and read again --------------------------------------------------------


def _folder(spark, label: str) -> str:
    return f"{stores.shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_STORED = "excel_product_name, search_query, website_product_name, product_url, avg_similarity_score, max_similarity_score, is_scraped, scrap_directory"


@query("""
SELECT p_name AS excel_product_name, p_brand AS search_query, CAST(NULL AS VARCHAR) AS website_product_name, '/p/' || (p_partkey // 2) AS product_url, p_size / 50.0 AS avg_similarity_score, CAST(NULL AS DOUBLE) AS max_similarity_score, false AS is_scraped, CAST(NULL AS VARCHAR) AS scrap_directory
FROM part UNION ALL SELECT p_name, p_brand, NULL, '/p/' || (p_partkey // 2), p_size / 50.0, NULL, false, NULL FROM part WHERE p_partkey % 2 = 0""")
def append_entries(spark, sf):
    """Entries appended in two runs: those of even keys are there twice."""
    folder = _folder(spark, "entries")
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("excel_product_name"), F.col("p_brand").alias("search_query"), F.concat(F.lit("/p/"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("product_url"), (F.col("p_size") / 50).alias("avg_similarity_score"))
    for part in (rows, rows.where("p_partkey % 2 = 0")):
        stores.append_entries(part, folder)
    return stores.read_entries(spark, folder)


@query("SELECT p_partkey, p_name || '::' || p_partkey AS row_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 <> 0")
def append_state(spark, sf):
    """Rows that remain after two runs have recorded theirs."""
    folder, rows = _folder(spark, "state"), _rows(spark, sf)
    for done in (rows.where("p_partkey % 3 <> 0"), rows.where("p_partkey % 2 = 0")):
        stores.append_state(done, folder)
    return state.remaining(rows, stores.read_state(spark, folder), "row_id").select("p_partkey", "row_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0")
def replace_table(spark, sf):
    folder, rows = _folder(spark, "versions"), table(spark, sf, "part").select("p_partkey", "p_name")
    for part in (rows, rows.where("p_partkey % 3 = 0"), rows.where("p_partkey % 2 = 0")):
        stores.replace_table(part, folder)
    return stores.read_table(spark, folder)


@query("SELECT DISTINCT 'https://shop.example/p/' || (p_partkey // 2) AS url FROM part WHERE p_partkey % 5 <> 0")
def recursive_json(spark, sf):
    """Urls of records stored by outcome, in nested folders."""
    folder = _folder(spark, "records")
    url = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("https://shop.example/p/"), F.floor(F.col("p_partkey") / 2).cast("string"))).otherwise("")
    state.save_by_outcome(table(spark, sf, "part").select("p_partkey", url.alias("url"), (F.col("p_partkey") % 3 == 0).alias("is_failed")), f"{folder}/deep")
    return stores.read_scraped_urls(spark, folder)


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'nan' ELSE url END AS title FROM pages WHERE page_id % 4 > 1")
def blank_titles(spark, sf):
    title = F.when(F.col("page_id") % 4 == 1, "  ").when(F.col("page_id") % 4 == 2, "nan").when(F.col("page_id") % 4 == 3, F.col("url"))
    return state.titled(table(spark, sf, "pages").select("page_id", title.alias("title")))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'q ' || p_name END AS query, p_partkey % 4 = 0 AS parsed FROM part""")
def parse_results(spark, sf):
    """Results as JSON: whole ones, ones that lack a name, broken ones, none."""
    cells = [F.concat(F.lit("q "), "p_name").alias(relax.CELLS[0]), *(F.concat("p_name", F.lit(f" {k}")).alias(c) for k, c in enumerate(relax.CELLS[1:]))]
    whole, short = F.to_json(F.struct(*cells)), F.to_json(F.struct(*cells[:4]))
    kind = F.col("p_partkey") % 4
    found = relax.parse_results(F.when(kind == 0, whole).when(kind == 1, short).when(kind == 2, F.substring(whole, 1, 20)))
    return table(spark, sf, "part").select("p_partkey", found.alias("r")).select("p_partkey", F.col(f"r.{relax.CELLS[0]}").alias("query"), F.col("r").isNotNull().alias("parsed"))


@query()
def png_transcode(spark, sf):
    """Grey images made of parts' names as PNG; decoded again they are RGB."""
    from ..operators import pictures

    def draw(names_: pd.Series) -> pd.Series:
        return names_.map(lambda x: pictures.encode_png(np.frombuffer((x * 12)[:48].encode(), np.uint8).reshape(4, 4, 3)))

    def mean(images: pd.Series) -> pd.Series:
        return images.map(lambda x: float(pictures.decode_png(x)[:, :, :3].mean()))

    drawn = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.pandas_udf(draw, "binary")("p_name")).otherwise(F.encode("p_name", "utf-8")).alias("raw"))
    shown = drawn.select("p_partkey", "raw", pictures.png(F.col("raw")).alias("png"))
    even = shown.where("p_partkey % 2 = 0").select("p_partkey", F.round(F.pandas_udf(mean, "double")("png"), 6).alias("mean"))
    return even.unionByName(shown.where("p_partkey % 2 = 1").select("p_partkey", F.when(F.col("raw") == F.col("png"), -1.0).alias("mean")))


@query("SELECT page_id, contains(lower(html), 'cloudflare') OR contains(lower(html), 'just a moment') AS bot, contains(lower(html), 'track(1') OR contains(lower(html), 'ution') AS other FROM pages")
def bot_flag(spark, sf):
    return table(spark, sf, "pages").select("page_id", extract.challenged(F.col("html")).alias("bot"), extract.challenged(F.col("html"), ("track(1", "ution")).alias("other"))


@query("""
WITH l AS (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*?href="([^"]*)"', 1) AS x FROM pages),
     u AS (SELECT page_id, unnest(x || x) AS v, generate_subscripts(x || x, 1) AS k FROM l),
     g AS (SELECT page_id, v, min(k) AS k FROM u WHERE v <> '' GROUP BY page_id, v)
SELECT l.page_id, coalesce(list(v ORDER BY k) FILTER (v IS NOT NULL), []) AS images FROM l LEFT JOIN g ON l.page_id = g.page_id GROUP BY l.page_id""")
def image_distinct(spark, sf):
    found = extract.links(F.col("html"))
    return table(spark, sf, "pages").select("page_id", state.ordered_distinct(F.concat(found, found)).alias("images"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice) AS BIGINT) AS real_price, CASE WHEN l_discount > 0 THEN CAST(round(l_extendedprice * (1 - l_discount)) AS BIGINT) END AS discounted_price, l_discount > 0 AS has_discount, CASE WHEN l_discount > 0 THEN CAST(round(l_discount * 100) AS INT) END AS discount_percentage FROM lineitem")
def availability_price(spark, sf):
    lines = table(spark, sf, "lineitem")
    whole = F.round("l_extendedprice").cast("bigint").cast("string")
    cut = F.col("l_discount") > 0
    final = F.when(cut, F.round(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("bigint").cast("string")).otherwise(whole)
    price = extract.prices(F.when(cut, whole).otherwise(F.lit("")), final, F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")))
    return lines.select("l_orderkey", "l_linenumber", price.alias("p")).select("l_orderkey", "l_linenumber", "p.*")


# -- relaxation and streaming ----------------------------------------------------------------------


@query("""
SELECT p_partkey, p_partkey % 3 <> 0 AS query_ok, p_partkey % 4 <> 0 OR p_size = 7 AS names_ok, lower(p_name) || ' nc' || p_size || ' 50 ml' AS name3,
       list_sort(list_distinct([CAST(p_size AS VARCHAR), '50'])) AS numbers FROM part""")
def relax_validate(spark, sf):
    """Names by rules, with a number put into every third query and every fourth last name."""
    titled = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.concat(F.lit("NC"), "p_size"), F.lit("50 ml")).alias("title"))
    rows, query_, name = relax.by_rules(titled), F.col(relax.CELLS[0]), F.col(relax.CELLS[5])
    rows = rows.withColumns({relax.CELLS[0]: F.when(F.col("p_partkey") % 3 == 0, F.concat(query_, F.lit(" ۳"))).otherwise(query_), relax.CELLS[5]: F.when(F.col("p_partkey") % 4 == 0, F.concat(name, F.lit(" 7x"))).otherwise(name)})
    return rows.select("p_partkey", relax.query_ok(query_).alias("query_ok"), relax.names_ok(F.col("title"), *(F.col(c) for c in relax.CELLS[1:])).alias("names_ok"), F.col(relax.CELLS[3]).alias("name3"), relax.numbers(F.col("title")).alias("numbers"))


@query(SQL["brand_blocked_match"])
def incremental_match(spark, sf):
    """Parts as a stream of listing files, a micro-batch each, matched with the first part of their brand as they come."""
    from ..streaming.incremental import match_stream, read_matches

    parts = table(spark, sf, "part")
    folder = f"{stores.shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    parts.select("p_brand", "p_partkey", "p_name").repartition(4, "p_partkey").write.mode("overwrite").parquet(f"{folder}/in")
    first = parts.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("title"), F.min("p_partkey").alias("own"))

    def match(batch: DataFrame) -> DataFrame:
        scored = batch.join(first, "p_brand").where("p_partkey <> own").withColumn("sim", fuzzy.edit_similarity(F.col("p_name"), F.col("title"))).where(F.col("sim") > matching.GATE)
        return matching.best(scored, "sim", "p_brand", ["p_partkey"])

    stream = spark.readStream.schema("p_brand string, p_partkey long, p_name string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    match_stream(stream, match, f"{folder}/out", f"{folder}/state").awaitTermination()
    best = matching.best(read_matches(spark, f"{folder}/out").drop("query", "batch"), "sim", "p_brand", ["p_partkey"])
    return best.select("p_brand", "title", "p_partkey", "p_name", F.round("sim", 6).alias("similarity"))
