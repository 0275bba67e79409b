"""Name scorers on worked cases, and ratios against plain definitions."""

import random
from urllib.parse import urljoin

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samples import BRANDS, LEXICON
from vitrine.functions import fuzzy, names, scalar, text
from vitrine.functions.lexicon import Lexicon, last_wins, load_lexicon

SCORER = scalar.Scorer(LEXICON)
SLOT = [
    ("کرم پودر مک استودیو فیکس NC41", "کرم پودر مک استودیو فیکس NC 41", 1.0),
    ("کرم پودر مک NC40", "کرم پودر مک NC41", 0.25),
    ("ادو پرفیوم زنانه هات لاو مدل Victoria Secret Bombshell حجم 100 میلی لیتر", "ادو پرفیوم زنانه هات لاو حجم 100 میلی لیتر", 0.8056),
    ("کرم پودر بورژوا ایرمت 01", "کرم پودر بورژوآ ایرمت شماره 01", 1.0),
    ("پودر بیک Flormar", "فلورمار پودر بیک", 0.35),
    ("شامپو لورال 400 میلی لیتر", "شامپو لورال 250 میلی لیتر", 0.3),
    ("ریمل اسنس", "ریمل حجم دهنده برای چشم های حساس اسنس", 0.65),
    ("کرم پودر 125م", "کرم پودر 125 میلی لیتر", 1.0),
    ("سرم ویتامین سی", "سرم ویتامین سی روشن کننده", 1.0),
    ("کرم شب", "لوسیون شب", 0.825),
    ("کرم پودر ان سی 35", "کرم پودر NC35", 1.0),
    ("", "کرم پودر", 0.0),
]


TRIE = [
    ("کرم پودر هلو کیتی 50ml", "کرم پودر HELLO KITTY 50ml", 1.0),
    ("پنکک میکاپ فور اور رنگ تیره", "پنکک MAKE UP FOR EVER", 0.0),
    ("کرم پودر هلو کیتی", "کانسیلر هلو کیتی", 0.0),
    (None, "x", 0.0),
]
REGEX = [
    ("کرم پودر هلو کیتی 50ml", "کرم پودر HELLO KITTY 50 ml", 1.0),
    ("مک NC40", "مک NC41", 0.0),
    ("کرم پودر مک", "کرم پودر لورال", 0.0),
]


def known(spark, names_):
    rows = spark.createDataFrame([(x,) for x in names_], "name string")
    return names.features(rows, LEXICON.frame(spark), LEXICON.type_frame(spark))


def test_worked_cases(spark):
    cases = [("slot", site, target, score) for target, site, score in SLOT] + [("trie", *c) for c in TRIE] + [("regex", *c) for c in REGEX]
    pairs = spark.createDataFrame([(k, c[1], c[2]) for k, c in enumerate(cases)], "k int, site string, target string")
    rated = names.scored(pairs, known(spark, [x for c in cases for x in c[1:3]])).collect()
    assert len(rated) == len(cases)
    for r in rated:
        kind, site, target, score = cases[r.k]
        assert r[kind] == score == getattr(SCORER, f"{kind}_score")(site, target), cases[r.k]


def test_features_of_edge_names(spark):
    rows = {r.name: r for r in known(spark, ["21 ml", "x hello kitty y hello z", "ژیلت", "ONE TWO THREE FOUR", None, "", " ", "لانیژ"]).collect()}
    # A bare number that is an alias loses its unit, as brands come first.
    assert rows["21 ml"].regex.text == "BRAND_21 ml"
    assert rows["x hello kitty y hello z"].trie.tokens == ["x", "brand_hello_kitty", "y", "brand_hello", "z"]
    assert rows["ژیلت"].trie.tokens == ["type_ژیلت"] and rows["ژیلت"].regex.brands == ["BRAND_GILLETTE"]
    assert rows["ONE TWO THREE FOUR"].slot.brand is None and rows["ONE TWO THREE FOUR"].trie.brands == ["brand_four_words"]
    assert rows["لانیژ"].slot.brand == "BRAND_LANEIGE"
    assert len(rows) == 7 and rows[""].trie.tokens == [] == rows[" "].slot.model


PIECES = (
    "کرم پودر مک HELLO kitty هلو کیتی NC41 NC 41 21 ml 50 میلی لیتر 50ml ام ان سی 35 اس پی اف 30 Dr. Martin dr.martin x-21 no 5 شماره استودیو فیکس studio studoi foundation foundatoin عطر ژیلت - (21) م گرم 10g A30G 2.5OZ "
    "بوي رنگ كرم one two three four ۴۱ ٣٥ victoria secret BRAND_X TYPE_Y cream's میل milliliter 12oz ʼ x_y"
).split()


def test_columns_and_scalars_agree(spark):
    draw = random.Random(2)
    some = [" ".join(draw.choice(PIECES) for _ in range(draw.randint(0, 7))) for _ in range(120)]
    pairs = [(draw.choice(some), draw.choice(some)) for _ in range(400)] + [(a, " ".join(draw.sample(a.split(), len(a.split())))) for a in some] + [(f"{a} foundation", f"{a} foundatoin") for a in some[:60]]
    frame = spark.createDataFrame(pairs, "site string, target string")
    features = known(spark, [x for p in pairs for x in p])
    for r in features.collect():
        trie, slots, regex = SCORER.trie(r.name), SCORER.slots(r.name), SCORER.regex(r.name)
        assert trie["tokens"] == r.trie.tokens and all(trie[k] == set(r.trie[k]) for k in ("brands", "types", "measures", "codes", "latin", "farsi")), r.name
        assert regex["text"] == r.regex.text and all(regex[k] == set(r.regex[k]) for k in ("brands", "types", "volumes", "latin", "codes")), r.name
        assert (slots["brand"], sorted(slots["type"]), slots["model"], slots["code"], slots["volume"]) == (r.slot.brand, r.slot.type, r.slot.model, r.slot.code, r.slot.volume), r.name
    for r in names.scored(frame, features).collect():
        want = SCORER.trie_score(r.site, r.target), SCORER.regex_score(r.site, r.target), SCORER.slot_score(r.site, r.target)
        assert (r.trie, r.regex, r.slot) == pytest.approx(want, abs=1e-9), (r.site, r.target)


def test_dictionary_of_full_size(spark):
    """6,000 aliases of one to four words and 400 types, made by a rule, give what a plain search gives."""
    draw = random.Random(3)
    syllables = ["ka", "lo", "mi", "ne", "ru", "sa", "ti", "vo", "ze", "pa"]
    word = lambda k: "".join(syllables[int(d)] for d in f"{k:04d}")
    brands = tuple((" ".join(word((k * 7 + j * 13) % 10_000) for j in range(1 + (k % 30 == 0) * 3 + (k % 3 == 0))).upper(), f"BRAND_{k}") for k in range(6000))
    lexicon = Lexicon(brands, tuple(word(9999 - k).upper() for k in range(400)), ("AND",))
    some = [" ".join([*draw.choice(brands)[0].split(), *(word(draw.randrange(10_000)) for _ in range(3)), f"NC{draw.randrange(50)}", "and", "50 ml"]) for _ in range(60)]
    rows = names.features(spark.createDataFrame([(x,) for x in some], "name string"), lexicon.frame(spark), lexicon.type_frame(spark), lexicon.stops).collect()
    scorer = scalar.Scorer(lexicon)
    assert len(rows) == len(set(some))
    for r in rows:
        assert r.trie.tokens == scorer.trie(r.name)["tokens"] and r.regex.text == scorer.regex(r.name)["text"] and r.slot.brand == scorer.slots(r.name)["brand"]


WORDS = st.text("ab c", max_size=9)


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@given(WORDS, WORDS)
def test_lcs(a, b):
    assert fuzzy.lcs_length(a, b) == plain_lcs(a, b)


def test_columns_agree(spark):
    pairs = [("red plate", "hot plate"), ("widget", "gadget"), ("a b", "b a"), ("a b c", "b"), ("", "x"), ("x y", "z"), ("b b a", "a b")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.ratio_column(F.col("a"), F.col("b")), fuzzy.token_sort_column(F.col("a"), F.col("b")), fuzzy.token_set_column(F.col("a"), F.col("b"))).collect()
    for a, b, plain, by_sort, by_set in rows:
        assert (plain, by_sort, by_set) == (fuzzy.ratio(a, b), fuzzy.token_sort_ratio(a, b), fuzzy.token_set_ratio(a, b))
    assert fuzzy.token_set_ratio("", "") == 0 and fuzzy.ratio("", "") == 100


def test_scalar_edges(spark):
    row = spark.range(1).select(
        text.parse_price(F.lit("۱٬۲۳۴٬۰۰۰ تومان")), text.parse_price(F.lit("")), text.upscale_image(F.lit("a.jpg?w=150&h=2")), text.upscale_image(F.lit("a?h=2&w=150")),
        text.clean_block(F.lit("a b • c\n\r\nd   e ")), text.fold_digits(F.lit("۱۲١٢")), text.volume_tag(F.lit("کرم 2.5OZ")), text.volume_tag(F.lit("A30Gx")), text.url_slug(F.lit("not a url")),
    ).first()
    assert list(row) == [1234000, None, "a.jpg?w=800&h=2", "a?h=2&w=150", "a b c d e", "1212", "VOL:2.5OZ", None, "unknown-product"]


def test_lexicon_tables(spark):
    frame = LEXICON.frame(spark)
    assert dict(last_wins(frame).collect()) == dict(BRANDS)
    loaded = load_lexicon(frame, spark.createDataFrame([("شامپو",)], "phrase string"))
    assert loaded.brands == BRANDS and loaded.types == ("شامپو",)
    with pytest.raises(ValueError):
        load_lexicon(frame, spark.createDataFrame([("x",)], "phrase string"), most_bytes=300)


def test_scores_for_sql(spark):
    scalar.register(spark, LEXICON)
    row = spark.sql("SELECT similarity_slot('کرم پودر مک NC41', 'کرم پودر مک NC40') AS s, token_sort_ratio('b a', 'a b') AS t, similarity_trie(NULL, 'x') AS n, parse_product('مک NC41 50ml') AS p").first()
    assert (row.s, row.t, row.n) == (0.25, 100, 0.0)
    assert (row.p.brand, row.p.code, row.p.volume) == ("BRAND_MAC", "CODE:NC41", "VOL:50ML")
    texts = spark.sql("SELECT normalize_trie('کرم پودر مک 50 ml') AS t, normalize_regex('مک NC 41') AS r, normalize_trie(NULL) AS n").first()
    assert tuple(texts) == ("type_کرم_پودر brand_mac 50ml", "BRAND_MAC nc41", "")


@pytest.mark.parametrize("base", ["https://shop.example", "https://shop.example/", "https://shop.example/a/b?c#d"])
def test_joined_url(spark, base):
    found = ["/p/1", "q.jpg", "../x/./y", "//cdn.example/z", "https://other/1", "?w=1", "", "a/..", "../../../up", "#f", "/p?a=/../b", "data:x"]
    rows = spark.createDataFrame([(x,) for x in found], "u string").select("u", text.joined_url(F.col("u"), base).alias("j")).collect()
    for r in rows:
        assert r.j == urljoin(base, r.u), (base, r.u)
