"""Column functions for multilingual product names, prices and urls.

Java's \\d, \\w and \\s are ASCII by default; patterns that must see Persian letters and digits say (?U).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic letters and their Persian forms, Persian and Arabic-Indic digits, marks that are dropped.
ARABIC_LETTERS, PERSIAN_LETTERS = "يك", "یک"
PERSIAN_DIGITS, ARABIC_DIGITS, DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"
ALEFS, TATWEEL, ZWNJ, NBSP = "[أإآٱ]", "ـ", "‌", " "
DIACRITICS = "[\\u064B-\\u065F]"
#: A word character as dictionaries and patterns see it: letters and numbers of all scripts, and the underscore.
W = r"[\p{L}\p{N}_]"
#: Unit spellings of the three name parsers.
TRIE_ML = r"(?iU)(\d+)\s*(?:میلی\s*لیتر|میل(?!ی)|milliliter|ml|م(?![\p{L}\p{N}_]))"
TRIE_G = r"(?iU)(\d+)\s*(?:گرم|grams?|gr(?![\p{L}\p{N}_])|g(?![\p{L}\p{N}_]))"
SLOT_VOLUME = r"(?iU)(\d+(?:\.\d+)?)\s*(میلی\s*لیتر|میلی‌لیتر|میلی\s*گرم|گرم|لیتر|ML|L|G|MG|CC|OZ|م)(?!\S)"
REGEX_ML = r"(?U)(?<![\p{L}\p{N}_])(\d+)\s*(?:میلی\s*لیتر|میل|م|ml|milliliter)(?![\p{L}\p{N}_])"
REGEX_G = r"(?U)(?<![\p{L}\p{N}_])(\d+)\s*(?:گرم|g|gram)(?![\p{L}\p{N}_])"


#: A measure in its standard form, and a Persian word.
MEASURE = r"(?i)^\p{Nd}+(?:ml|g)$"
FARSI = "[آ-یپچجگژ]{3,}"


def once(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then(c)``, with c worked out once for all its uses: inside functions of items nothing else shares them."""
    return F.get(F.transform(F.array(c), then), 0)


def is_blank(c: Column) -> Column:
    """Null, empty, or the text nan in any case."""
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "nan")


def mapped(c: Column, found: str, put: str) -> Column:
    """Characters replaced one for one, each by a search for its bytes: on long texts far cheaper than a look at each character."""
    for old, new in zip(found, put, strict=True):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def persian_letters(c: Column) -> Column:
    return mapped(c, ARABIC_LETTERS, PERSIAN_LETTERS)


def fold_digits(c: Column, arabic: bool = True) -> Column:
    """Persian and, if asked for, Arabic-Indic digits as ASCII."""
    return mapped(c, PERSIAN_DIGITS + (ARABIC_DIGITS if arabic else ""), DIGITS + (DIGITS if arabic else ""))


def fold_marks(c: Column) -> Column:
    """Alef forms become plain alef; tatweel and diacritics go."""
    return F.regexp_replace(F.regexp_replace(c, ALEFS, "ا"), f"{TATWEEL}|{DIACRITICS}", "")


def base_clean(c: Column) -> Column:
    """Letters, joiners, Persian digits and case, as the trie and regex parsers begin."""
    return F.lower(fold_digits(F.replace(persian_letters(c), F.lit(ZWNJ), F.lit(" ")), arabic=False))


def slot_clean(c: Column) -> Column:
    return F.upper(fold_digits(persian_letters(fold_marks(c))))


def standard_units(c: Column) -> Column:
    """Volumes as `Nml` and weights as `Ng`, set apart by blanks."""
    return F.regexp_replace(F.regexp_replace(c, TRIE_ML, " $1ml "), TRIE_G, " $1g ")


def cut_volume(c: Column) -> Column:
    """A cleaned name without its first volume."""
    at = F.regexp_instr(c, F.lit(SLOT_VOLUME))
    size = F.length(F.regexp_extract(c, SLOT_VOLUME, 0))
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(" "), F.substring(c, at + size, F.length(c)))).otherwise(c)


def volume_tag(c: Column) -> Column:
    """VOL:<number><unit> of the first volume in a cleaned name, null without one. Units aren't converted."""
    number = F.regexp_extract(c, SLOT_VOLUME, 1)
    unit = F.upper(F.translate(F.regexp_extract(c, SLOT_VOLUME, 2), f" {ZWNJ}", ""))
    canonical = F.when(unit.isin("لیتر", "L"), "L").when(unit.isin("میلیگرم", "MG"), "MG").when(unit.isin("گرم", "G"), "G").when(unit == "OZ", "OZ").otherwise("ML")
    return F.when(number != "", F.concat(F.lit("VOL:"), number, canonical))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"(?U)\s+"), lambda t: t != "")


def code_tokens(names: Column) -> Column:
    """Distinct tokens with digits that aren't measures."""
    found = F.filter(names, lambda t: t.rlike(r"(?i)^(?:[a-z]+\p{Nd}+|\p{Nd}+[a-z]+|\p{Nd}+)$") & ~t.rlike(MEASURE))
    return F.array_distinct(found)


def measure_tokens(names: Column) -> Column:
    return F.array_distinct(F.filter(names, lambda t: t.rlike(MEASURE)))


def word_tokens(names: Column) -> Column:
    """Latin words of three letters or more."""
    return F.array_distinct(F.filter(names, lambda t: t.rlike("(?i)^[a-z]{3,}$")))


def persian_tokens(names: Column) -> Column:
    return F.array_distinct(F.filter(names, lambda t: t.rlike(f"^{FARSI}$")))


def parse_price(c: Column) -> Column:
    """Digits of a price as a number; null without digits."""
    return F.regexp_replace(fold_digits(c), "[^0-9]", "").try_cast("bigint")


def first_decimal(c: Column) -> Column:
    return F.regexp_extract(fold_digits(c), "[0-9.]+", 0).try_cast("double")


def first_integer(c: Column) -> Column:
    return F.regexp_extract(fold_digits(c), "[0-9]+", 0).try_cast("int")


def clean_block(c: Column) -> Column:
    """A text block on one line: no bullets, no line breaks, single blanks."""
    c = F.replace(c, F.lit(NBSP), F.lit(" "))
    c = F.regexp_replace(c, r"(?U)[·•·]\s*", "")
    c = F.regexp_replace(c, r"[\n\r\t]+", " ")
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def upscale_image(c: Column, width: int = 800) -> Column:
    """The width parameter of an image url, where it is the first parameter."""
    return F.regexp_replace(c, r"(\?w=)[0-9]+", f"$1{width}")


def absolute_url(c: Column, base: str) -> Column:
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit(base), F.ltrim(c, F.lit("/"))))


def joined_url(c: Column, base: str) -> Column:
    """A reference resolved against ``base``: absolute ones stay, //host takes the scheme, /path the host, ?query
    the path, and others stand beside the base's last part. Dot segments are resolved."""
    scheme, host, path, asked = re.match(r"([a-z][a-z0-9+.-]*:)//([^/?#]*)([^?#]*)([?][^#]*)?", base, re.I).groups(default="")
    folder = path[: path.rfind("/") + 1] or "/"
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))
    step = lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x)))

    def closed(parts: Column) -> Column:
        flat = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
        return once(flat, lambda x: F.when(F.try_element_at(parts, F.lit(-1)).isin(".", "..") & (x != ""), F.concat(x, F.lit("/"))).otherwise(x))

    def resolved(v: Column) -> Column:
        own, rest = v["own"], v["rest"]
        whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.lit(folder), own))
        local = F.concat(F.lit(f"{scheme}//{host}/"), once(F.split(F.substr(whole, F.lit(2)), "/"), closed), rest)
        return F.when(own == "", F.concat(F.lit(f"{scheme}//{host}{path}"), F.when(rest.startswith("#"), F.lit(asked)).otherwise(F.lit("")), rest)).otherwise(local)

    own = F.regexp_extract(c, "^[^?#]*", 0)
    cut = F.struct(own.alias("own"), F.substr(c, F.length(own) + 1).alias("rest"))
    return F.when(c.rlike("(?i)^[a-z][a-z0-9+.-]*:"), c).when(c.startswith("//"), F.concat(F.lit(scheme), c)).when(c == "", F.lit(base)).otherwise(once(cut, resolved))


def url_slug(c: Column) -> Column:
    """The last part of a url's path, decoded."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    return F.coalesce(F.try_url_decode(F.replace(F.try_element_at(parts, F.lit(-1)), F.lit("+"), F.lit("%2B"))), F.lit("unknown-product"))


def folder_name(c: Column, most: int = 120) -> Column:
    """A name without characters that file systems forbid."""
    c = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "-")
    c = F.regexp_replace(c, "-{2,}", "-")
    return F.substring(F.btrim(c, F.lit(" .")), 1, most)


def retryable(c: Column, signs: tuple[str, ...]) -> Column:
    """Whether an error message holds one of the signs, in any case."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*map(F.lit, signs)), lambda s: F.contains(low, s))
