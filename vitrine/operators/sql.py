"""Functions for SQL text: the scorers of ``functions.scalar``, ``extract_product`` and the table function ``explode_cards``.

DataFrames are served better by the Column functions, which stay in the JVM; these give the same values.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions import text as t
from ..functions.lexicon import Lexicon
from . import extract

_DIGITS = str.maketrans(t.PERSIAN_DIGITS + t.ARABIC_DIGITS, 2 * t.DIGITS)
_TAG, _LINK, _WIDTH = re.compile("<[^>]*>"), re.compile(r'<a\b[^>]*?href="([^"]*)"'), re.compile(r"(\?w=)[0-9]+")
_BULLET, _BREAKS, _BLANKS, _DECIMAL, _INTEGER, _NO_DIGITS = map(re.compile, (r"[·•·]\s*", r"[\n\r\t]+", " {2,}", "[0-9.]+", "[0-9]+", "[^0-9]+"))

#: References without dot segments, parameters, fragments or empty parts.
_ROOTED = re.compile(r"(?a)(?:/[\w-][\w.-]*)+(?:\?[\w=&-]+)?")
_WHOLE = re.compile(r"(?a)https?://\w[\w.-]*(?:/[\w-][\w.-]*)+(?:\?[\w=&-]+)?")


@cache
def _pattern(make, *given: str) -> re.Pattern:
    return re.compile(make(*given))


def plain(fragment: str) -> str:
    out = _TAG.sub("", fragment) if "<" in fragment else fragment
    if "&" in out:
        for entity, char in extract.ENTITIES:
            out = out.replace(entity, char)
    return out.strip(" \t\r\n")


def insides(html: str, tags: str, attributes: str = "") -> list[str]:
    return _pattern(extract.inside_of, tags, attributes).findall(html)


def element(html: str | None, tags: str, attributes: str = "") -> str | None:
    found = _pattern(extract.inside_of, tags, attributes).search(html or "")
    return plain(found[1]) or None if found else None


def part(html: str, low: str, container: extract.Mark, last: bool = False) -> str | None:
    if container[1].lower() not in low:
        return None
    pattern = _pattern(extract.region_of, *container)
    found = pattern.findall(html)[-1:] if last else [m[1] for m in [pattern.search(html)] if m]
    return found[0][1:] if found else None


def located(html: str, name: str, low: str) -> str | None:
    for container, tags, mark in extract.LOCATORS[name]:
        if mark and mark[1].lower() not in low:
            continue
        inside = part(html, low, container) if container else html
        found = element(inside, tags, extract.has(*mark) if mark else "") if tags else plain(inside or "") or None
        if found is not None:
            return found
    return None


def block(text: str) -> str:
    return _BLANKS.sub(" ", _BREAKS.sub(" ", _BULLET.sub("", text.replace(t.NBSP, " ")))).strip(" ")


def blocks(html: str) -> list[str]:
    return [x for x in (block(plain(x)) for x in insides(html, extract.BLOCKS)) if x]


def panel_blocks(html: str, name: str, low: str) -> list[str]:
    panels = (part(html, low, container, last=k > 0) if container else html for k, (container, _, _) in enumerate(extract.LOCATORS[name]))
    return next((blocks(p) for p in panels if p is not None), [])


def _opening(tags: str, attributes: str) -> str:
    return "(?is)" + extract.opening(tags, attributes)


def _value(name: str) -> str:
    return rf'(?i)\b{name}="([^"]*)"'


def values(html: str, tags: str, attributes: str, name: str) -> list[str]:
    found = _pattern(_opening, tags, attributes).findall(html)
    value = _pattern(_value, name)
    return [m[1] if (m := value.search(x)) else "" for x in found]


def number(text: str | None, pattern: re.Pattern, kind):
    m = pattern.search((text or "").translate(_DIGITS))
    try:
        return kind(m[0]) if m else None
    except ValueError:
        return None


def price(text: str | None) -> int | None:
    digits = _NO_DIGITS.sub("", (text or "").translate(_DIGITS))
    return int(digits) if digits and int(digits) < 1 << 63 else None


@cache
def _root(base: str) -> str:
    return urljoin(base, "/x")[:-2]


def joined(base: str, url: str) -> str:
    """``urljoin``, which is asked only for references that aren't plain: whole urls stay, rooted paths follow the host."""
    if _ROOTED.fullmatch(url):
        return _root(base) + url
    return url if _WHOLE.fullmatch(url) else urljoin(base, url)


def page_images(html: str, low: str) -> dict[str, list[str]]:
    shown, before = [], set()
    if extract.GALLERY[1].lower() in low:
        for x in values(" ".join(insides(html, "figure", extract.has(*extract.GALLERY))), "img", "", "src"):
            if x:
                large = _WIDTH.sub(r"\g<1>800", x)
                if x not in before:
                    shown.append(large)
                before.add(large)
    labels = values(html, extract.ANY, extract.has(*extract.COLOUR), "aria-label") if extract.COLOUR[1].lower() in low else ()
    return {(x.strip(" ") or f"color_{k}"): shown for k, x in enumerate(labels)} or {"default": shown}


def product(html: str | None, url: str | None, query: str | None, base: str) -> dict:
    page = html or ""
    low = page.lower()
    find = lambda name: located(page, name, low)
    crumbs = part(page, low, extract.LOCATORS["brand"][0][0])
    if crumbs is None:
        nav = _pattern(extract.inside_of, "nav").search(page)
        crumbs = nav[1] if nav else ""
    trail = [x for x in map(plain, insides(crumbs, "a")) if x]
    struck, final = price(find("struck")), price(find("price"))
    box = part(page, low, extract.LOCATORS["buy_box"][0][0])
    stocked = extract.UNAVAILABLE not in (page if box is None else box)
    pictures = page_images(page, low)
    sources = dict.fromkeys(u for urls in pictures.values() for u in urls if u)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {
        "url": url, "query_name": query, "product_id": sha(url or ""), "name_fa": find("name_fa") or "", "name_en": find("name_en") or "", "brand": trail[0] if trail else "", "category": trail[-1] if trail else "",
        "rate": number(find("rate"), _DECIMAL, float), "review_count": number(find("reviews"), _INTEGER, int), "wishlist_count": number(find("wishlist"), _INTEGER, int),
        "is_out_of_stuck": stocked, "in_stock": stocked, "has_discount": struck is not None, "discount_percentage": number(find("discount"), _INTEGER, int) if struck is not None else None,
        "real_price": struck if struck is not None else final, "discounted_price": final if struck is not None else None, "image_urls": pictures, "image_ids": [sha(joined(base, u)) for u in sources],
        "product_intro": panel_blocks(page, "intro", low), "usage_instructions": panel_blocks(page, "usage", low),
        "error": "empty page" if not page.strip(" ") else "challenge page" if any(s in low for s in extract.CHALLENGE_SIGNS) else None,
    }


class ExplodeCards:
    """(pos, name, href) of a listing page's cards."""

    def eval(self, html: str, base: str):
        for pos, card in enumerate(insides(html or "", "article")):
            link = _LINK.search(card)
            href = None if link is None else link[1] if link[1].startswith("http") else base + link[1].lstrip("/")
            yield pos, element(card, "h3") or "", href


def register(spark: SparkSession, lexicon: Lexicon, base: str = "https://example.com/") -> None:
    """All functions, for SQL text in this session: extract_product(html, url, query), explode_cards(html, base) and the scorers'."""
    scalar.register(spark, lexicon)
    kinds = [x.strip().split(" ")[0] for x in extract.PRODUCT.replace("map<string,array<string>>", "map").split(",")]

    def extract_product(pages: pd.Series, urls: pd.Series, queries: pd.Series) -> pd.DataFrame:
        given = ([x if isinstance(x, str) else None for x in column] for column in (pages, urls, queries))
        records = [product(*row, base) for row in zip(*given, strict=True)]
        frame = pd.DataFrame({k: pd.Series([r[k] for r in records], dtype=object) for k in kinds})
        return frame

    spark.udf.register("extract_product", F.pandas_udf(extract_product, extract.PRODUCT))
    spark.udtf.register("explode_cards", F.udtf(ExplodeCards, returnType="pos int, name string, href string"))
