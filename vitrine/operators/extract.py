"""Records from captured product pages.

An element's text ends at its first closing tag or where an element of the same kind begins. Patterns take what lies
between without going back, so each expression passes over a page once whatever tags stay open. What is used more than
once is bound by ``text.once``, and places whose sign isn't on the page aren't looked for.
"""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t
from . import state

#: Signs of an interstitial page, and the sentence that an unavailable product shows.
CHALLENGE_SIGNS = ("cloudflare", "verify you are human", "ddos-guard", "just a moment", "access denied", "bot detection")
UNAVAILABLE = "این محصول ناموجود است"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def has(name: str, value: str) -> str:
    """A pattern for a tag's attributes: one of them has this value, or for class has it among its values."""
    return rf'(?=[^>]*?{name}(?<=\b{name})="(?:[^"]*\s)?{value}(?:\s[^"]*)?")'  # the name is looked for before its \b: far cheaper


Mark = tuple[str, str] | None
#: Where the product pages have what a record holds: (container's attribute, tags, attribute), attributes as
#: name and value. Of several places the first that gives a text counts.
LOCATORS: dict[str, tuple[tuple[Mark, str, Mark], ...]] = {
    "name_fa": ((None, "h1", None),),
    "name_en": ((None, "span", ("class", "text-text-mediumGray")), (None, "span", ("class", "name-en"))),
    "brand": ((("data-sentry-component", "PDPBreadcrumb"), "a", None), (None, "nav", None)),
    "rate": ((("data-sentry-component", "StarRate"), "span", None), (None, "span", ("class", "rate"))),
    "reviews": ((("data-sentry-component", "CommentsCounter"), "span", None), (None, "span", ("class", "reviews"))),
    "wishlist": ((("data-sentry-component", "WishlistCount"), "span", None), (None, "span", ("class", "wishlist"))),
    "struck": ((None, "span", ("class", "line-through")), (None, "del", None)),
    "discount": ((None, "span", ("class", "bg-alert-error-dark")), (None, "span", ("class", "discount"))),
    "price": ((None, "span", ("data-test", "pdp-price")), (None, "span", ("class", "price"))),
    "buy_box": ((("data-test", "pdp-buy-box"), "", None),),
    "intro": ((("data-sentry-component", "Description"), "", None), (None, "body", None)),
    "usage": ((("data-sentry-component", "HowToUse"), "", None), (("data-headlessui-state", "open"), "", None)),
}
BLOCKS = "h2|h3|p"


def plain(fragment: Column) -> Column:
    """A fragment's text: tags dropped, common entities decoded, blanks trimmed."""
    c = F.regexp_replace(fragment, "<[^>]*>", "")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.btrim(c, F.lit(" \t\r\n"))


def opening(tags: str, attributes: str = "") -> str:
    """A pattern for the opening tag of one of ``tags`` with these attributes."""
    return rf"<(?:{tags})\b{attributes}[^>]*>"


def up_to(*ends: str) -> str:
    """A pattern for what comes before the first of ``ends``, each of which begins with <."""
    return rf"((?:[^<]++|<(?!{'|'.join(x[1:] for x in ends)}))*+)"


def inside_of(tags: str, attributes: str = "") -> str:
    """A pattern whose group is what follows an opening tag of one of ``tags``, up to its close or the next such tag."""
    tag = opening(tags, attributes)
    return "(?is)" + tag + up_to(rf"</(?:{tags})\s*>", tag)


def insides(html: Column, tags: str, attributes: str = "") -> Column:
    """What follows each opening tag of one of ``tags``, up to its close or the next such tag."""
    return F.regexp_extract_all(html, F.lit(inside_of(tags, attributes)), F.lit(1))


def present(c: Column) -> Column:
    """A text, null where it is empty."""
    return t.once(c, lambda x: F.when(x != "", x))


def element(html: Column, tags: str, attributes: str = "") -> Column:
    """Text of the first such element, null without one."""
    return present(plain(F.regexp_extract(html, inside_of(tags, attributes), 1)))


def elements(html: Column, tags: str, attributes: str = "") -> Column:
    return F.filter(F.transform(insides(html, tags, attributes), plain), lambda x: x != "")


ANY = "[a-z][a-z0-9]*"
COMPONENT = "data-sentry-component"


def region_of(name: str, value: str) -> str:
    """A pattern whose group is the end of a tag with this attribute and what follows, up to the next component or such tag."""
    tag, component = opening(ANY, has(name, value)), opening(ANY, rf"(?=[^>]*?{COMPONENT}(?<=\b{COMPONENT})=)")
    return "(?is)" + tag[:-1] + "(>" + up_to(component, *(() if name == COMPONENT else (tag,)))[1:]


def region(html: Column, name: str, value: str, last: bool = False) -> Column:
    """The page from behind the first (or last) tag with this attribute to the next component; null without one."""
    pattern = region_of(name, value)
    found = F.try_element_at(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.lit(-1)) if last else F.regexp_extract(html, pattern, 1)
    return t.once(found, lambda x: F.when(x != "", F.substr(x, F.lit(2))))


def said(low: Column, *marks: Mark) -> Column:
    """Whether a page, in small letters, has the values of all marks anywhere; without them no tag has."""
    return reduce(lambda a, b: a & b, (F.contains(low, F.lit(m[1].lower())) for m in marks))


def part(html: Column, low: Column, container: Mark, last: bool = False) -> Column:
    """The container's region; null without one."""
    return F.when(said(low, container), region(html, *container, last))


def located(html: Column, name: str, low: Column | None = None) -> Column:
    """Text at the first place of LOCATORS[name] that has one: the primary locator, else its fallbacks. ``low`` is the
    page in small letters, if it is at hand."""
    low = F.lower(html) if low is None else low
    found = []
    for container, tags, mark in LOCATORS[name]:
        inside = region(html, *container) if container else html
        text = element(inside, tags, has(*mark) if mark else "") if tags else present(plain(inside))
        signs = [m for m in (container, mark) if m]
        found.append(F.when(said(low, *signs), text) if signs else text)
    return F.coalesce(*found)


def blocks(html: Column) -> Column:
    """Cleaned texts of all h2, h3 and p, in page order."""
    return F.filter(F.transform(insides(html, BLOCKS), lambda x: t.clean_block(plain(x))), lambda x: x != "")


def panel_blocks(html: Column, name: str, low: Column | None = None) -> Column:
    """Text blocks of a panel: of the primary one where the page has it, else of the last open one."""
    low = F.lower(html) if low is None else low
    panels = [part(html, low, container, last=k > 0) if container else html for k, (container, _, _) in enumerate(LOCATORS[name])]
    return F.coalesce(*map(blocks, panels), F.array().cast("array<string>"))


def links(html: Column) -> Column:
    """Targets of all links, in page order."""
    return F.regexp_extract_all(html, F.lit(r'<a\b[^>]*?href="([^"]*)"'), F.lit(1))


def attribute_values(html: Column, tags: str, attributes: str, name: str) -> Column:
    """Values of an attribute of such tags, in page order; empty where a tag lacks it."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{tags})\b{attributes}[^>]*>"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_extract(x, rf'(?i)\b{name}="([^"]*)"', 1))


def cards(html: Column, base: str) -> Column:
    """Array of (name, href) of listing cards: the first h3 in each article, and its first link made absolute."""
    href = lambda x: t.once(F.get(links(x), 0), lambda u: t.absolute_url(u, base))
    return F.transform(insides(html, "article"), lambda x: F.struct(F.coalesce(element(x, "h3"), F.lit("")).alias("name"), href(x).alias("href")))


def challenged(html: Column, signs: tuple[str, ...] = CHALLENGE_SIGNS) -> Column:
    return t.once(F.lower(F.coalesce(html, F.lit(""))), lambda low: signed(low, signs))


def signed(low: Column, signs: tuple[str, ...] = CHALLENGE_SIGNS) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(s)) for s in signs))


def trail(html: Column, low: Column | None = None) -> Column:
    """Link texts of the page's breadcrumb, or of its navigation; none without either."""
    crumbs = part(html, F.lower(html) if low is None else low, LOCATORS["brand"][0][0])
    return elements(F.coalesce(crumbs, F.regexp_extract(html, inside_of("nav"), 1)), "a")


def breadcrumb(html: Column) -> tuple[Column, Column]:
    """First and last link text of the page's breadcrumb: brand and category."""
    found = trail(html)
    return F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(-1))


def prices(struck: Column, final: Column, discount: Column) -> Column:
    """struct(real_price, discounted_price, has_discount, discount_percentage): a struck price means a discount."""

    def both(v: Column) -> Column:
        has, less = v["struck"].isNotNull(), F.when(v["struck"].isNotNull(), v["final"])
        return F.struct(F.coalesce(v["struck"], v["final"]).alias("real_price"), less.alias("discounted_price"), has.alias("has_discount"), F.when(has, t.first_integer(discount)).alias("discount_percentage"))

    return t.once(F.struct(t.parse_price(struck).alias("struck"), t.parse_price(final).alias("final")), both)


def out_of_stock_flag(html: Column, low: Column | None = None) -> tuple[Column, Column]:
    """(is_out_of_stuck as recorded, true where the unavailable sentence is absent; in_stock, which says so)."""
    box = F.coalesce(part(html, F.lower(html) if low is None else low, LOCATORS["buy_box"][0][0]), html, F.lit(""))
    absent = ~F.contains(box, F.lit(UNAVAILABLE))
    return absent, absent


#: What marks the gallery's figures and a colour's button.
GALLERY, COLOUR = ("aria-label", "open-gallery-modal"), (COMPONENT, "ColorVariant")


def gallery(html: Column) -> Column:
    """Sources of the gallery's images in full size. A source is left out if an earlier one was turned into it."""
    figures = F.array_join(insides(html, "figure", has(*GALLERY)), " ")
    found = F.filter(attribute_values(figures, "img", "", "src"), lambda x: x != "")
    pairs = F.transform(found, lambda x: F.struct(x.alias("source"), t.upscale_image(x).alias("large")))
    return t.once(pairs, lambda p: F.filter(p, lambda x, i: ~F.array_contains(F.slice(p["large"], 1, i), x["source"]))["large"])


def images(labels: Column, urls: Column) -> Column:
    """Map from colour label, or color_i, to its images in full size; of equal labels the last counts."""
    named = F.transform(labels, lambda x, i: F.when(F.coalesce(F.trim(x), F.lit("")) == "", F.concat(F.lit("color_"), i.cast("string"))).otherwise(F.trim(x)))
    entries = F.zip_with(named, urls, lambda k, v: F.struct(k.alias("key"), F.transform(v, lambda u: t.upscale_image(u)).alias("value")))
    last = lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(t.once(entries, last))


def page_images(html: Column, low: Column | None = None) -> Column:
    """Image map of one captured page: its gallery under each colour label, or under ``default`` without colours."""
    low = F.lower(html) if low is None else low
    none = F.array().cast("array<string>")
    labels = F.coalesce(F.when(said(low, COLOUR), attribute_values(html, ANY, has(*COLOUR), "aria-label")), none)
    shown = F.coalesce(F.when(said(low, GALLERY), gallery(html)), none)

    def mapped(v: Column) -> Column:
        plain_map = F.map_from_entries(F.array(F.struct(F.lit("default").alias("key"), v["shown"].alias("value"))))
        return F.when(F.size(v["labels"]) == 0, plain_map).otherwise(images(v["labels"], F.transform(v["labels"], lambda _: v["shown"])))

    return F.when(html.isNotNull(), t.once(F.struct(labels.alias("labels"), shown.alias("shown")), mapped))


def image_plan(images: Column, base: str) -> Column:
    """Images to fetch: array of (image_id, url), each distinct source once, relative ones joined to ``base``.

    Ids are hashes of the urls, so that a repeated run fetches nothing under a new name.
    """
    urls = F.transform(state.ordered_distinct(F.flatten(F.map_values(images))), lambda u: t.joined_url(u, base))
    return F.transform(urls, lambda u: F.struct(state.stable_id(u).alias("image_id"), u.alias("url")))


PRODUCT = (
    "url string, query_name string, product_id string, name_fa string, name_en string, brand string, category string, rate double, review_count int, wishlist_count int, is_out_of_stuck boolean, in_stock boolean, has_discount boolean, "
    "discount_percentage int, real_price bigint, discounted_price bigint, image_urls map<string,array<string>>, image_ids array<string>, product_intro array<string>, usage_instructions array<string>, error string"
)


def product(html: Column, url: Column, query: Column, base: str = "https://example.com/") -> Column:
    """One record of a page (PRODUCT). Missing texts are empty, missing numbers null; a page that isn't a
    product's has its reason in ``error`` and is kept."""
    texts = ("name_fa", "name_en", "rate", "reviews", "wishlist")

    def found(page: Column) -> Column:
        html, low = page["html"], page["low"]
        error = F.when(F.trim(html) == "", F.lit("empty page")).when(signed(low), F.lit("challenge page"))
        price = prices(*(located(html, x, low) for x in ("struck", "price", "discount")))
        return F.struct(
            *(located(html, x, low).alias(x) for x in texts), price.alias("price"), trail(html, low).alias("trail"), page_images(html, low).alias("images"), out_of_stock_flag(html, low)[0].alias("flagged"),
            panel_blocks(html, "intro", low).alias("intro"), panel_blocks(html, "usage", low).alias("usage"), error.alias("error"),
        )

    def record(v: Column) -> Column:
        text = lambda c: F.coalesce(c, F.lit(""))
        price = v["price"]
        return F.struct(
            url.alias("url"), query.alias("query_name"), state.stable_id(F.coalesce(url, F.lit(""))).alias("product_id"), text(v["name_fa"]).alias("name_fa"), text(v["name_en"]).alias("name_en"),
            text(F.try_element_at(v["trail"], F.lit(1))).alias("brand"), text(F.try_element_at(v["trail"], F.lit(-1))).alias("category"), t.first_decimal(v["rate"]).alias("rate"), t.first_integer(v["reviews"]).alias("review_count"), t.first_integer(v["wishlist"]).alias("wishlist_count"),
            v["flagged"].alias("is_out_of_stuck"), v["flagged"].alias("in_stock"), price["has_discount"].alias("has_discount"), price["discount_percentage"].alias("discount_percentage"), price["real_price"].alias("real_price"), price["discounted_price"].alias("discounted_price"),
            v["images"].alias("image_urls"), F.transform(image_plan(v["images"], base), lambda x: x["image_id"]).alias("image_ids"), v["intro"].alias("product_intro"), v["usage"].alias("usage_instructions"), v["error"].alias("error"),
        )

    page = t.once(F.coalesce(html, F.lit("")), lambda x: F.struct(x.alias("html"), F.lower(x).alias("low")))
    return t.once(t.once(page, found), record)


def failure(url: Column, query: Column, reason: Column) -> Column:
    """The record of a page that could not be had after all attempts: its url, query and error alone."""
    empty = {"name_fa", "name_en", "brand", "category"}
    given = {"url": url, "query_name": query, "product_id": state.stable_id(F.coalesce(url, F.lit(""))), "error": F.coalesce(F.nullif(F.trim(reason), F.lit("")), F.lit("unknown error"))}
    fields = [x.strip().split(" ", 1) for x in PRODUCT.replace("map<string,array<string>>", "map").split(",")]
    blank = {"map": "map<string,array<string>>"}

    def value(name: str, kind: str) -> Column:
        kind = blank.get(kind, kind)
        if name in given:
            return given[name]
        if name in empty:
            return F.lit("")
        if kind == "boolean":
            return F.lit(False)
        if kind.startswith("array"):
            return F.array().cast(kind)
        return F.create_map().cast(kind) if kind.startswith("map") else F.lit(None).cast(kind)

    return F.struct(*(value(name, kind).alias(name) for name, kind in fields))


class _Blocks(HTMLParser):
    """Texts of h2, h3 and p; an open one ends where another begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.open: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("h2", "h3", "p"):
            self.end()
            self.open = []

    def handle_endtag(self, tag):
        if tag in ("h2", "h3", "p"):
            self.end()

    def handle_data(self, data):
        if self.open is not None:
            self.open.append(data)

    def end(self):
        if self.open is not None:
            self.found.append("".join(self.open))
            self.open = None


def raw_blocks(page: str | None) -> list[str]:
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    parser.end()
    return parser.found


def blocks_exact(html: Column) -> Column:
    """Like ``blocks``, with a parser that also knows scripts, comments and all entities."""

    def walk(pages: pd.Series) -> pd.Series:
        return pages.map(raw_blocks)

    return F.filter(F.transform(F.pandas_udf(walk, "array<string>")(html), t.clean_block), lambda x: x != "")
