"""Whole records of product pages: what a page costs, and where its fields are looked for."""

import os
import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F
from samples import LEXICON

from vitrine.operators import extract, sql
from vitrine.plans import registry
from vitrine.sources import stores

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["html_record", "html_record_sql"])
def test_pages_are_not_stored(spark, name):
    """Parts are spread over tasks and a page is made where it is read: none is shuffled or written."""
    folder = stores.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert registry.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()
    assert {x for x in os.listdir(folder) if x.startswith("pages")} <= before if os.path.isdir(folder) else True


def test_many_colours_and_pictures(spark):
    """The gallery and the labels are worked out once, not for each pair of labels."""
    some = 60
    html = "".join(f'<figure aria-label="open-gallery-modal"><img src="/{k}.jpg?w=1"></figure>' for k in range(some))
    html += "".join(f'<button data-sentry-component="ColorVariant" aria-label="c{k}"></button>' for k in range(some))
    frame = spark.createDataFrame([(html,)], "html string").select(extract.product(F.col("html"), F.lit("u"), F.lit("q")).alias("r"))
    began = time.perf_counter()
    found = frame.first().r
    assert time.perf_counter() - began < 20
    assert found.image_urls == {f"c{k}": [f"/{n}.jpg?w=800" for n in range(some)] for k in range(some)} and len(found.image_ids) == some


ODD = [
    '<SPAN CLASS="RATE">4</SPAN><div DATA-SENTRY-COMPONENT="starrate"><span>۳.۵</span></div>',  # names and values in any case
    '<span title="rate" class="x">1</span><span xclass="rate">2</span><span class="rates">3</span><span class="a rate b">4</span>',
    '<p class="[&>p]:mt-2 rate">x</p><span class="[&>p]:mt-2 rate">5</span>',  # a > within an attribute ends the tag
    '<div data-sentry-component="StarRate"></div><span class="rate">6</span>',  # a container without text: the next place
    '<div data-headlessui-state="open"><p>a</p></div><div data-headlessui-state="open"><p>b<p<p>c<h2>d</div><i data-sentry-component=X><p>e',
    '<div data-sentry-component="HowToUse"></div><div data-headlessui-state="open"><p>a</p></div>',  # a panel ends at the next component
    '<div data-test="pdp-buy-box"></div><div data-sentry-component="X">این محصول ناموجود است</div>',
]


def test_odd_places(spark):
    frame = spark.createDataFrame(list(enumerate(ODD)), "k int, html string")
    own = [r.r for r in frame.select("k", extract.product(F.col("html"), F.lit("u"), F.lit("q")).alias("r")).orderBy("k").collect()]
    assert [r.rate for r in own] == [3.5, 4.0, 2.0, 6.0, None, None, None]
    assert [list(r.usage_instructions) for r in own[4:]] == [["b", "c", "d"], ["a"], []] and own[6].in_stock
    sql.register(spark, LEXICON)
    frame.createOrReplaceTempView("odd_pages")
    assert [r.r for r in spark.sql("SELECT k, extract_product(html, 'u', 'q') AS r FROM odd_pages").orderBy("k").collect()] == own


def test_a_null_page_has_no_images(spark):
    assert spark.range(1).select(extract.page_images(F.lit(None).cast("string"))).first()[0] is None


@pytest.mark.parametrize("base", ["https://shop.example/c/list", "http://h:80/a/b?c#d", "https://shop.example", ""])
def test_plain_references_are_joined_like_others(base):
    found = ["/i/1.jpg?w=800", "https://cdn.example/1.png", "http://cdn.example/a?b=1", "/a/../b", "//cdn.example/z", "/a?", "/a#", "/a;p", "/.", "b.jpg", "", "/a\n", "https://h", "HTTPS://h/a"]
    assert [sql.joined(base, x) for x in found] == [urljoin(base, x) for x in found]
