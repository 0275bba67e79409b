"""Matching rules, stores, pages, relaxation and streams on small rows."""

import json
import struct
import time
import zipfile
import zlib

import numpy as np
import pytest
from samples import LEXICON
from pyspark.sql import functions as F

from vitrine.operators import extract, matching, pictures, relax, sql, state
from vitrine.sources import stores
from vitrine.streaming.incremental import match_stream, new_urls, read_matches

CASES = [
    ([(0.9, 0.95, "u1")], ["u1"], ["u1"]),
    ([(0.9, 0.9, "u1"), (0.8, 0.99, "u2")], ["u1", "u2"], ["u1", "u2"]),
    ([(0.5, 0.9, "u1")], [], ["u1"]),
    ([(0.5, 0.8, "u1"), (0.4, 0.9, "u2")], ["u2"], ["u2"]),
    ([(0.9, 0.9, "u1"), (0.9, 0.9, "u2")], ["u1"], ["u1"]),
    ([], [], []),
]


@pytest.mark.parametrize("cards,parity,fixed", CASES)
def test_emitted(spark, cards, parity, fixed):
    rows = spark.createDataFrame([("r", 1, k, u, a, m) for k, (a, m, u) in enumerate(cards)], "row_id string, page_num int, pos int, href string, avg_score double, max_score double")
    for flag, want in ((True, parity), (False, fixed)):
        assert sorted(r.href for r in matching.emitted(rows, "row_id", ["page_num", "pos"], "href", flag).collect()) == want


def test_candidates(spark):
    targets = spark.createDataFrame([("r", "t", ["n1", None])], "row_id string, title string, names array<string>")
    cards = spark.createDataFrame([("r", 1, 0, "a", "/p"), ("r", 31, 0, "b", "/q"), ("r", 1, 1, "c", None), ("s", 1, 0, "d", "/r")], "row_id string, page_num int, pos int, name string, href string")
    assert [(r.name, r.target_name) for r in matching.candidates(targets, cards).orderBy("name_pos").collect()] == [("a", "t"), ("a", "n1"), ("a", None)]


def test_ensemble_keeps_cards_without_hit(spark):
    pairs = spark.createDataFrame([("c", 0.1, 0.2, 0.3), ("d", 0.61, 0.0, 0.0), ("d", 0.5, 0.5, 0.5)], "card string, a double, b double, c double")
    assert {r.card: (round(r.avg_score, 4), r.max_score) for r in matching.ensemble(pairs, ["card"], ("a", "b", "c")).collect()} == {"c": (0.0, 0.0), "d": (0.2033, 0.61)}


def test_row_id_and_update(spark):
    rows = spark.createDataFrame([("a\nb", "q"), (None, None)], "t string, q string")
    assert [r[0] for r in rows.select(state.row_id(F.col("t"), F.col("q"))).collect()] == ["a b::q", "None::None"]
    entries = spark.createDataFrame([(1, "u", None, None), (2, "u", None, None), (3, "v", False, None)], "n int, product_url string, is_scraped boolean, scrap_directory string")
    updates = spark.createDataFrame([("u", "d"), ("w", "e")], "product_url string, scrap_directory string")
    assert sorted((r.n, r.is_scraped, r.scrap_directory) for r in state.first_match_update(entries, updates, "product_url", ["n"]).collect()) == [(1, True, "d"), (2, None, None), (3, False, None)]
    assert state.pending(entries).count() == 3


def test_stores(spark, tmp_path):
    assert stores.read_entries(spark, str(tmp_path / "none.json")).count() == 0
    entry = {"product_url": "u", "avg_similarity_score": 0.9}
    (tmp_path / "entries.json").write_text(json.dumps([entry, entry]))
    assert [r.product_url for r in stores.read_entries(spark, str(tmp_path / "entries.json")).collect()] == ["u", "u"]
    for body in ("[{", "", "null", json.dumps(entry), '"x"', "[1, 2"):  # broken, and not an array
        (tmp_path / "broken.json").write_text(body)
        assert stores.read_entries(spark, str(tmp_path / "broken.json")).count() == 0, body
    (tmp_path / "bare.json").write_text('\n [{"search_query": "q"}]')
    assert [(r.search_query, r.product_url) for r in stores.read_entries(spark, str(tmp_path / "bare.json")).collect()] == [("q", None)]
    for k, body in enumerate(('{"url": "a"}', '{"url": ""}', "{", '{"url": "a"}')):
        (tmp_path / "result" / str(k)).mkdir(parents=True)
        (tmp_path / "result" / str(k) / "metadata.json").write_text(body)
    assert [r.url for r in stores.read_scraped_urls(spark, str(tmp_path / "result")).collect()] == ["a"]
    (tmp_path / "state.txt").write_text("x\ny\nx\n\n")
    assert sorted(r.row_id for r in stores.read_state(spark, str(tmp_path / "state.txt")).collect()) == ["x", "y"]
    stores.replace_table(spark.range(3), str(tmp_path / "table"))
    stores.replace_table(spark.range(2), str(tmp_path / "table"))
    assert stores.read_table(spark, str(tmp_path / "table")).count() == 2


def sheet_xml(rows, numbers=None):
    numbers = numbers or range(1, len(rows) + 1)
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(64 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r, 1) if v is not None) + "</row>" for i, r in zip(numbers, rows, strict=True))
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'


def sheet(path, rows):
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", sheet_xml(rows))


def test_sheet_order_and_row_numbers(spark, tmp_path):
    main, relations = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{relations}"><sheets><sheet name="b" sheetId="2" r:id="rId7"/><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="worksheets/sheet10.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", sheet_xml([["title"], ["wrong"]]))
        book.writestr("xl/worksheets/sheet10.xml", sheet_xml([["title", "q"], ["x", None], [None, "y"], ["z"]], [1, 2, 5, 9]))
    rows = stores.read_sheet(spark, str(tmp_path / "book.xlsx")).collect()
    assert sorted((r.row_num, r.cells) for r in rows) == [(2, {"title": "x"}), (5, {"q": "y"}), (9, {"title": "z"})]
    with zipfile.ZipFile(tmp_path / "plain.xlsx", "w") as book:  # without a workbook part the smallest number is first
        for k in (10, 2):
            book.writestr(f"xl/worksheets/sheet{k}.xml", sheet_xml([["title"], [f"s{k}"]]))
    assert [r.cells for r in stores.read_sheet(spark, str(tmp_path / "plain.xlsx")).collect()] == [{"title": "s2"}]


def chunked(*parts):
    return pictures.SIGNATURE + b"".join(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in parts)


def drawn(width, height, depth, colour, rows, *more):
    return chunked((b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)), *more, (b"IDAT", zlib.compress(rows)), (b"IEND", b""))


def test_png_kinds():
    table = b"\x01\x02\x03\x04\x05\x06"
    palette = drawn(3, 1, 1, 3, b"\x00\xa0", (b"PLTE", table), (b"tRNS", b"\x07"))
    assert pictures.decode_png(palette).tolist() == [[[4, 5, 6, 255], [1, 2, 3, 7], [4, 5, 6, 255]]]
    assert pictures.decode_png(drawn(2, 1, 8, 4, b"\x00\x09\x08\x07\x06")).tolist() == [[[9, 9, 9, 8], [7, 7, 7, 6]]]
    assert pictures.decode_png(drawn(1, 1, 16, 0, b"\x00\xab\xcd")).tolist() == [[[0xAB] * 3]]
    assert pictures.decode_png(drawn(4, 1, 2, 0, b"\x00\x1b")).tolist() == [[[0] * 3, [85] * 3, [170] * 3, [255] * 3]]
    for raw in (b"", b"not an image", palette[:-20], pictures.SIGNATURE, None):
        assert pictures.to_png(raw) == raw
    again = pictures.to_png(palette)
    assert again != palette and pictures.decode_png(again).tolist() == pictures.decode_png(palette).tolist() and pictures.to_png(again) == again


@pytest.mark.parametrize("channels", [3, 4])
def test_png_filters(channels):
    """Rows under each of the five filters, made by their definitions, come back."""
    draw = np.random.default_rng(channels)
    pixels = draw.integers(0, 256, (10, 7, channels), dtype=np.uint8)
    flat = pixels.reshape(10, -1).astype(int)
    rows = b""
    for y, row in enumerate(flat):
        up = flat[y - 1] if y else np.zeros_like(row)
        left, corner = (np.concatenate([np.zeros(channels, int), x[:-channels]]) for x in (row, up))
        p = left + up - corner
        near = np.abs(np.stack([p - left, p - up, p - corner]))
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        guess = (np.zeros_like(row), left, up, (left + up) // 2, paeth)[y % 5]
        rows += bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    assert (pictures.decode_png(drawn(7, 10, 8, 2 if channels == 3 else 6, rows)) == pixels).all()


def test_images_are_read_by_their_ids(spark, tmp_path):
    plan = spark.createDataFrame([({"default": ["/a.jpg", "", "https://c/b.png", "/a.jpg"]},)], "m map<string,array<string>>").select(F.inline(extract.image_plan(F.col("m"), "https://s.example/x/y")))
    ids = {r.url: r.image_id for r in plan.collect()}
    assert set(ids) == {"https://s.example/a.jpg", "https://c/b.png"}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / f"{ids['https://c/b.png']}.png").write_bytes(b"raw")
    (tmp_path / f"{ids['https://s.example/a.jpg']}.jpg").write_bytes(b"")
    assert {r.url: r.raw and bytes(r.raw) for r in stores.read_images(spark, str(tmp_path), plan).collect()} == {"https://c/b.png": b"raw", "https://s.example/a.jpg": None}


def test_sheet(spark, tmp_path):
    head = stores.COLUMNS
    sheet(tmp_path / "book.xlsx", [head, ["-", "t1", "q", "n1", "n2", "n3"], ["-", "t2", "q", "n1", "n2", "NaN"], ["-", "t3", "q", None, "n2", "n3"], ["-", "t4", "q", "n1", "n2", None]])
    raw = stores.read_sheet(spark, str(tmp_path / "book.xlsx"))
    wide = raw.select(*(F.col("cells")[c].alias(c) for c in head))
    got = sorted((r.title, r.names) for r in stores.targets(wide).collect())
    assert got == [("t1", ["n1", "n2", "n3", None, None]), ("t3", [None, "n2", "n3", None, None])]


PAGE = """<html><nav><a href="/">Brand</a><a href="/c">Category</a></nav><h1> نام </h1><span class="name-en">Name</span><span class="rate">۴.۵</span>
<span class="reviews">12 نظر</span><del>۱۲۰٬۰۰۰</del><span class="price">۹۰٬۰۰۰ تومان</span><span class="discount">25%</span>
<h2>T&amp;T</h2><p>a • b</p><p></p><h3>x</h3><article><h3>Card</h3><a href="/p/1">go</a></article></html>"""


def test_product(spark):
    frame = spark.createDataFrame([(PAGE,)], "html string")
    row = frame.select(extract.product(F.col("html"), F.lit("u"), F.lit("q")).alias("r"), extract.cards(F.col("html"), "https://s/").alias("cards"), extract.blocks_exact(F.col("html")).alias("exact")).first()
    r = row.r
    assert (r.name_fa, r.name_en, r.brand, r.category, r.rate, r.review_count) == ("نام", "Name", "Brand", "Category", 4.5, 12)
    assert (r.real_price, r.discounted_price, r.has_discount, r.discount_percentage) == (120000, 90000, True, 25)
    assert list(r.product_intro) == ["T&T", "a b", "x", "Card"] == list(row.exact)
    assert [(c.name, c.href) for c in row.cards] == [("Card", "https://s/p/1")]
    assert r.error is None and r.in_stock


def test_images_last_label_wins(spark):
    frame = spark.createDataFrame([(["red", "", "red"], [["a?w=1"], ["b"], ["c?w=2"]])], "k array<string>, v array<array<string>>")
    assert frame.select(extract.images(F.col("k"), F.col("v"))).first()[0] == {"color_1": ["b"], "red": ["c?w=800"]}


def test_relaxation(spark):
    rows = relax.by_rules(spark.createDataFrame([("کرم NC۲۵ 50 میلی لیتر",)], "title string"))
    checks = rows.select(relax.query_ok(F.col(relax.CELLS[0])), relax.names_ok(F.col("title"), *(F.col(c) for c in relax.CELLS[1:]))).first()
    assert list(checks) == [True, True]
    parsed = spark.createDataFrame([('{"normalized_search_query": "q"}',), ("{",), (json.dumps({c: "x" for c in relax.CELLS}),)], "j string").select(relax.parse_results(F.col("j")).alias("r")).collect()
    assert [p.r is not None for p in parsed] == [False, False, True]


def test_stream_resumes(spark, tmp_path):
    source, sink, progress = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.range(3).coalesce(1).write.parquet(source)
    run = lambda: match_stream(spark.readStream.schema("id long").parquet(source), lambda b: b.where("id > 0"), sink, progress).awaitTermination()
    run()
    run()
    assert read_matches(spark, sink).count() == 2
    spark.range(5, 7).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r.id for r in read_matches(spark, sink).collect()) == [1, 2, 5, 6]


def test_outcomes(spark, tmp_path):
    rows = spark.createDataFrame([("e", "n"), ("  ", "n"), (None, " ")], "error string, name string").withColumn("is_failed", state.is_failed(F.col("error"), F.col("name")))
    state.save_by_outcome(rows, str(tmp_path / "o"))
    assert sorted(p.name for p in (tmp_path / "o").iterdir() if p.is_dir()) == ["is_failed=false", "is_failed=true"]
    assert list(state.run_counts(rows).first()) == [3, 1, 2]


def test_first_update_of_a_hot_key(spark):
    """Blank urls, however many, are updated by nothing, and ties of the order's first column go to its next."""
    entries = spark.createDataFrame([(1, k, "") for k in range(50)] + [(2, 2, "u"), (2, 1, "u"), (3, 0, "u"), (4, 0, None)], "day int, n int, product_url string").withColumns({"is_scraped": F.lit(None).cast("boolean"), "scrap_directory": F.lit("old")})
    updates = spark.createDataFrame([("", "d0"), ("u", "d2"), ("u", "d1"), (None, "d3"), ("gone", "d4")], "product_url string, scrap_directory string")
    rows = state.first_match_update(entries, updates, "product_url", ["day", "n"]).collect()
    assert len(rows) == 54 and [(r.day, r.n, r.scrap_directory) for r in rows if r.is_scraped] == [(2, 1, "d1")]
    assert [r.product_url for r in state.unmatched_updates(entries, updates.where("product_url <> ''"), "product_url").collect()] == ["gone"]
    assert entries.columns == state.first_match_update(entries, updates, "product_url", ["day", "n"]).columns


HOSTILE = ["<p>" * 200_000, "<h1>" * 100_000 + "x", "<article><h3>a" * 20_000, "<" * 300_000, "", None, "<p class='" + "x" * 100_000]


def test_hostile_pages_take_linear_time(spark):
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(HOSTILE)], "k int, html string").coalesce(1)
    began = time.perf_counter()
    rows = frame.select("k", extract.product(F.col("html"), F.lit("u"), F.lit("q")).alias("r"), F.size(extract.cards(F.col("html"), "https://s/")).alias("cards")).collect()
    assert time.perf_counter() - began < 60 and rows[2].cards == 20_000
    assert [r.r.error for r in rows] == [None, None, None, None, "empty page", "empty page", None]


def test_sql_functions_agree_with_columns(spark):
    sql.register(spark, LEXICON, "https://s.example/a/")
    pages = [PAGE, "", None, "<p>open<p>next &amp; more", PAGE.replace("</del>", "").replace("<nav>", "<nav"), '<div data-sentry-component="StarRate"><span>۴٫۵ 3.2.1</span></div><h1></h1><span class="price">99999999999999999999</span>']
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(pages)], "k int, html string")
    frame.createOrReplaceTempView("some_pages")
    own = frame.select("k", extract.product(F.col("html"), F.lit("u"), F.lit("q"), "https://s.example/a/").alias("r"))
    assert sorted(spark.sql("SELECT k, extract_product(html, 'u', 'q') AS r FROM some_pages").collect()) == sorted(own.collect())
    cards = frame.select("k", F.posexplode(extract.cards(F.col("html"), "https://s/")).alias("pos", "c")).select("k", "pos", "c.*")
    assert sorted(spark.sql("SELECT k, pos, name, href FROM some_pages, LATERAL explode_cards(html, 'https://s/')").collect()) == sorted(cards.collect())


def test_stream_with_a_new_checkpoint_adds(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(4).repartition(2).write.parquet(source)
    for k in range(2):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        match_stream(stream, lambda b: b, sink, str(tmp_path / f"state{k}")).awaitTermination()
    found = read_matches(spark, sink)
    assert sorted(r.id for r in found.collect()) == [0, 0, 1, 1, 2, 2, 3, 3] and found.select("query").distinct().count() == 2 and found.select("query", "batch").distinct().count() == 4


def test_stream_of_new_urls(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in (["a", "b", "a", ""], ["b", "c", None]):
        spark.createDataFrame([(x,) for x in part], "product_url string").coalesce(1).write.mode("append").parquet(source)
        rows = new_urls(spark.readStream.schema("product_url string").parquet(source))
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.product_url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stores.shared_folder(Session())
