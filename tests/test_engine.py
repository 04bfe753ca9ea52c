"""Golden cases of text functions, layout, chapters, covers, rasters and PDF parsing, and queries against DuckDB."""

import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import wrap
from quire.functions.wrap import drawn_cover, with_lines, wrap_text
from quire.operators import covers as C
from quire.operators import glyphs as G
from quire.operators import layout as L
from quire.plans import registry
from quire.sources import filters, fonts, pdf, raster

SMALL = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(("raw", "text"), [("a & b < c > d", "a &amp; b &lt; c &gt; d"), ('a"b', "a&quot;b"), ("it's", "it's")])
def test_escape(spark, raw, text):
    assert one(spark, T.escape_html(F.lit(raw))) == text


@pytest.mark.parametrize(("raw", "text"), [("feff0043006f0072006100e700e3006f", "Coração"), ("436f7261e7e36f", "Coração"), ("feff", ""), ("feff004100", "A"), ("feffd8000041", "\ufffdA")])
def test_pdf_string(raw, text):
    assert pdf.pdf_text(bytes.fromhex(raw)) == text


@pytest.mark.parametrize(
    ("path", "title", "epub"),
    [("/livros/Meu Livro.pdf", "Meu Livro", "Meu Livro.epub"), ("vol.2.final.pdf", "vol.2.final", "vol.2.final.epub"), ("/", "Documento", "livro.epub"), (".hidden", ".hidden", ".hidden.epub")],
)
def test_names(spark, path, title, epub):
    assert (one(spark, T.file_title(F.lit(path))), one(spark, T.epub_name(F.lit(path)))) == (title, epub)


def test_data_uri(spark):
    assert one(spark, T.data_uri(F.lit("image/png"), F.lit(b"abc"))) == "data:image/png;base64,YWJj"
    assert "\n" not in one(spark, T.data_uri(F.lit("image/png"), F.lit(b"x" * 200)))


EVENTS = "doc_id long, page_num int, arrival_seq int, y double, is_image int, text string, font_size double, x_start double, image_idx int"


def flow(spark, rows):
    """rows: (page, y, text or image number, font, x)"""
    out = [(1, p, k, float(y), int(isinstance(t, int)), None if isinstance(t, int) else t, float(f), float(x), t if isinstance(t, int) else None) for k, (p, y, t, f, x) in enumerate(rows)]
    return spark.range(1, 2).toDF("doc_id"), L.ordered(spark.createDataFrame(out, EVENTS))


def block_list(spark, rows, metrics=(15.0, 0.12, 19.5)):
    docs, events = flow(spark, rows)
    body = events.withColumns({"chapter_id": F.lit(0), "is_heading": F.lit(False), "consumed_image": F.lit(None).cast("int")})
    body = body.withColumns({n: F.lit(v) for n, v in zip(("baseline_font", "left_margin", "line_gap"), metrics)})
    found = L.blocks(L.classified(body)).orderBy("block_ord").collect()
    return [(r["kind"], r["text"] if r["kind"] != "image" else r["image_idx"]) for r in found]


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([(1, 10, "uma linha", 15, 0.12), (1, 29.5, "e outra", 15, 0.12)], [("paragraph", "uma linha e outra")]),
        ([(1, 10, "a", 15, 0.12), (1, 29.5, "b", 15, 0.15), (1, 49, "c", 15, 0.12)], [("paragraph", "a"), ("paragraph", "b c")]),
        ([(1, 700, "a", 15, 0.12), (2, 60, "b", 15, 0.12)], [("paragraph", "a b")]),
        ([(1, 10, "a", 15, 0.12), (1, 49, "b", 15, 0.12)], [("paragraph", "a"), ("paragraph", "b")]),
        ([(1, 10, "a", 15, 0.12), (1, 30, "Title", 20, 0.12), (1, 50, "b", 15, 0.12)], [("paragraph", "a"), ("heading", "Title"), ("paragraph", "b")]),
        ([(1, 10, "» » »", 20, 0.12)], [("paragraph", "» » »")]),
        ([(1, 10, "One", 20, 0.12), (1, 40, "two", 20, 0.12)], [("heading", "One two")]),
        ([(1, 10, 3, 0, 0), (1, 20, "cap", 12, 0.3), (1, 40, "b", 15, 0.12)], [("image", 3), ("caption", "cap"), ("paragraph", "b")]),
        ([(1, 10, "a", 15, 0.12), (1, 29.5, "(um autor)", 15, 0.62)], [("paragraph", "a"), ("right", "(um autor)")]),
        ([(1, 10, "a", 15, 0.12), (1, 20, 0, 0, 0), (1, 29.5, "b", 15, 0.12)], [("paragraph", "a"), ("image", 0), ("paragraph", "b")]),
        ([(1, 10, "   ", 15, 0.12), (1, 20, "\t", 15, 0.12)], []),
    ],
)
def test_blocks(spark, rows, expected):
    assert block_list(spark, rows) == expected


def chapter_list(spark, rows):
    docs, events = flow(spark, rows)
    return [(r["title"], r["n_events"]) for r in L.chapters(L.chapter_events(L.profile(docs, events).join(events, "doc_id", "left"))).orderBy("chapter_ord").collect()]


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([(1, 1, "a", 10, 0), (1, 2, "b", 10, 0)], [("Introdução", 2)]),
        ([(1, 1, "a", 10, 0), (1, 2, "CAPÍTULO 2", 10, 0), (1, 3, "b", 10, 0)], [("Introdução", 1), ("CAPÍTULO 2", 1)]),
        ([(1, 1, "Capítulo 1", 10, 0), (1, 2, 0, 0, 0), (1, 3, "part 6", 10, 0), (1, 4, 1, 0, 0)], [("Capítulo 1", 1), ("part 6", 1)]),
        ([(1, 1, "a", 10, 0), (1, 2, "b", 10, 0), (1, 3, "T1", 20, 0), (1, 4, "T2", 20, 0), (1, 5, "c", 10, 0), (1, 6, "d", 10, 0)], [("Introdução", 2), ("T1 T2", 2)]),
        ([(1, 1, "a", 10, 0), (1, 2, "Capítulo 9", 10, 0)], [("Introdução", 1)]),
        ([(1, 1, "x" * 120, 20, 0), (1, 2, "a", 10, 0), (1, 3, "a", 10, 0)], [("Introdução", 3)]),
        ([(1, k, "a", 0, 0) for k in range(3)], [("Introdução", 3)]),
        ([], [("Introdução", 0)]),
    ],
)
def test_chapters(spark, rows, expected):
    assert chapter_list(spark, rows) == expected


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([], (1.0, 0.0, 1.0, 1.0)),
        ([(1, 10, "  ", 15, 0.3), (1, 20, "\t", 12, 0.4)], (1.0, 0.0, 1.0, 15.0)),  # blank lines only
        ([(1, 10, 0, 0, 0)], (1.0, 0.0, 1.0, 1.0)),
        ([(1, 10, "a", 0, 0.2)], (L.SMALLEST, 0.2, L.SMALLEST, 0.0)),
        ([(1, 10, "a", 12, 0.2), (2, 5, "b", 10, 0.1), (2, 25, "c", 14, 0.3), (2, 25, "d", 14, 0.3)], (14.0, 0.1, 20.0, 14.0)),
    ],
)
def test_metrics(spark, rows, expected):
    docs, events = flow(spark, rows)
    r = L.profile(docs, events).first()
    assert (r["baseline_font"], r["left_margin"], r["line_gap"], r["baseline"]) == expected
    numbers = L.profile_rows(docs, events)
    assert L.body_font(numbers).count() == L.left_margin(numbers).count() == int(any(isinstance(t, str) and t.strip() for _, _, t, _, _ in rows))


@pytest.mark.parametrize(
    ("sizes", "expected"),
    [
        ([(1, 400, 600), (1, 900, 1400), (1, 500, 800)], ("detected", 1, 900)),
        ([(1, 120, 60)], ("drawn", None, 1600)),
        ([(1, 1000, 390), (1, 400, 500), (2, 900, 1400)], ("detected", 2, 900)),
        ([(1, 700, 700), (1, 700, 700)], ("detected", 1, 700)),
        ([(3, 900, 1400)], ("drawn", None, 1600)),
    ],
)
def test_covers(spark, sizes, expected):
    docs, events = flow(spark, [(p, k, k, 0, 0) for k, (p, _, _) in enumerate(sizes)])
    images = spark.createDataFrame([(1, k, f"i{k}.jpg", "image/jpeg", w, h) for k, (_, w, h) in enumerate(sizes)], "doc_id long, image_idx int, filename string, mime string, width int, height int")
    pages = spark.createDataFrame([(1, p) for p in range(1, 4)], "doc_id long, page_num int")
    row = C.select_covers(L.profile(docs, events, images, pages)).first()
    assert (row["source"], row["consumed_image"], row["width"]) == expected


def test_resources(spark):
    images = spark.createDataFrame([(1, k, n) for k, n in enumerate(["a", "b", "a"])], "doc_id long, image_idx int, filename string")
    for consumed, left in ((None, [0, 1]), (0, [1, 2])):
        covers = spark.createDataFrame([(1, consumed)], "doc_id long, consumed_image int")
        assert sorted(r["image_idx"] for r in C.resources(images, covers).collect()) == left


def test_rasters():
    corners = bytes([255, 0, 0, 0, 0, 255, 0, 0, 0, 0, 255, 0, 0, 0, 0, 255, 0, 0, 0, 0])
    assert list(raster.cmyk_to_rgb(corners)) == [0, 255, 255, 255, 0, 255, 255, 255, 0, 0, 0, 0, 255, 255, 255]
    assert list(raster.cmyk_to_rgb(bytes([0, 0, 0, 255, 1, 2]))) == [0, 0, 0]
    assert raster.unpack_bits(bytes([0xA0, 0x50]), 4, 2).tolist() == [[1, 0, 1, 0], [0, 1, 0, 1]]
    assert raster.unpack_bits(bytes([0xF0, 0x80]), 9, 1).tolist() == [[1, 1, 1, 1, 0, 0, 0, 0, 1]]
    assert raster.unpack_bits(bytes([0xF0]), 4, 3).tolist() == [[1] * 4, [0] * 4, [0] * 4]
    kind, samples = raster.decode_raster(bytes(12), 2, 2, 8, "DeviceRGB")
    assert raster.image_size(raster.encode_png(kind, samples, 2, 2)) == ("image/png", 2, 2)
    with pytest.raises(ValueError):
        raster.decode_raster(bytes(4), 2, 2, 8, "ICCBased")


def parsed(data):
    """(kind, columns of one row) of a parsed file."""
    return [(c["kind"][k], {n: v[k] for n, v in c.items()}) for c in pdf.parse_document(7, data) for k in range(len(c["kind"]))]


def of_kind(data, kind):
    return [r for k, r in parsed(data) if k == kind]


def test_pdf_parts():
    made = pdf.write_pdf([[(60, 80, 10, "Hello (world)"), (60, 97, 10, "again é 😀")], [(60, 80, 12, "page two")]], " Meu Livro ", "Fulano")
    (meta,) = of_kind(made, "meta")
    assert (meta["text"], meta["author"]) == ("Meu Livro", "Fulano")
    assert [(r["page_num"], r["text"], r["y"]) for r in of_kind(made, "line")] == [(1, "Hello (world)", 80.0), (1, "again é 😀", 97.0), (2, "page two", 80.0)]
    assert [k for k, _ in parsed(b"no pdf")] == ["diagnostic"]
    assert len(list(pdf.parse_document(7, made, metadata_only=True))) == 1
    (meta,) = of_kind(pdf.write_pdf([], " ", ""), "meta")
    assert meta["text"] is None and meta["author"] is None


def made_of(*objects):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"


def stream(data, more=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), more, data)


CATALOG = b"<< /Type /Catalog /Pages 2 0 R >>"


def test_pdf_images_and_forms():
    content = b"q 50 0 0 30 10 700 cm /I Do Q /F Do BT /F1 10 Tf 20 600 Td <414243> Tj (x) /Bad [ Tj ET"
    form = b"BT /F1 9 Tf 1 0 0 1 5 500 Tm (form) Tj ET /F Do"
    made = made_of(
        CATALOG,
        b"<< /Type /Pages /Kids [3 0 R 2 0 R] /MediaBox [0 0 600 800] /Resources << /Font << /F1 4 0 R >> /XObject << /I 5 0 R /F 6 0 R /J 7 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 8 0 R >>",
        b"<< /Type /Font /Subtype /Type1 >>",
        stream(b"\x00\x01", b"/Type /XObject /Subtype /Image /Width 2 /Height 1 /ColorSpace [/Indexed /DeviceRGB 1 <010203040506>] /BitsPerComponent 8"),
        stream(form, b"/Type /XObject /Subtype /Form"),
        stream(b"x", b"/Type /XObject /Subtype /Image /Width 2 /Height 1 /Filter /JPXDecode"),
        stream(content),
    )
    kinds = [k for k, _ in parsed(made)]
    assert kinds.count("image") == 1 and kinds.count("page") == 1
    assert sorted(r["text"] for r in of_kind(made, "diagnostic")) == ["form 6 draws itself", "image img_7_0.png: unsupported codec", "object 2 stands in the page tree again"]
    (drawn,) = of_kind(made, "drawn")
    assert (drawn["width"], drawn["height"], drawn["y"]) == (800.0, 30.0, 700.0)
    assert [r["text"] for r in of_kind(made, "line")] == ["form", "ABC"]


def test_images_after_failed_text():
    """Text that can't be read ends the text of a page, not its images."""
    made = made_of(
        CATALOG, b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /MediaBox [0 0 600 800] /Contents 4 0 R /Resources << /Font << /F 5 0 R /G 6 0 R >> /XObject << /I 7 0 R >> >> >>",
        stream(b"BT /F 10 Tf 1 0 0 1 9 700 Tm (one) Tj ET BT /G 10 Tf (two) Tj ET q 10 0 0 10 5 300 cm /I Do Q"), b"<< /Type /Font /Subtype /Type1 >>",
        b"<< /Type /Font /Subtype /Type0 /DescendantFonts 3 >>" .replace(b"DescendantFonts 3", b"ToUnicode 8 0 R"), stream(b"\x07", b"/Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray"), stream(b"zz", b"/Filter /FlateDecode"),
    )
    assert [r["text"] for r in of_kind(made, "line")] == ["one"] and len(of_kind(made, "drawn")) == 1
    assert any(r["text"].startswith("text: ") for r in of_kind(made, "diagnostic"))


def test_fonts_and_filters():
    import base64

    lzw_of = lambda codes: int("".join(format(c, "09b") for c in codes).ljust(-(-9 * len(codes) // 8) * 8, "0"), 2).to_bytes(-(-9 * len(codes) // 8), "big")
    assert filters.lzw(lzw_of([256, 45, 45, 45, 45, 45, 65, 45, 45, 45, 66, 257])) == b"-----A---B"
    assert filters.lzw(lzw_of([256, 45, 258, 258, 65, 259, 66, 257])) == b"-----A---B"
    raw = bytes(range(256)) + b"\0\0\0\0ab"
    assert filters.ascii85(base64.a85encode(raw) + b"~>") == raw and filters.run_length(bytes([2, 65, 66, 67, 254, 68, 128, 9])) == b"ABCDDD"
    show = b"BT /A 10 Tf 1 0 0 1 10 700 Tm (\x01\x02 a) Tj ET BT /B 10 Tf 1 0 0 1 10 600 Tm <00410301> Tj ET BT /C 10 Tf 1 0 0 1 10 500 Tm (\x8e\xd5) Tj ET"
    packed = base64.a85encode(zlib.compress(show)) + b"~>"
    made = made_of(
        CATALOG, b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /MediaBox [0 0 600 800] /Contents 4 0 R /Resources << /Font << /A 5 0 R /B 6 0 R /C 7 0 R >> >> >>",
        stream(packed, b"/Filter [/ASCII85Decode /FlateDecode]"), b"<< /Subtype /Type1 /BaseFont /ABCDEF+Helvetica-Bold /Encoding << /Differences [1 /eacute /uni00E7] >> >>",
        b"<< /Subtype /Type0 /Encoding /UniGB-UTF16-H /DescendantFonts [<< /DW 500 /W [65 [250 300] 769 769 900] >>] >>", b"<< /Subtype /TrueType /Encoding /MacRomanEncoding >>",
    )
    assert [r["text"] for r in of_kind(made, "line")] == ["éç a", "A\u0301", "é’"]
    wide = fonts.Font({"Subtype": pdf.Name("Type0"), "DescendantFonts": [{"DW": 500, "W": [65, [250, 300], 769, 770, 900]}]}, lambda x: x, None, None)
    assert [wide.widths.get(c, wide.width) for c in (65, 66, 67, 770)] == [0.25, 0.3, 0.5, 0.9]


def test_lines_of_strings_and_of_glyphs(spark):
    """The parser closes lines string by string as the operator on glyph tables does glyph by glyph."""
    rng = random.Random(4)
    for _ in range(20):
        page = pdf.Page(1, 600.0, 800.0)
        lines, glyphs, y = pdf._Lines(page), [], 60.0
        for _ in range(30):
            y += rng.choice((0.0, 0.0, 4.0, 6.0, 14.0, 20.0, -30.0))
            x, size, text = rng.choice((20.0, 60.0, 300.0)), rng.choice((10.0, 12.0)), "".join(rng.choice("ab ") for _ in range(rng.randint(1, 5)))
            steps = [0.5 * size * k for k in range(len(text))]
            lines.show(text, x, x, x + steps[-1] + 0.5 * size, y, y, size)
            glyphs += [(1, 1, len(glyphs) + k, x + s, y, 0.5, size, c, k == 0, 600.0) for k, (s, c) in enumerate(zip(steps, text))]
        lines.close()
        if _ % 10:
            continue
        table = spark.createDataFrame(glyphs, "doc_id long, page_num int, k int, x double, y double, width double, font_size double, ch string, word_start boolean, page_width double")
        found = [(r["y"], r["font_size"], round(r["x_start"], 9), r["text"]) for r in G.glyph_lines(table).orderBy("line_ord").collect()]
        assert found == [(y, f, round(x, 9), t) for y, f, x, t in page.lines]


def test_wrap():
    assert wrap_text("  a \n\t b  ", 10, lambda c: 1.0) == ["a b"]
    lines = wrap_text("one two three four five six seven eight", 9, lambda c: 1.0)
    assert len(lines) > 1 and " ".join(lines) == "one two three four five six seven eight" and max(map(len, lines)) <= 9
    assert wrap_text("abcdefgh", 3, lambda c: 1.0) == ["abc", "def", "gh"]
    assert drawn_cover("A & B", "C").count("<text") == 2


def test_wrap_of_columns(spark, monkeypatch):
    """Lines of columns are those of the plain wrap: overlong words, wide characters, white space of all kinds, no words."""
    monkeypatch.setattr(wrap, "CHUNK", 7)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aabcW é") if rng.random() < 0.02 else rng.choice("abcWXé") for _ in range(rng.choice((1, 2, 5, 9, 14, 60))))
    texts = [rng.choice((" ", "\n", "\t ", "\u2003")).join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", " \n ", "W" * 100, "a" * 5000, " a", "b "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (4, 30):  # half ems: two for a to z, three for others
        found = {r["doc_id"]: r["lines"] for r in with_lines(df, "text", "lines", most, lambda c: 3 * F.char_length(c) - F.regexp_count(c, F.lit("[a-z]")), 3).collect()}
        assert found == {k: wrap_text(t or "", most / 2, lambda c: 1.0 if "a" <= c <= "z" else 1.5) for k, t in enumerate(texts)}


def test_wrap_measures_words_once(spark):
    """However many chunks a text has, the fold over its words reads their sizes; it doesn't make them."""
    texts = spark.createDataFrame([(1, " ".join(["word"] * 3000))], "doc_id long, text string")
    found = with_lines(texts, "text", "lines", 30, lambda c: 3 * F.char_length(c), 3)
    (fold,) = (p for p in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "AS lines_starts" in p)
    assert "reduce(" in fold and "char_length" not in fold
    assert found.first()["lines"] == ["word word"] * 1500


def sent_bytes(df):
    """Bytes that the exchanges of an executed plan have sent."""
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            left += [node.children().apply(i) for i in range(node.children().size())]
        if kind == "ShuffleExchangeExec":
            total += node.metrics().apply("dataSize").value()
    return total


def test_previews_of_a_picture_book(spark):
    """Of 200 chapters and 200 images, each image is sent about once: no chapter meets the images of others."""
    size = 20_000
    lines = [(1, k, 2 * k, float(k), 0, f"Chapter {k}" if k % 2 else "words", 10.0, 0.1, None) for k in range(1, 401)]
    shown = [(1, k, 2 * k + 1, float(k), 1, None, None, None, k // 2) for k in range(2, 401, 2)]
    images = spark.createDataFrame([(1, k, f"i{k % 199}.png", "image/png", 10, 10, bytearray([k % 251]) * size) for k in range(1, 201)], "doc_id long, image_idx int, filename string, mime string, width int, height int, bytes binary")
    docs, events = spark.range(1, 2).toDF("doc_id"), L.ordered(spark.createDataFrame(lines + shown, EVENTS))
    known = C.with_cover(L.profile(docs, events, images.drop("bytes"))).withColumn("consumed_image", F.col("cover.consumed_image")).drop("shown", "opening", "cover")
    chapters = L.written_chapters(L.chapter_pieces(L.classified(L.chapter_events(L.with_names(known.join(events, "doc_id", "left"))))))
    meta = docs.selectExpr("doc_id", "'T' as title", "'A' as author", "'c' as cover_uri")
    pages = C.preview_pages(chapters, meta, C.image_uris(images))
    (row,) = pages.collect()
    uris = [u.split('"', 1)[0] for u in row["html"].split('src="')[2:]]
    assert row["html"].count("<h2 id=") == 200 and len(uris) == 200 and uris[0] != uris[1] and uris[199] == uris[0]  # the first of a name
    assert sent_bytes(pages) < 3 * 200 * size


def rows_of(found):
    return sorted([tuple(round(x, 9) if isinstance(x, float) else int(x) if isinstance(x, bool) else x for x in r) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_duckdb(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    expected = db.sql(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert rows_of(map(tuple, df.select(*columns).collect())) == rows_of(expected)
