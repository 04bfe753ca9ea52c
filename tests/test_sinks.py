"""EPUB archives and whole conversions: parts in order, names that need escapes, covers, previews, files, the command."""

import io
import json
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.__main__ import arguments, main
from quire.plans.convert import MARK, REPORT, convert, convert_folder, document_metadata, read_pdfs, usable_covers
from quire.scratch import Scratch
from quire.sources import pdf, raster
from quire.sources.sinks import STYLESHEET, FileWriter, epub_files, write_files

OPF = "{http://www.idpf.org/2007/opf}"


def books(spark):
    meta = spark.createDataFrame([(1, "a.epub", "Q & <A>", "An Author"), (2, "b.epub", None, None)], "doc_id long, name string, title string, author string")
    chapters = spark.createDataFrame(
        [(1, 1, "c2.xhtml", None, "<html>2</html>"), (1, 0, "c1.xhtml", "One & only", "<html>1</html>"), (3, 0, "c1.xhtml", "No meta", "<html/>")],
        "doc_id long, out_ord int, href string, title string, xhtml string",
    )
    resources = spark.createDataFrame([(1, 0, 'i"&.png', "image/png", bytearray(b"\x89PNG"))], "doc_id long, image_idx int, filename string, mime string, bytes binary")
    covers = spark.createDataFrame([(1, "cover.svg", "image/svg+xml", bytearray(b"<svg/>"), "<html>cover</html>")], "doc_id long, filename string, mime string, bytes binary, xhtml string")
    return epub_files(meta, chapters, resources, covers)


def opened(content):
    z = zipfile.ZipFile(io.BytesIO(content))
    assert z.testzip() is None
    package = ET.fromstring(z.read("OEBPS/content.opf"))
    items = {i.get("id"): i.get("href") for i in package.find(f"{OPF}manifest")}
    assert len(items) == len(set(items.values())) and all(f"OEBPS/{h}" in z.namelist() for h in items.values())
    ET.fromstring(z.read("OEBPS/nav.xhtml"))
    return z, package, items, [items[i.get("idref")] for i in package.find(f"{OPF}spine")]


def test_epub(spark):
    made = {r["doc_id"]: r for r in books(spark).collect()}
    assert {d: r["path"] for d, r in made.items()} == {1: "a.epub", 2: "b.epub"}
    z, package, items, spine = opened(made[1]["content"])
    first = z.infolist()[0]
    assert (first.filename, first.compress_type, z.read("mimetype")) == ("mimetype", zipfile.ZIP_STORED, b"application/epub+zip")
    assert all(i.compress_type == zipfile.ZIP_DEFLATED for i in z.infolist()[1:])
    assert spine == ["cover.xhtml", "nav.xhtml", "c1.xhtml", "c2.xhtml"]
    meta = list(package.find(f"{OPF}metadata"))
    assert [x.text for x in meta[1:4]] == ["Q & <A>", "An Author", "pt"] and meta[0].text.startswith("urn:uuid:") and meta[4].get("property") == "dcterms:modified"
    assert z.read('OEBPS/images/i"&.png') == b"\x89PNG" and z.read("OEBPS/c1.xhtml") == b"<html>1</html>"
    z, package, _, spine = opened(made[2]["content"])
    assert spine == ["nav.xhtml"] and not any(x.tag.endswith("creator") for x in package.find(f"{OPF}metadata"))


def test_stylesheet_has_every_class():
    assert all(f"{of} {{" in STYLESHEET for of in ("body", "h1", "h2", "p", "p.legenda", "p.direita", "img"))


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def test_write_files(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "mine.txt").write_text("mine")
    (out / "a.epub").write_text("old")
    write_files(books(spark), str(out))
    assert names(out) == ["a.epub", "b.epub", "mine.txt"] and (out / "mine.txt").read_text() == "mine"
    opened((out / "a.epub").read_bytes())
    write_files(spark.createDataFrame([("n.txt", None), ("t.txt", "é")], "path string, content string"), f"file://{tmp_path}/uri")
    assert {p.name: p.read_text() for p in (tmp_path / "uri").iterdir()} == {"n.txt": "", "t.txt": "é"}
    write_files(books(spark).where("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or names(tmp_path / "none") == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    """One task fails after others have written; two rows have one name; a name leads elsewhere; a folder is in the way."""
    (tmp_path / "f3").write_text("old")
    files = spark.range(40).repartition(4).selectExpr("concat('f', id) as path", "cast(id as string) as content")
    failing = files.withColumn("content", F.when(F.col("path") == "f7", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    twice = files.unionByName(files.where("path = 'f5'"))
    for bad in (failing, twice, files.unionByName(files.selectExpr("concat('../', path) as path", "content"))):
        with pytest.raises(Exception):
            write_files(bad, str(tmp_path))
        assert names(tmp_path) == ["f3"] and (tmp_path / "f3").read_text() == "old"
    (tmp_path / "f9").mkdir()
    with pytest.raises(Exception):  # found out in the midst of the commit
        write_files(files, str(tmp_path))
    assert names(tmp_path) == ["f3", "f9"] and (tmp_path / "f3").read_text() == "old"
    with pytest.raises(Exception):
        files.write.format("quire_files").mode("overwrite").save(str(tmp_path))
    assert names(tmp_path) == ["f3", "f9"]


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    batch = pa.record_batch([pa.array(["a", "b"]), pa.array([b"1", b"2"])], ["path", "content"])
    writer = FileWriter(str(tmp_path))
    counted, lost = writer.write(iter([batch])), writer.write(iter([batch]))
    other = writer.write(iter([pa.record_batch([pa.array(["c"]), pa.array([b"3"])], ["path", "content"])]))
    assert counted.folder != lost.folder and names(tmp_path) == [writer.stage]
    writer.commit([counted, None, other])
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a": "1", "b": "2", "c": "3"}
    again = FileWriter(str(tmp_path))
    again.abort([again.write(iter([batch]))])
    assert names(tmp_path) == ["a", "b", "c"]


def picture_pdf():
    """A page with a large image and text, then a chapter with the same image and a small one; damaged parts."""
    grey = zlib.compress(bytes(range(250)) * 1600)
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R 4 0 R] /MediaBox [0 0 600 800] /Resources << /Font << /F 5 0 R >> /XObject << /B 6 0 R /S 7 0 R /X 8 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 9 0 R >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 10 0 R >>",
        b"<< /Type /Font /Subtype /Type1 >>",
        b"<< /Subtype /Image /Width 400 /Height 1000 /ColorSpace /DeviceGray /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(grey), grey),
        b"<< /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceRGB /Length 3 >>\nstream\nabc\nendstream",
        b"<< /Subtype /Image /Width 9 /Height 9 /Filter /JBIG2Decode /Length 1 >>\nstream\nx\nendstream",
    ]
    for body in (b"q 600 0 0 800 0 0 cm /B Do Q BT /F 10 Tf 1 0 0 1 60 90 Tm (Opening words) Tj ET", b"BT /F 10 Tf 1 0 0 1 60 700 Tm (Chapter 1) Tj 1 0 0 1 60 600 Tm (It & that.) Tj ET q 10 0 0 10 60 500 cm /S Do Q q 10 0 0 10 60 300 cm /B Do Q"):
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"


def files_of(spark, *files):
    return spark.createDataFrame([(k, p, bytearray(c)) for k, p, c in files], "doc_id long, path string, content binary")


def test_convert(spark):
    plain = pdf.write_pdf([[(60, 80, 10, "Just text.")]], "T & t", " Ana ")
    done = convert(files_of(spark, (1, "/in/a.pdf", picture_pdf()), (2, "/in/b c.pdf", plain), (3, "/other/a.pdf", b"broken"), (4, "/in/d.pdf", pdf.write_pdf([]))))
    summary = {r["doc_id"]: r for r in done.summary.collect()}
    assert [(summary[k]["title"], summary[k]["author"], summary[k]["pages"], summary[k]["images"], summary[k]["chapters"]) for k in (1, 2, 3, 4)] == [("a", "", 2, 4, 2), ("T & t", "Ana", 1, 0, 1), ("a", "", 0, 0, 0), ("d", "", 0, 0, 0)]
    assert summary[1]["epub"] == "1-a.epub" and summary[2]["epub"] == "b c.epub" and summary[3]["epub"] is None and "no PDF header" in summary[3]["error"]
    epubs = {r["doc_id"]: r["content"] for r in done.epubs.collect()}
    assert sorted(epubs) == [1, 2, 4]
    z, _, items, spine = opened(epubs[1])
    assert spine == ["cover.xhtml", "nav.xhtml", "chap_01.xhtml", "chap_02.xhtml"] and items["cover-image"] == "cover.png"
    assert raster.image_size(z.read("OEBPS/cover.png")) == ("image/png", 400, 1000)
    chapter = z.read("OEBPS/chap_02.xhtml").decode()
    assert "<h1>Chapter 1</h1>" in chapter and "<p>It &amp; that.</p>" in chapter and 'src="images/img_7_0.png"' in chapter and 'href="stylesheet.css"' in chapter
    z, _, items, _ = opened(epubs[2])
    assert items["cover-image"] == "cover.svg" and ET.fromstring(z.read("OEBPS/cover.svg")).tag.endswith("svg") and b"T &amp; t" in z.read("OEBPS/cover.svg")
    previews = {r["doc_id"]: r for r in done.previews.collect()}
    assert previews[1]["path"] == "1-a.preview.html" and "images/" not in previews[1]["content"] and previews[1]["content"].count("data:image/png;base64,") == 3
    messages = {(r["doc_id"], r["stage"], r["message"]) for r in done.diagnostics.collect()}
    assert {(1, "parse", "image img_8_0.png: unsupported codec"), (1, "parse", "1 lines"), (1, "chapters", "heading: Chapter 1"), (1, "cover", "cover below the sharp size: 400x1000")} <= messages


def test_conversion_exchanges_nothing_by_document(spark, monkeypatch):
    """After what comes in has been dealt out by doc_id, neither the tables between nor the results are exchanged by it; the
    totals of the writes are those of the summary; what is closed is gone."""
    plans = {}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    cut_by = Scratch.cut_by
    monkeypatch.setattr(Scratch, "cut_by", lambda self, df, label, key: (plans.__setitem__(label, plan(df)), cut_by(self, df, label, key))[1])
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = pdf.write_pdf([[(60, 80, 10, "Part 2"), (60, 120, 10, "one"), (60, 160, 10, "Part 3"), (60, 200, 10, "two")], [(60, 80, 10, "three")]])
        covers = spark.createDataFrame([(2, bytearray(raster.encode_png("gray", bytes(12), 4, 3)))], "doc_id long, bytes binary")
        overrides = spark.createDataFrame([(2, "Mine", None, None)], "doc_id long, title string, author string, lang string")
        done = convert(files_of(spark, (1, "/in/a.pdf", picture_pdf()), (2, "/in/b.pdf", plain), (3, "/in/c.pdf", b"broken")), overrides, covers)
        results = {k: getattr(done, k) for k in ("metadata", "chapters", "epubs", "previews", "summary")}
        plans |= {k if k not in plans else f"{k} of the result": plan(df) for k, df in results.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    sent = {k: set(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L?, \d+\), (\w+)", text)) for k, text in plans.items()}
    assert {"rows", "paths", "overrides", "metadata", "given", "profile", "chapters", "covers", "epubs", "previews", "summary"} <= plans.keys()
    assert {k: v for k, v in sent.items() if v} == dict.fromkeys(("rows", "paths", "overrides", "metadata", "given"), {"REPARTITION_BY_NUM"})
    rows = done.summary.collect()
    assert done.totals == {k: sum(r[k] or 0 for r in rows) for k in ("pages", "images", "chapters")} | {"unread": sum(r["error"] is not None for r in rows)}
    assert done.totals["pages"] == 4 and done.totals["unread"] == 1 and {r["doc_id"] for r in done.epubs.collect()} == {1, 2}
    held, root = list(done.scratch.tables), Path(done.scratch.root.removeprefix("file:"))
    assert all(spark.catalog.tableExists(t) for t in held) and root.exists()
    done.close()
    assert not any(spark.catalog.tableExists(t) for t in held) and not root.exists()


def test_conversion_broadcasts_no_table_of_documents(spark, monkeypatch):
    """Tables of a row a document are small as files, large as rows: no join of the conversion sends one to the driver."""
    plans = {}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    cut_by = Scratch.cut_by
    monkeypatch.setattr(Scratch, "cut_by", lambda self, df, label, key: (plans.__setitem__(label, plan(df)), cut_by(self, df, label, key))[1])
    plain = pdf.write_pdf([[(60, 80, 10, "Part 2"), (60, 120, 10, "one")]])
    covers = spark.createDataFrame([(2, bytearray(raster.encode_png("gray", bytes(12), 4, 3)))], "doc_id long, bytes binary")
    overrides = spark.createDataFrame([(2, "Mine", None, None)], "doc_id long, title string, author string, lang string")
    done = convert(files_of(spark, (1, "/in/a.pdf", picture_pdf()), (2, "/in/b.pdf", plain)), overrides, covers)
    plans |= {f"{k} of the result": plan(getattr(done, k)) for k in ("metadata", "chapters", "epubs", "previews", "summary")}
    sent = {k: len(re.findall("BroadcastExchange", text)) for k, text in plans.items()}
    # Names that several files have, counted, are no table of documents.
    assert {k: n for k, n in sent.items() if n and k != "metadata"} == {} and sent["metadata"] <= 1
    assert {r["doc_id"] for r in done.epubs.collect()} == {1, 2}
    done.close()


def test_conversion_of_nothing(spark):
    done = convert(files_of(spark, (1, "/in/a.pdf", b"")).where("false"))
    assert done.totals == {"pages": 0, "images": 0, "unread": 0, "chapters": 0}
    assert not any(getattr(done, k).count() for k in ("metadata", "chapters", "epubs", "previews", "diagnostics", "summary"))


def test_covers_and_overrides(spark):
    png = raster.encode_png("gray", bytes(12), 4, 3)
    jpeg = b"\xff\xd8\xff\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 20) + b"\x01\x01\x11\x00"
    covers = spark.createDataFrame([(1, bytearray(png)), (2, bytearray(jpeg)), (4, bytearray(b"GIF89a"))], "doc_id long, bytes binary")
    assert sorted((r["doc_id"], r["mime"], r["width"], r["height"]) for r in usable_covers(covers).collect()) == [(1, "image/png", 4, 3), (2, "image/jpeg", 20, 30)]
    files = files_of(spark, (1, "/in/a.pdf", picture_pdf()), (2, "/in/b.pdf", pdf.write_pdf([])), (4, "/in/d.pdf", picture_pdf()))
    overrides = spark.createDataFrame([(1, "Mine ", "  ", "en"), (2, None, "Me", None)], "doc_id long, title string, author string, lang string")
    done = convert(files, overrides, covers)
    opf = {r["doc_id"]: opened(r["content"]) for r in done.epubs.collect()}
    assert {k: items["cover-image"] for k, (_, _, items, _) in opf.items()} == {1: "cover.png", 2: "cover.jpg", 4: "cover.png"}
    assert opf[1][0].read("OEBPS/cover.png") == png and opf[2][0].read("OEBPS/cover.jpg") == jpeg
    assert b"img_6_0.png" in opf[1][0].read("OEBPS/chap_01.xhtml")  # a given cover leaves the page's image where it is
    assert [x.text for x in opf[1][1].find(f"{OPF}metadata")][1:3] == ["Mine", "en"]
    assert (4, "the given cover is no JPEG or PNG") in {(r["doc_id"], r["message"]) for r in done.diagnostics.collect()}
    rows = pdf.parse_pdfs(files, metadata_only=True)
    assert sorted((r["doc_id"], r["title"], r["author"]) for r in document_metadata(files, rows, overrides).collect()) == [(1, "Mine", ""), (2, "b", "Me"), (4, "d", "")]


def test_folders(spark, tmp_path):
    source, target = tmp_path / "in [1] {a,b}*", tmp_path / "out"
    source.mkdir()
    (source / "Meu livro+1.pdf").write_bytes(pdf.write_pdf([[(60, 80, 10, "Capítulo 1"), (60, 120, 10, "Oi.")]], "", "Eu"))
    (source / "note.txt").write_text("no")
    (tmp_path / "in 1 a").mkdir()
    (tmp_path / "in 1 a" / "other.pdf").write_bytes(b"")
    assert [r["path"].rsplit("/", 1)[1] for r in read_pdfs(spark, str(source)).collect()] == ["Meu livro+1.pdf"]
    for _ in range(2):
        (row,) = convert_folder(spark, str(source), str(target)).collect()
    assert (row["title"], row["author"], row["epub"], row["chapters"]) == ("Meu livro+1", "Eu", "Meu livro+1.epub", 1)
    assert names(target) == ["Meu livro+1.epub", "Meu livro+1.preview.html", REPORT]
    assert [r["epub"] for r in spark.read.json(f"{target}/{REPORT}/summary").collect()] == ["Meu livro+1.epub"]
    assert {r["message"] for r in spark.read.json(f"{target}/{REPORT}/diagnostics").collect()} >= {"heading: Capítulo 1", "2 lines"}
    assert json.loads((target / REPORT / "totals.json").read_text()) == {"pages": 1, "images": 0, "unread": 0, "chapters": 1}


def test_folders_of_others_are_left_alone(spark, tmp_path):
    """A user's folders, also one of the report's name, in the place that is written to."""
    (tmp_path / "diagnostics").mkdir()
    (tmp_path / "diagnostics" / "mine").write_text("1")
    (tmp_path / "b.pdf").write_bytes(pdf.write_pdf([[(60, 80, 10, "x")]]))
    convert_folder(spark, str(tmp_path), str(tmp_path))
    assert (tmp_path / "diagnostics" / "mine").read_text() == "1"
    (tmp_path / REPORT / MARK).unlink()
    with pytest.raises(ValueError, match="isn't a report"):
        convert_folder(spark, str(tmp_path), str(tmp_path))


@pytest.mark.parametrize(
    ("argv", "cover", "source", "target"),
    [
        (["in"], None, "in", None),
        (["--cover", "front.png", "--headless", "in/one.pdf"], "front.png", "in/one.pdf", None),
        (["--headless", "in", "books", "--cover", "front.png"], "front.png", "in", "books"),
        (["--cover=-front.png", "in"], "-front.png", "in", None),
    ],
)
def test_arguments(argv, cover, source, target):
    found = arguments(argv)
    assert (found.cover, found.source, found.target) == (cover, source, target)


@pytest.mark.parametrize("argv", [["in", "--cover"], ["--cover", "--headless", "in"], ["--cover", "x.png", "in", "--cover", "x.png"], ["in", "out", "more"], []])
def test_wrong_arguments(argv):
    with pytest.raises(SystemExit) as e:
        arguments(argv)
    assert e.value.code == 2


def test_help_and_version(capsys):
    for flag in ("--help", "--version"):
        with pytest.raises(SystemExit) as e:
            main([flag])
        assert e.value.code == 0 and "quire" in capsys.readouterr().out
