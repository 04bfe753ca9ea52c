"""The engine's queries over whole driver tables, and the same in DuckDB SQL."""

from __future__ import annotations

import hashlib
import io
import string
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import covers as C
from ..operators import glyphs as G
from ..operators import layout as L
from ..operators import ranges as S
from ..operators import ranks as R
from ..operators.matrices import drawn_places
from ..operators.trees import inherited
from ..scratch import Scratch
from ..sources import pdf, raster, sinks
from ..streaming import progress as P
from ..functions.samples import cmyk_to_rgb
from ..functions.wrap import with_lines
from . import fixtures as X
from .convert import convert, document_metadata

Query = Callable[[SparkSession, str], DataFrame]


class Flow:
    """The tables of the flow fixture, as far as a query asks for them; each reads and splits the texts once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.documents = documents_of(spark, sf_dir)
        self.rows = X.flow_rows(self.documents)
        self.numbers = X.flow_profile_rows(self.rows)
        #: A row without an event for documents that have none.
        self.all_events = L.ordered(X.flow_events(self.rows))
        self.events = self.all_events.where("is_image is not null")
        self.images = X.image_assets(self.documents)

    def profile(self) -> DataFrame:
        return L.profile_of(self.numbers)

    def covered(self) -> DataFrame:
        return C.with_cover(self.profile()).withColumn("consumed_image", F.col("cover.consumed_image"))

    def headings(self) -> DataFrame:
        """All events with their document's baseline."""
        return L.with_baselines(self.all_events)

    def kinds(self) -> DataFrame:
        return L.classified(L.chapter_events(L.with_names(self.covered().drop("shown", "opening", "cover").join(self.all_events, "doc_id", "left"))))


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


#: Bytes of input, on average, of which Python holds values and results at a time.
SLICE = 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes (of a row at least), so that what Python makes of them at a time is small."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(most, batch.nbytes))
        yield from (batch.slice(k, step) for k in range(0, batch.num_rows, step))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        yield pa.record_batch([batch.column(0), pa.array([pdf.pdf_text(b) if b is not None else None for b in batch.column(1).to_pylist()], pa.string())], ["doc_id", "s"])


def _pdf_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    wide = F.col("text").rlike(r"[^\x00-ÿ]") | (F.char_length("text") % 2 == 0)
    odd = F.when(F.char_length("text") % 3 == 0, F.unhex(F.lit("00"))).otherwise(F.lit(b""))
    raw = F.when(wide, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"), odd)).otherwise(F.encode("text", "ISO-8859-1"))
    return docs.select("doc_id", raw.alias("raw")).mapInArrow(_decoded, "doc_id long, s string").select("doc_id", F.md5("s").alias("digest"), F.char_length("s").cast("long").alias("n_chars"))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first bits of samples of 1, 2, 4 or 8 bits, in two rows, out of each line's bytes."""
    for batch in sliced(batches):
        out = []
        for i, line in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw, width, depth = line.encode(), 3 + len(line) % 9, 1 << i % 4
            found = raster.unpack_bits(raw, width, max(1, -(-len(raw) // (-(-width * depth // 8)))), depth)
            out.append((found + ord("0")).tobytes().decode())
        yield pa.record_batch([*batch.columns[:2], pa.array(out, pa.string())], ["doc_id", "i", "bits"])


def _unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.document_lines(documents_of(spark, sf_dir)).mapInArrow(_bits, "doc_id long, i int, bits string")


def _palettes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        out = [raster.indexed_to_rgb((t or "").encode(), 1 << 30, bytes(range(200)), b) for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "rgb"])


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.element_at(F.array(*[F.lit(b) for b in ("DeviceGray", "DeviceRGB", "DeviceCMYK")]), (F.coalesce(F.char_length("text"), F.lit(0)) % 3).cast("int") + 1)
    out = documents_of(spark, sf_dir).select("doc_id", "text", base.alias("base")).mapInArrow(_palettes, "doc_id long, rgb binary")
    return out.select("doc_id", F.md5(F.lower(F.hex("rgb"))).alias("digest"), (F.length("rgb") / 3).cast("long").alias("pixels"))


def _cmyk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of each line as the inks of pixels."""
    inks = F.transform(F.split("line", ""), lambda c: F.ascii(c) % 256)
    rgb = X.document_lines(documents_of(spark, sf_dir)).select("doc_id", "i", cmyk_to_rgb(inks).alias("rgb"))
    return rgb.select("doc_id", "i", (F.size("rgb") / 3).cast("long").alias("pixels"), F.md5(F.array_join("rgb", ",")).alias("digest"))


_FILTERS = (["DCTDecode"], ["DCTDecode", "FlateDecode"], ["FlateDecode"], ["JPXDecode"], ["CCITTFaxDecode"], ["JBIG2Decode", "FlateDecode"], [], ["ASCII85Decode", "LZWDecode"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sizes = [len(t or "") for t in batch.column(1).to_pylist()]
        errors = [pdf.image_error(_FILTERS[n % 8]) for n in sizes]
        names = [None if e else pdf.image_filename(n % 100, n % 3, _FILTERS[n % 8]) for n, e in zip(sizes, errors)]
        yield pa.record_batch([batch.column(0), pa.array(errors, pa.string()), pa.array(names, pa.string())], ["doc_id", "error", "filename"])


def _codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(spark, sf_dir).mapInArrow(_named, "doc_id long, error string, filename string")


def _as_pdf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = (text or "").split("\n")
            pages = [[(60.0 + 9 * (k % 3), 60.0 + 17 * k, 10.0, t) for k, t in enumerate(lines[a : a + 40])] for a in range(0, len(lines), 40)]
            yield pa.record_batch([pa.array([key], pa.int64()), pa.array([pdf.write_pdf(pages, f"Document {key}", "quire")], pa.binary())], ["doc_id", "content"])


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents_of(spark, sf_dir).mapInArrow(_as_pdf, "doc_id long, content binary")
    return pdf.parse_pdfs(files).where("kind = 'line'").select("doc_id", "page_num", (F.col("k") + 1).alias("line_ord"), "text", F.round("y", 6).alias("y"), "font_size", F.round("x_start", 9).alias("x_start"))


def _flow_pdf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The flow's lines as a PDF, at five times their distances: no two of them are one line."""
    for batch in sliced(batches):
        for key, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pages: dict[int, list] = {}
            for r in lines or []:
                pages.setdefault(r["page_num"], []).append((600 * r["x_start"], 5 * r["y"], r["font_size"], r["text"]))
            made = pdf.write_pdf([pages[n] for n in sorted(pages)], f"Doc & {key}", "A <B>", 600, 4500)
            yield pa.record_batch([pa.array([key], pa.int64()), pa.array([f"/in/book_{key}.pdf"]), pa.array([made], pa.binary())], ["doc_id", "path", "content"])


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = []
        for key, path, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
            book = zipfile.ZipFile(io.BytesIO(content))
            for k, name in enumerate(sorted((n for n in book.namelist() if n.startswith("OEBPS/chap_")), key=lambda n: (len(n), n))):
                rows.append((key, path, k + 1, name.removeprefix("OEBPS/"), hashlib.md5(book.read(name)).hexdigest()))
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["doc_id", "path", "out_ord", "href", "digest"])


def flow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = documents_of(spark, sf_dir)
    line = F.struct("page_num", "arrival_seq", "y", "x_start", "font_size", "text")
    lines = X.flow_lines(documents).groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return documents.select("doc_id").join(lines, "doc_id", "left").mapInArrow(_flow_pdf, "doc_id long, path string, content binary")


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters of EPUB files, made of PDF files, read back. The PDF files are written once: paths are read apart from them."""
    return convert(Scratch(spark, "flow").cut(flow_files(spark, sf_dir), "files")).epubs.mapInArrow(_unzipped, "doc_id long, path string, out_ord int, href string, digest string")


def _titled_pdf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        made = [pdf.write_pdf([], t if n else " \t", ["", " ", f" {s} "][n]) for t, n, s in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
        yield pa.record_batch([*batch.columns[:2], pa.array(made, pa.binary())], ["doc_id", "path", "content"])


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/in/vol."), F.col("doc_id").cast("string"), F.lit(".final.pdf"))).otherwise(F.lit("/in/livro.PDF"))
    text = F.coalesce("text", F.lit(""))
    first, rest = F.substring_index(text, "\n", 1).alias("first"), (F.char_length(text) % 3).alias("rest")
    files = docs.select("doc_id", path.alias("path"), first, rest, F.coalesce("source", F.lit("x")).alias("source")).mapInArrow(_titled_pdf, "doc_id long, path string, content binary")
    return document_metadata(docs.select("doc_id", path.alias("path")), pdf.parse_pdfs(files, metadata_only=True)).select("doc_id", "title", "author", "name")


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in lines of 60 ems, in half ems: a to z are 1 wide, all other characters 1.5."""
    width = lambda c: 2 * F.char_length(c) + F.char_length(F.translate(c, string.ascii_lowercase, ""))
    lines = with_lines(documents_of(spark, sf_dir), "text", "lines", 120, width, 3)
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


def _inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inherited(X.line_nodes(documents_of(spark, sf_dir)), ["doc_id"])


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drawn_places(X.line_operators(documents_of(spark, sf_dir)), ["doc_id"], F.lit(800.0))
    return found.select("doc_id", "k", "saves", *[F.col(f"matrix.{c}").alias(c) for c in "abcdef"], "y")


def _previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = Flow(spark, sf_dir)
    chapters = L.written_chapters(L.chapter_pieces(flow.kinds()))
    meta = C.select_covers(flow.profile()).select(
        "doc_id", F.concat(F.lit("Doc & "), F.col("doc_id").cast("string")).alias("title"), F.lit("A <B>").alias("author"), F.concat(F.lit("cover:"), "filename").alias("cover_uri")
    )
    return C.preview_pages(chapters, meta, C.image_uris(flow.images).repartition("doc_id")).select("doc_id", F.md5("html").alias("digest"), F.char_length("html").cast("long").alias("n_chars"))


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each document, and, without doc_id, of all lines of all documents."""
    values = R.line_values(Flow(spark, sf_dir).events)
    values = values.withColumn("of", F.explode(F.array(F.col("doc_id"), F.lit(None).cast("long")))).select(F.col("of").alias("doc_id"), "metric", "value")
    return R.nearest_ranks(values, ["doc_id", "metric"], R.METRIC_RANK)


def _range_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = Flow(spark, sf_dir)
    events = S.noted(X.flow_events(flow.rows).where("is_image is not null"))
    known = R.rank_metrics(flow.documents, events).join(C.consumed_images(events, flow.images), "doc_id", "left")
    return S.range_blocks(S.range_kinds(events, known))


def _joined_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of one document that is all of them, one after the other."""
    flow = Flow(spark, sf_dir)
    events = X.flow_events(flow.rows).where("is_image is not null").withColumn("page_num", F.col("doc_id") * 1024 + F.col("page_num"))
    events = S.noted(events.withColumn("doc_id", F.lit(0).cast("long")))
    known = R.rank_metrics(events.select("doc_id").limit(1), events).withColumn("consumed_image", F.lit(None).cast("int"))
    return S.range_blocks(S.range_kinds(events, known)).select("chapter_id", "block_ord", "kind", "text", "image_idx")


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writes of all events and all chapters count beside their work."""
    flow, scratch = Flow(spark, sf_dir), Scratch(spark, "totals")
    seen, made = Observation("events"), Observation("chapters")
    events = flow.events.observe(seen, F.count_if(F.col("is_image") == 0).alias("lines"), F.count_if(F.col("is_image") == 1).alias("images"), F.sum(F.char_length("text")).alias("chars"))
    chapters = L.chapters(L.chapter_events(flow.headings())).observe(made, F.count(F.lit(1)).alias("chapters"), F.max("n_events").alias("longest"))
    for table, label in ((events, "events"), (chapters, "chapters")):
        scratch.cut(table, label)
    scratch.close()
    found = {k: seen.get.get(k) for k in ("lines", "images", "chars")} | {k: made.get.get(k) for k in ("chapters", "longest")}
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in two parts, odd lines first; the stream stops after the first and is started again for the second."""
    flow, scratch = Flow(spark, sf_dir), Scratch(spark, "progress")
    told = P.messages(X.flow_events(flow.rows).where("is_image is not null"))
    folders = [f"{scratch.root}/{k}" for k in ("messages", "progress", "checkpoint")]
    for odd in (1, 0):
        told.where(f"floor(seq / 2) % 2 = {odd}").write.mode("append").parquet(folders[0])
        P.follow(spark, *folders)
    return P.current(spark, folders[1])


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of the committing sink, read back from its folder."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"{Scratch(spark, 'published').root}/pages"
    sinks.write_files(pages.select(F.format_string("page_%d.html", "page_id").alias("path"), F.col("html").alias("content")), folder)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "page_*.html").load(folder)
    found = found.coalesce(4 * spark.sparkContext.defaultParallelism)  # files are small: the cost of opening would make a task of each few
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("n_bytes"), F.md5("content").alias("digest"))


def queries() -> dict[str, Query]:
    flow = lambda f: lambda spark, sf_dir: f(Flow(spark, sf_dir))
    return {
        "q01_flow_union": flow(lambda x: x.events),
        "q02_nonblank_lines": flow(lambda x: L.text_lines(x.events).select("doc_id", "event_seq", "text", F.char_length("text").cast("long").alias("n_chars"))),
        "q03_page_counts": flow(lambda x: x.events.groupBy("doc_id", "page_num").agg(F.count_if(F.col("is_image") == 0).alias("n_lines"), F.count_if(F.col("is_image") == 1).alias("n_images"))),
        "q04_nearest_rank_font": flow(lambda x: L.body_font(x.numbers)),
        "q05_left_margin": flow(lambda x: L.left_margin(x.numbers)),
        "q06_line_gap": flow(lambda x: L.line_gap(x.numbers)),
        "q07_layout_metrics": flow(lambda x: x.profile().select("doc_id", "baseline_font", "left_margin", "line_gap")),
        "q08_chapter_baseline": flow(lambda x: L.with_baselines(X.flow_events(x.rows)).groupBy("doc_id").agg(F.max("baseline").alias("baseline"))),
        "q09_heading_lines": flow(lambda x: L.with_headings(x.headings()).where("is_heading").select("doc_id", "event_seq", T.utrim(F.col("text")).alias("text"))),
        "q10_chapters": flow(lambda x: L.chapters(L.chapter_events(x.headings()))),
        "q11_line_kinds": flow(lambda x: x.kinds().where("live").select("doc_id", "chapter_id", "event_seq", "kind")),
        "q12_paragraph_breaks": flow(lambda x: x.kinds().where("live").select("doc_id", "event_seq", "indented", "gapped", "after_image")),
        "q13_blocks": flow(lambda x: L.blocks(x.kinds())),
        "q14_block_counts": flow(lambda x: L.blocks(x.kinds()).groupBy("kind").agg(F.count("*").alias("n"))),
        "q15_escape_html": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("digest")),
        "q16_block_html": flow(lambda x: L.rendered_blocks(x.kinds()).select("doc_id", "chapter_id", "block_ord", "html")),
        "q17_chapter_body": flow(lambda x: L.chapter_bodies(x.kinds()).select("doc_id", "chapter_ord", "title", "body")),
        "q18_chapter_xhtml": flow(lambda x: L.chapter_documents(L.written_chapters(L.chapter_pieces(x.kinds()))).select("doc_id", "out_ord", "href", "title", "xhtml")),
        "q19_cover_candidates": flow(lambda x: C.cover_candidates(x.profile())),
        "q20_cover_selection": flow(lambda x: C.select_covers(x.profile())),
        "q21_cover_xhtml": flow(lambda x: C.select_covers(x.profile()).select("doc_id", T.cover_xhtml(F.col("filename"), F.col("width"), F.col("height")).alias("xhtml"))),
        "q22_resources": flow(lambda x: C.resources(x.images.drop("bytes"), C.select_covers(x.profile())).select("doc_id", "image_idx", "filename", "mime")),
        "q23_data_uri": flow(lambda x: C.image_uris(x.images).select("doc_id", "image_idx", "uri")),
        "q24_preview_html": _previews,
        "q25_glyph_lines": lambda spark, sf_dir: G.glyph_lines(X.word_glyphs(documents_of(spark, sf_dir))),
        "q26_image_position": lambda spark, sf_dir: X.document_lines(documents_of(spark, sf_dir)).select(
            "doc_id", "i", G.image_y(F.lit(800.0), (F.char_length("line") * 3 % 400 - 200).cast("double"), (F.char_length("line") * 7 % 800).cast("double")).alias("y")
        ),
        "q27_pdf_string_decode": _pdf_strings,
        "q28_output_names": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.file_title(F.col("url")).alias("title"), T.epub_name(F.col("url")).alias("epub")),
        "q29_cmyk_rgb": _cmyk,
        "q30_unpack_bits": _unpacked,
        "q31_indexed_palette": _indexed,
        "q32_codec_dispatch": _codecs,
        "q33_diagnostics": flow(lambda x: C.newest(C.diagnostics(L.chapter_events(x.headings()), C.cover_candidates(x.profile()))).select("stage", "age", "doc_id", "page_num", "event_seq", "level", "message")),
        "q34_pdf_roundtrip": _roundtrip,
        "q35_word_wrap": _wrapped,
        "q36_convert": _converted,
        "q37_metadata": _metadata,
        "q38_file_sink": _published,
        "q39_rank_selection": _ranks,
        "q40_range_blocks": _range_blocks,
        "q41_joined_blocks": _joined_blocks,
        "q42_inherited_values": _inherited,
        "q43_image_places": _places,
        "q44_observed_totals": _totals,
        "q45_progress": _progress,
    }


_ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_STEM = r"nullif(regexp_replace(regexp_extract({}, '([^/]*)/*$', 1), '(.)\.[^.]*$', '\1'), '')"


def oracle_sql() -> dict[str, str]:
    nl, e = "chr(10)", _ESCAPED.format
    head = f"""'<?xml version="1.0" encoding="UTF-8"?>' || {nl} || '<!DOCTYPE html>' || {nl} || '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">' || {nl}"""
    left = lambda k: f"(1::float - (l[4 * p + {k}]::float / 255::float)::float)"
    mixed = lambda k: f"floor(255::float * {left(k)} * {left(4)})::int"
    table = lambda k, v: f"(case when {k} * v + {v} < 200 then {k} * v + {v} else 0 end)"
    pale = lambda j: f"floor(255::float * (1::float - ({table(4, j)}::float / 255::float)::float) * (1::float - ({table(4, 3)}::float / 255::float)::float))::int"
    hexed = lambda *x: " || ".join(f"lpad(lower(hex({v})), 2, '0')" for v in x)
    blank = r"regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''"
    only_lines = {"lines": f"select * from ({X.CTES['lines']}) where {blank}", "shown": f"select * from ({X.CTES['shown']}) where false"}
    titled = r"case when length(coalesce(text, '')) % 3 > 0 then nullif(regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g'), '') end"
    path = "case when doc_id % 2 = 0 then '/in/vol.' || doc_id::varchar || '.final' else '/in/livro' end"
    image = f"""'<img src="data:' || mime || ';base64,' || base64(encode(bytes)) || '" alt=""/>' || {nl}"""
    previews = X.with_ctes(
        f"""select doc_id, md5(html) as digest, length(html)::bigint as n_chars from (select c.doc_id,
  '<!doctype html><html><head><meta charset="utf-8"><title>Preview: Doc &amp; ' || c.doc_id::varchar || '</title><style>{C.PREVIEW_STYLE}</style></head><body><img class="cover" src="cover:' || c.filename || '" alt="Capa"/>' || {nl}
  || '<h1>Doc &amp; ' || c.doc_id::varchar || '</h1>' || {nl} || '<p><em>A &lt;B&gt;</em></p>' || {nl} || coalesce(parts, '') || '</body></html>' as html from covers c left join
  (select doc_id, string_agg('<h2 id="chap' || n::varchar || '">' || {e("title")} || '</h2>' || {nl} || body || {nl} || '<hr/>' || {nl}, '' order by n) as parts from
    (select doc_id, title, body, row_number() over (partition by doc_id order by chapter_ord) as n from chapters c2 join
      (select doc_id, chapter_id, string_agg(case when kind = 'image' then {image} else html end, '' order by block_ord) as body from html join_ left join (select doc_id, filename, arg_min(mime, image_idx) as mime, arg_min(bytes, image_idx) as bytes from images group by all) i2 using (doc_id, filename) group by all) using (doc_id, chapter_id)
     where trim(body) <> '') group by doc_id) using (doc_id))"""
    )
    joined = {k: f"select 0::bigint as doc_id, doc_id * 1024 + page_num as page_num, * exclude (doc_id, page_num) from ({X.CTES[k]})" for k in ("lines", "shown")}
    joined |= {"docs": "select 0::bigint as doc_id", "covers": "select 0::bigint as doc_id, null::int as consumed_image"}
    ranks = """select doc_id, metric, n, value from (select *, row_number() over (partition by doc_id, metric order by value) - 1 as k, count(*) over (partition by doc_id, metric) as n from
  (select unnest([doc_id, null]) as doc_id, metric, value from (select doc_id, 'body_font' as metric, font_size as value from texts union all select doc_id, 'left_margin', x_start from texts union all select doc_id, 'line_gap', gap from gaps union all select doc_id, 'baseline', font_size from lines)))
  where k = case metric when 'left_margin' then round((n - 1) * 0.1::double)::bigint when 'baseline' then n // 2 else round((n - 1) * 0.5::double)::bigint end"""
    wide = lambda x: f"(3 * length({x}) - length(regexp_replace({x}, '[^a-z]', '', 'g')))"
    turn = lambda *x: f"[{', '.join(f'{v}::double' for v in x)}][(length(line) % 4)::int + 1]"
    mul = "{a: m.a * t.a + m.b * t.c, b: m.a * t.b + m.b * t.d, c: m.c * t.a + m.d * t.c, d: m.c * t.b + m.d * t.d, e: m.e * t.a + m.f * t.c + t.e, f: m.e * t.b + m.f * t.d + t.f}"
    return {
        # Words too wide in pieces (cb, from fit to fit), then lines (l, from next to next), each found by recursion.
        "q35_word_wrap": rf"""with recursive w0 as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as w from (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') as ws from documents)),
  c as (select doc_id, p, unnest(range(1, length(w)::int + 1)) as j, unnest(string_split(w, '')) as ch from w0 where {wide("w")} > 120),
  cs as (select *, sum({wide("ch")}) over (partition by doc_id, p order by j) as upto from c),
  cw as (select doc_id, p, j, (select count(*) from cs b where b.doc_id = a.doc_id and b.p = a.p and b.j >= a.j and b.upto - a.upto + {wide("a.ch")} <= 120) as fit from cs a),
  cb as (select distinct doc_id, p, 1::bigint as j from c union all select doc_id, p, j + fit from cb join cw using (doc_id, p, j) where (doc_id, p, j + fit) in (select (doc_id, p, j) from cs)),
  cp as (select cb.doc_id, cb.p, cb.j, string_agg(ch, '' order by cs.j) as w from cb join cw using (doc_id, p, j) join cs on cs.doc_id = cb.doc_id and cs.p = cb.p and cs.j between cb.j and cb.j + fit - 1 group by all),
  w as (select doc_id, row_number() over (partition by doc_id order by p, j) as k, w, {wide("w")} as width from (select doc_id, p, 0 as j, w from w0 where {wide("w")} <= 120 union all select * from cp)),
  s as (select *, sum(width + 3) over (partition by doc_id order by k) as upto from w),
  f as (select doc_id, k, k + (select count(*) from s b where b.doc_id = a.doc_id and b.k >= a.k and b.k < a.k + 64 and b.upto - a.upto + a.width <= 120) as next from s a),
  l as (select doc_id, 1::bigint as k from w where k = 1 union all select doc_id, next from l join f using (doc_id, k) where (doc_id, next) in (select (doc_id, k) from w)),
  t as (select l.doc_id, l.k, string_agg(w, ' ' order by w.k) as line from l join f using (doc_id, k) join w on w.doc_id = l.doc_id and w.k >= l.k and w.k < next group by all)
  select doc_id, count(line)::bigint as n_lines, md5(coalesce(string_agg(line, chr(10) order by k), '')) as digest from documents left join t using (doc_id) group by doc_id""",
        "q42_inherited_values": X.with_ctes(
            """select * from (with recursive nodes as (select doc_id, i as id, case when i = 0 or (doc_id + i) % 41 = 0 then null when (doc_id * 5 + i) % 23 = 3 then i + 2 else i - 1 - (doc_id + 3 * i) % least(i, 4) end as parent,
    case when length(line) % 31 = 7 then length(line) end as value, count(*) over (partition by doc_id) as n from q),
  way as (select doc_id, id, id as origin, parent, value, n, 0::bigint as steps from nodes union all select w.doc_id, w.id, t.id, t.parent, t.value, w.n, w.steps + 1 from way w join nodes t on t.doc_id = w.doc_id and t.id = w.parent where w.value is null and w.steps <= w.n)
  select doc_id, id, value::int as value, case when value is not null then origin end as origin, case when value is not null then steps end as steps, case when steps > n then 'cycle' when value is null then 'none' when steps = 0 then 'own' else 'inherited' end as found
  from way qualify row_number() over (partition by doc_id, id order by steps desc) = 1)"""
        ),
        "q43_image_places": X.with_ctes(
            f"""select * from (with recursive o as (select doc_id, i::bigint as k, ['q', 'cm', 'Do', 'Q', 'cm', 'q', 'BT', 'Do', 'Q', 'cm', 'Do'][((doc_id * 7 + i * 3 + length(line)) % 11)::int + 1] as op,
    {{a: {turn(1, 0, -1, 0)}, b: {turn(0, 1, 0, -1)}, c: {turn(0, -1, 0, 1)}, d: {turn(1, 0, 1, 0)}, e: (i * 13 % 40 - 20)::double, f: (length(line) % 50)::double}} as m from q),
  z as (select distinct doc_id, {{a: 1::double, b: 0::double, c: 0::double, d: 1::double, e: 0::double, f: 0::double}} as t from o),
  r as (select doc_id, -1::bigint as k, null::varchar as op, t, [t][2:] as saved from z
    union all select r.doc_id, o.k, o.op, case when o.op = 'cm' then {mul} when o.op = 'Q' and len(saved) > 0 then saved[-1] else t end,
      case when o.op = 'q' then list_append(saved, t) when o.op = 'Q' then saved[:-2] else saved end from r join o on o.doc_id = r.doc_id and o.k = r.k + 1)
  select doc_id, k, len(saved)::int as saves, {', '.join(f'case when t.{c} = 0 then 0::double else t.{c} end as {c}' for c in 'abcdef')}, least(800::double - t.f, 800::double - t.d - t.f) as y from r where op = 'Do')"""
        ),
        "q44_observed_totals": X.with_ctes(
            """select e.*, c.* from (select count(*) filter (is_image = 0) as lines, count(*) filter (is_image = 1) as images, sum(length(text))::bigint as chars from events) e,
  (select count(*) as chapters, max(n_events)::bigint as longest from chapters) c"""
        ),
        "q39_rank_selection": X.with_ctes(ranks),
        "q40_range_blocks": X.with_ctes("select * from blocks"),
        "q41_joined_blocks": X.with_ctes("select * exclude (doc_id) from blocks", joined),
        "q01_flow_union": X.with_ctes("select * from events"),
        "q02_nonblank_lines": X.with_ctes("select doc_id, event_seq, text, length(text)::bigint as n_chars from texts"),
        "q03_page_counts": X.with_ctes("select doc_id, page_num, count(*) filter (is_image = 0) as n_lines, count(*) filter (is_image = 1) as n_images from events group by all"),
        "q04_nearest_rank_font": X.with_ctes("select * from fonts"),
        "q05_left_margin": X.with_ctes("select * from margins"),
        "q06_line_gap": X.with_ctes("select * from linegaps"),
        "q07_layout_metrics": X.with_ctes("select * from metrics"),
        "q08_chapter_baseline": X.with_ctes("select * from bases"),
        "q09_heading_lines": X.with_ctes("select doc_id, event_seq, t as text from heads where is_heading"),
        "q10_chapters": X.with_ctes("select * from chapters"),
        "q11_line_kinds": X.with_ctes("select doc_id, chapter_id, event_seq, kind from kinds"),
        "q12_paragraph_breaks": X.with_ctes("select doc_id, event_seq, indented, gapped, after_image from kinds"),
        "q13_blocks": X.with_ctes("select * from blocks"),
        "q14_block_counts": X.with_ctes("select kind, count(*) as n from blocks group by kind"),
        "q15_escape_html": f"select page_id, md5({e('html')}) as digest from pages",
        "q16_block_html": X.with_ctes("select doc_id, chapter_id, block_ord, html from html"),
        "q17_chapter_body": X.with_ctes("select doc_id, chapter_ord, title, body from bodies"),
        "q18_chapter_xhtml": X.with_ctes(
            f"""select doc_id, out_ord, 'chap_' || lpad(out_ord::varchar, greatest(2, length(out_ord::varchar))::int, '0') || '.xhtml' as href, title, {head} || '<head><title>' || {e("title")} || '</title><meta charset="utf-8"/></head>' || {nl}
  || '<body>' || {nl} || '<h1>' || {e("title")} || '</h1>' || {nl} || body || {nl} || '</body>' || {nl} || '</html>' || {nl} as xhtml from kept"""
        ),
        "q19_cover_candidates": X.with_ctes("select doc_id, page_num, page_ord::int as page_ord, image_idx, filename, mime, width, height, fits, sharp from best"),
        "q20_cover_selection": X.with_ctes("select * from covers"),
        "q21_cover_xhtml": X.with_ctes(
            f"""select doc_id, {head} || '<head><title>Capa</title><meta charset="utf-8"/>' || {nl} || '<style>body{{margin:0;padding:0;}}</style></head>' || {nl} || '<body epub:type="cover">' || {nl}
  || '<div style="text-align:center;page-break-after:always;">' || {nl} || '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" version="1.1" width="100%" height="100%" viewBox="0 0 ' || width::varchar || ' ' || height::varchar
  || '" preserveAspectRatio="xMidYMid meet">' || {nl} || '  <image width="' || width::varchar || '" height="' || height::varchar || '" xlink:href="' || filename || '"/>' || {nl} || '</svg>' || {nl} || '</div>' || {nl} || '</body>' || {nl} || '</html>' || {nl} as xhtml from covers"""
        ),
        "q22_resources": X.with_ctes(
            """select doc_id, image_idx, filename, mime from (select i.*, row_number() over (partition by doc_id, i.filename order by image_idx) k from images i left join (select doc_id, consumed_image from covers) using (doc_id)
  where image_idx is distinct from consumed_image) where k = 1"""
        ),
        "q23_data_uri": X.with_ctes("select doc_id, image_idx, 'data:' || mime || ';base64,' || base64(encode(bytes)) as uri from images"),
        "q24_preview_html": previews,
        "q25_glyph_lines": """with w as (select doc_id, unnest(range(len(string_split(text, ' '))))::int as k, unnest(string_split(text, ' ')) as w from documents where text is not null),
  g as (select doc_id, (k // 480)::int + 1 as page_num, k, 50::double + 40::double * (k % 12) as x, 60::double + 14::double * (k % 480 // 12) + case when (doc_id + k) % 17 = 0 then 3::double else 0::double end as y,
    case when (doc_id + k) % 23 = 0 then 12::double else 10::double end as fs, w || ' ' as ch, k % 5 <> 3 as ws from w),
  b as (select *, coalesce(ws and (abs(y - lag(y) over p) > 1.5::double * fs or (x < lag(x + 3.5::double * fs) over p and abs(y - lag(y) over p) > 0.5::double * fs)), false)::int as s from g window p as (partition by doc_id, page_num order by k)),
  l as (select *, sum(s) over (partition by doc_id, page_num order by k rows unbounded preceding) as line_id from b),
  a as (select doc_id, page_num, line_id, regexp_replace(string_agg(ch, '' order by k), '^\\s+|\\s+$', '', 'g') as text, arg_min(y, k) as y, max(fs) as font_size, least(greatest(min(x) / 600::double, 0::double), 1::double) as x_start from l group by all)
  select doc_id, page_num, row_number() over (partition by doc_id, page_num order by line_id)::int as line_ord, text, y, font_size, x_start from a where text <> ''""",
        "q26_image_position": X.with_ctes("select doc_id, i, least(800::double - (length(line) * 7 % 800)::double, 800::double - (length(line) * 3 % 400 - 200)::double - (length(line) * 7 % 800)::double) as y from q"),
        "q27_pdf_string_decode": "select doc_id, md5(text) as digest, length(text)::bigint as n_chars from documents",
        "q28_output_names": f"select page_id, coalesce({_STEM.format('url')}, 'Documento') as title, coalesce({_STEM.format('url')}, 'livro') || '.epub' as epub from pages",
        "q29_cmyk_rgb": X.with_ctes(
            f"""select doc_id, i, len(l) // 4 as pixels, md5(coalesce(array_to_string(flatten(list_transform(range(len(l) // 4), lambda p: [{mixed(1)}, {mixed(2)}, {mixed(3)}])), ','), '')) as digest
  from (select doc_id, i, list_transform(string_split(line, ''), lambda c: unicode(c) % 256) as l from q)"""
        ),
        "q45_progress": X.with_ctes(
            """select doc_id, count(*) filter (is_image = 0) as lines, count(*) filter (is_image = 1) as images, coalesce(sum(length(text)), 0)::bigint as chars, max(page_num) as page_num,
  arg_max(case when is_image = 1 then 'image ' || image_idx::varchar else text end, arrival_seq) as message from (select * from lines union all select * from shown) group by doc_id"""
        ),
        "q30_unpack_bits": X.with_ctes(
            """select doc_id, i, array_to_string(list_transform(range(w * greatest(1, (length(b) + r - 1) // r)), lambda x: case when (x // w) * r + (x % w) * d < length(b) then substr(b, ((x // w) * r + (x % w) * d + 1)::int, 1) else '0' end), '') as bits from
  (select *, (w * d + 7) // 8 * 8 as r from (select doc_id, i, 3 + length(line) % 9 as w, [1, 2, 4, 8][i % 4 + 1] as d,
    coalesce(array_to_string(list_transform(string_split(lower(hex(encode(line))), ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), ''), '') as b from q where line <> '' union all select doc_id, i, 3, [1, 2, 4, 8][i % 4 + 1], '' from q where line = ''))"""
        ),
        "q31_indexed_palette": f"""with v as (select unnest(range(256)) as v), p as (select v, 0 as base, {hexed(table(1, 0), table(1, 0), table(1, 0))} as rgb from v
  union all select v, 1, {hexed(table(3, 0), table(3, 1), table(3, 2))} from v union all select v, 2, {hexed(pale(0), pale(1), pale(2))} from v),
  t as (select doc_id, length(coalesce(text, '')) % 3 as base, unnest(bytes) as h, generate_subscripts(bytes, 1) as pos from (select doc_id, text, regexp_extract_all(lower(hex(encode(text))), '..') as bytes from documents)),
  j as (select doc_id, string_agg(rgb, '' order by pos) as rgb from t join p on t.base = p.base and v = (instr('0123456789abcdef', h[1]) - 1) * 16 + instr('0123456789abcdef', h[2]) - 1 group by doc_id)
  select doc_id, md5(coalesce(rgb, '')) as digest, (length(coalesce(rgb, '')) // 6)::bigint as pixels from documents left join j using (doc_id)""",
        "q32_codec_dispatch": """select doc_id, case n % 8 when 1 then 'DCTDecode with other filters' when 3 then 'unsupported codec' when 4 then 'unsupported codec' when 5 then 'unsupported codec' end as error,
  case when n % 8 in (0, 2, 6, 7) then 'img_' || (n % 100)::varchar || '_' || (n % 3)::varchar || '.' || case when n % 8 = 0 then 'jpg' else 'png' end end as filename from (select doc_id, length(coalesce(text, '')) as n from documents)""",
        "q34_pdf_roundtrip": X.with_ctes(
            r"""select doc_id, (i // 40)::int + 1 as page_num, row_number() over (partition by doc_id, i // 40 order by i)::int as line_ord, t as text, 60::double + 17 * (i % 40) as y, 10::double as font_size,
  round((60 + 9 * (i % 40 % 3)) / 600::double, 9) as x_start from (select *, regexp_replace(line, '^\s+|\s+$', '', 'g') as t from q) where t <> ''"""
        ),
        "q36_convert": X.with_ctes(
            f"""select doc_id, 'book_' || doc_id::varchar || '.epub' as path, out_ord, 'chap_' || lpad(out_ord::varchar, greatest(2, length(out_ord::varchar))::int, '0') || '.xhtml' as href,
  md5({head} || '<head><title>' || {e("title")} || '</title><meta charset="utf-8"/><link rel="stylesheet" type="text/css" href="stylesheet.css"/></head>' || {nl}
  || '<body>' || {nl} || '<h1>' || {e("title")} || '</h1>' || {nl} || body || {nl} || '</body>' || {nl} || '</html>' || {nl}) as digest from kept""",
            only_lines,
        ),
        "q37_metadata": f"""select doc_id, coalesce({titled}, {_STEM.format(path + " || '.pdf'")}) as title, case when length(coalesce(text, '')) % 3 = 2 then trim(coalesce(source, 'x')) else '' end as author,
  case when doc_id % 2 = 1 and (select count(*) from documents where doc_id % 2 = 1) > 1 then doc_id::varchar || '-' else '' end || {_STEM.format(path + " || '.pdf'")} || '.epub' as name from documents""",
        "q38_file_sink": "select 'page_' || page_id::varchar || '.html' as name, octet_length(encode(coalesce(html, '')))::bigint as n_bytes, md5(coalesce(html, '')) as digest from pages",
        "q33_diagnostics": X.with_ctes(
            """select * from (select stage, row_number() over (partition by stage order by doc_id desc, page_num desc, event_seq desc)::int as age, doc_id, page_num, event_seq, level, message from
  (select doc_id, 'chapters' as stage, page_num, event_seq, 'info' as level, 'heading: ' || text as message from marked where is_heading union all
   select doc_id, 'cover', page_num, 0, 'warning', case when not fits then 'too small for a cover: ' else 'cover below the sharp size: ' end || width::varchar || 'x' || height::varchar from best where not fits or not sharp)) where age <= 500"""
        ),
    }
