"""From ordered events (text lines and images) to metrics, chapters, blocks and markup.

Tables: ``docs`` (doc_id), ``events`` (doc_id, page_num, arrival_seq, y, is_image, text, font_size, x_start, image_idx),
``images`` (doc_id, image_idx, filename, mime, width, height, and bytes at sinks only). Reading order is explicit in
``event_seq``.

Two exchanges by doc_id carry a document: its numbers (no text), from which one aggregate makes the ``profile`` with all
that is known of the whole document (metrics, opening images, names of images), and its events. These meet by doc_id, and
every later state is a lag or a running sum over windows by doc_id, every later aggregate has doc_id among its keys: text
is sent once. Documents too large for one task have ``ranges`` in the place of these windows, and ``ranks`` in the place of
the profile's arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import FIRST_CHAPTER, block_html, has_words, image_path, image_tag, is_chapter_line, utrim, xhtml_document

# Thresholds, relative to a document's metrics or to the page width.
INDENT, PARAGRAPH_GAP, RIGHT_X = 0.012, 1.35, 0.45
HEADING_FONT, CAPTION_FONT, CHAPTER_FONT = 1.10, 0.92, 1.25
HEADING_CHARS, RIGHT_CHARS = 80, 60
SMALLEST = 2.2250738585072014e-308


def d(x: float) -> Column:
    return F.lit(float(x))


def ordered(events: DataFrame) -> DataFrame:
    """Adds event_seq: pages in order, then y, lines before images, then arrival; null in rows without an event."""
    order = Window.partitionBy("doc_id").orderBy("page_num", "y", "is_image", "arrival_seq")
    return events.withColumn("event_seq", F.when(F.col("is_image").isNotNull(), F.row_number().over(order)))


def all_events(lines: DataFrame, images: DataFrame) -> DataFrame:
    return lines.unionByName(images, allowMissingColumns=True)


def union_events(lines: DataFrame, images: DataFrame) -> DataFrame:
    return ordered(all_events(lines, images))


def text_lines(events: DataFrame) -> DataFrame:
    return events.where("is_image = 0").withColumn("text", utrim(F.col("text"))).where("text <> ''")


def ranked(values: str, q: str) -> str:
    """SQL of the value at index round((n - 1) * q) of a sorted array (half away from zero); null of an empty one."""
    return f"if(size({values}) = 0, null, {values}[cast(round((size({values}) - 1) * {q}D) as int)])"


def profile_rows(docs: DataFrame, events: DataFrame, images: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """What a profile is made of: doc_id with page_num (of a page), line, shown or entry (of an image), or none of them.

    ``pages`` (doc_id, page_num), where given, are the document's pages; else they are those that have events.
    """
    line = F.struct("page_num", "y", "arrival_seq", (utrim(F.col("text")) == "").alias("blank"), "font_size", "x_start")
    shown = F.struct("page_num", "y", "arrival_seq", "image_idx")
    page = F.col("page_num") if pages is None else F.lit(None).cast("int")
    out = events.select("doc_id", page.alias("page_num"), F.when(F.col("is_image") == 0, line).alias("line"), F.when(F.col("is_image") == 1, shown).alias("shown"))
    out = out.unionByName(docs.select("doc_id"), True)
    if pages is not None:
        out = out.unionByName(pages.select("doc_id", "page_num"), True)
    if images is not None:
        entry = F.struct(F.col("image_idx").alias("key"), F.struct("filename", "mime", "width", "height").alias("value"))
        out = out.unionByName(images.select("doc_id", entry.alias("entry")), True)
    return out


def numbers(rows: DataFrame) -> DataFrame:
    """One row per document: its lines and shown images as arrays in reading order, its first two pages, and entries."""
    entries = [F.collect_list("entry").alias("entries")] if "entry" in rows.columns else []
    return rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list("line")).alias("lines"),
        F.array_sort(F.collect_list("shown")).alias("shown"),
        F.slice(F.array_sort(F.collect_set("page_num")), 1, 2).alias("opening"),
        *entries,
    )


def measured(arrays: DataFrame) -> DataFrame:
    """Adds body_font, margin, gap (null without such lines) and chapter_font to ``numbers``."""
    texts = arrays.withColumn("texts", F.expr("filter(lines, l -> not l.blank)"))
    sorted_ = {
        "_fonts": "sort_array(transform(texts, l -> l.font_size))",
        "_margins": "sort_array(transform(texts, l -> l.x_start))",
        "_all": "sort_array(transform(lines, l -> l.font_size))",
        "_gaps": """sort_array(filter(transform(texts, (l, i) -> if(i > 0 and texts[i - 1].page_num = l.page_num, l.y - texts[i - 1].y, null)), g -> g > 0))""",
    }
    texts = texts.withColumns({k: F.expr(v) for k, v in sorted_.items()})
    found = {
        "body_font": f"if(size(_fonts) = 0, null, greatest({ranked('_fonts', '0.5')}, {SMALLEST}D))",
        "margin": ranked("_margins", "0.10"),
        "gap": f"if(size(_gaps) = 0, null, greatest({ranked('_gaps', '0.5')}, {SMALLEST}D))",
        "chapter_font": "if(size(_all) = 0, null, _all[cast(floor(size(_all) / 2) as int)])",
    }
    return texts.withColumns({k: F.expr(v) for k, v in found.items()}).drop("texts", *sorted_)


def profile_of(rows: DataFrame) -> DataFrame:
    """One row per document of ``profile_rows``: baseline_font, left_margin, line_gap (1, 0 and 1 without lines), baseline
    (of chapters; 1 without lines), shown, opening, and names (of images, by image_idx; null without images)."""
    found = measured(numbers(rows))
    names = [F.when(F.size("entries") > 0, F.map_from_entries("entries")).alias("names")] if "entries" in found.columns else []
    font = F.when(F.col("body_font") > 0, F.col("body_font")).otherwise(d(1))
    metrics = {"baseline_font": F.coalesce("body_font", d(1)), "left_margin": F.coalesce("margin", d(0)), "line_gap": F.coalesce("gap", font), "baseline": F.coalesce("chapter_font", d(1))}
    return found.select("doc_id", "shown", "opening", *names, *[c.alias(n) for n, c in metrics.items()])


def profile(docs: DataFrame, events: DataFrame, images: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """``profile_of`` the ``profile_rows`` of these tables."""
    return profile_of(profile_rows(docs, events, images, pages))


def body_font(rows: DataFrame) -> DataFrame:
    """Of ``profile_rows``; this and the next two give no row for documents without such lines."""
    return measured(numbers(rows)).where("body_font is not null").select("doc_id", F.col("body_font").alias("baseline_font"))


def left_margin(rows: DataFrame) -> DataFrame:
    return measured(numbers(rows)).where("margin is not null").select("doc_id", F.col("margin").alias("left_margin"))


def line_gap(rows: DataFrame) -> DataFrame:
    return measured(numbers(rows)).where("gap is not null").select("doc_id", F.col("gap").alias("line_gap"))


def line_medians(events: DataFrame) -> DataFrame:
    """doc_id and chapter_font: the upper median of the font sizes of all lines, blank ones too; from counts by size."""
    sizes = events.where("is_image = 0").groupBy("doc_id", "font_size").agg(F.count("*").alias("n"))
    of = Window.partitionBy("doc_id")
    at = sizes.withColumn("upto", F.sum("n").over(of.orderBy("font_size"))).withColumn("place", F.floor(F.sum("n").over(of) / 2))
    return at.where("upto > place and upto - n <= place").select("doc_id", F.col("font_size").alias("chapter_font"))


def with_baselines(events: DataFrame) -> DataFrame:
    """``events``, ordered or not, with the ``baseline`` of their document: line_medians, or 1 without lines."""
    return events.join(line_medians(events), "doc_id", "left").withColumn("baseline", F.coalesce("chapter_font", d(1))).drop("chapter_font")


def with_facts(events: DataFrame) -> DataFrame:
    """``events`` with all that headings, kinds and blank lines are told by of a text: chars, worded, chapter_line. Trims text."""
    text = F.col("text")
    return events.withColumn("text", utrim(text)).withColumns({"chars": F.char_length(text), "worded": has_words(text), "chapter_line": is_chapter_line(text)})


def with_headings(flow: DataFrame) -> DataFrame:
    """``flow`` (events with their document's baseline, and facts if they are known) with is_heading."""
    text, base = utrim(F.col("text")), F.col("baseline")
    known = "chars" in flow.columns
    chars, worded, chapter_line = (F.col(c) for c in ("chars", "worded", "chapter_line")) if known else (F.char_length(text), has_words(text), is_chapter_line(text))
    sized = (base > 0) & (F.col("font_size") >= base * d(CHAPTER_FONT)) & (chars < HEADING_CHARS)
    heading = (F.col("is_image") == 0) & worded & (chapter_line | sized)
    return flow.withColumn("is_heading", F.coalesce(heading, F.lit(False)))


def chapter_events(flow: DataFrame) -> DataFrame:
    """``flow`` with is_heading and chapter_id: the number of heading runs so far."""
    order = Window.partitionBy("doc_id").orderBy("event_seq")
    starts = F.col("is_heading") & ~F.coalesce(F.lag("is_heading").over(order), F.lit(False))
    marked = with_headings(flow).withColumn("starts", starts.cast("int"))
    return marked.withColumn("chapter_id", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def _retained(found: DataFrame) -> DataFrame:
    """Of all chapters (doc_id, chapter_id, title, n_events) those with a body; the last one of documents that have none."""
    by = Window.partitionBy("doc_id")
    kept = found.withColumn("any", F.max("n_events").over(by)).withColumn("last", F.max("chapter_id").over(by)).where("n_events > 0 or (any = 0 and chapter_id = last)")
    number = F.row_number().over(by.orderBy("chapter_id"))
    return kept.drop("any", "last").withColumns({"chapter_ord": number, "title": F.coalesce("title", F.lit(FIRST_CHAPTER))})


_TITLE = "listagg(case when is_heading then regexp_replace(text, '(?U)^\\\\s+|\\\\s+$', '') end, ' ') within group (order by event_seq)"


def chapters(marked: DataFrame) -> DataFrame:
    """doc_id, chapter_id, chapter_ord, title, n_events: chapters with a body; the last one of documents that have none.

    A document without events has one row in ``marked``, whose event_seq is null.
    """
    body = F.col("event_seq").isNotNull() & ~F.col("is_heading")
    found = marked.groupBy("doc_id", "chapter_id").agg(F.expr(_TITLE).alias("title"), F.count_if(body).alias("n_events"))
    return _retained(found).select("doc_id", "chapter_id", "chapter_ord", "title", "n_events")


def line_kind(chars: Column, worded: Column, font: Column, x: Column, image: Column, base: Column, after_image: Column) -> Column:
    """What a live row is: image, heading, caption, right or paragraph."""
    return (
        F.when(image, "image")
        .when(worded & (font >= base * d(HEADING_FONT)) & (chars < HEADING_CHARS), "heading")
        .when(after_image & (font <= base * d(CAPTION_FONT)), "caption")
        .when((x > RIGHT_X) & (chars < RIGHT_CHARS), "right")
        .otherwise("paragraph")
    )


def with_live(marked: DataFrame) -> DataFrame:
    """``marked`` with live: non-blank lines and images of bodies, without the image that became the cover. Trims text (that
    with facts is trimmed)."""
    known = "chars" in marked.columns
    lines = marked if known else marked.withColumn("text", utrim(F.col("text")))
    cover = (F.col("is_image") == 1) & F.col("image_idx").eqNullSafe(F.col("consumed_image"))
    live = ~F.col("is_heading") & ((F.col("is_image") == 1) | (F.col("chars") > 0 if known else F.col("text") != "")) & ~cover
    return lines.withColumn("live", F.coalesce(live, F.lit(False)))


def with_kinds(lines: DataFrame, order: WindowSpec, row: Column | None = None, kind: Column | None = None) -> DataFrame:
    """Rows ``with_live`` with kind, indented, gapped, after_image and starts (1 where a block starts, null if not live).

    ``order`` is that of reading; only live rows of the same chapter count as earlier ones. ``row`` (is_image, y) and
    ``kind`` are those of the live row before it, where it has one: else a chapter's first live row has none before it.
    """
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda *c: F.last(F.when(F.col("live"), F.struct("chapter_id", *c)), ignorenulls=True).over(before)
    lines = lines.withColumn("_p", last("is_image", "y"))
    earlier = F.when(F.col("_p.chapter_id") == F.col("chapter_id"), F.struct("_p.is_image", "_p.y"))
    lines = lines.withColumn("_p", earlier if row is None else F.coalesce(earlier, row))
    lines = lines.withColumn("after_image", F.coalesce(F.col("_p.is_image") == 1, F.lit(False)))
    chars, worded = (F.col("chars"), F.col("worded")) if "chars" in lines.columns else (F.char_length("text"), has_words(F.col("text")))
    own = line_kind(chars, worded, F.col("font_size"), F.col("x_start"), F.col("is_image") == 1, F.col("baseline_font"), F.col("after_image"))
    gap = F.col("y") - F.when(~F.col("after_image"), F.col("_p.y"))
    lines = (
        lines.withColumn("kind", F.when(F.col("live"), own))
        .withColumn("indented", F.coalesce(F.col("x_start") > F.col("left_margin") + d(INDENT), F.lit(False)))
        .withColumn("gapped", F.coalesce((gap > 0) & (gap > F.col("line_gap") * d(PARAGRAPH_GAP)), F.lit(False)))
    )
    lines = lines.withColumn("_k", last("kind"))
    previous = F.when(F.col("_k.chapter_id") == F.col("chapter_id"), F.col("_k.kind"))
    previous = previous if kind is None else F.coalesce(previous, kind)
    starts = (
        (F.col("kind") == "image") | F.col("after_image") | previous.isNull() | (F.col("kind") != previous) | ((F.col("kind") == "paragraph") & (F.col("indented") | F.col("gapped")))
    )
    return lines.withColumn("starts", F.when(F.col("live"), starts.cast("int"))).drop("_p", "_k")


def classified(marked: DataFrame) -> DataFrame:
    """``marked`` with live, kind, indented, gapped, after_image and block_ord (from 1), chapter by chapter.

    Rows that are not live have no kind. ``marked`` has the metrics of its document, and consumed_image.
    """
    order = Window.partitionBy("doc_id", "chapter_id").orderBy("event_seq")
    found = with_kinds(with_live(marked), order)
    return found.withColumn("block_ord", F.when(F.col("live"), F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("starts")


def _grouped(kinds: DataFrame) -> DataFrame:
    """Blocks by block_ord; rows that are not live are block 0, which has the chapter's title."""
    filename = [F.max("filename").alias("filename")] if "filename" in kinds.columns else []
    return kinds.withColumn("block_ord", F.coalesce("block_ord", F.lit(0).cast("long"))).groupBy("doc_id", "chapter_id", "block_ord").agg(
        F.max("kind").alias("kind"),
        F.expr("listagg(case when live then text end, ' ') within group (order by event_seq)").alias("text"),
        F.max(F.when(F.col("live"), F.col("image_idx"))).alias("image_idx"),
        F.expr(_TITLE).alias("title"),
        F.count_if(F.col("event_seq").isNotNull() & ~F.col("is_heading")).alias("n_events"),
        *filename,
    )


def blocks(kinds: DataFrame) -> DataFrame:
    """doc_id, chapter_id, block_ord, kind, text, image_idx."""
    return _grouped(kinds.where("live")).select("doc_id", "chapter_id", "block_ord", "kind", "text", "image_idx")


def with_names(flow: DataFrame, value: str = "filename") -> DataFrame:
    """``flow`` with the file name of each shown image, null if it has no asset."""
    return flow.withColumn("filename", F.when(F.col("image_idx").isNotNull(), F.element_at("names", F.col("image_idx"))[value])).drop("names")


def rendered_blocks(kinds: DataFrame) -> DataFrame:
    """blocks with html; images without an asset are dropped. ``kinds`` has filename."""
    found = _grouped(kinds.where("live"))
    return found.withColumn("html", block_html(F.col("kind"), F.col("text"), F.col("filename"))).where("html is not null").drop("title", "n_events")


def chapter_pieces(kinds: DataFrame) -> DataFrame:
    """Chapters (doc_id, chapter_id, chapter_ord, title, n_events) with pieces: their blocks in order, each with html, or,
    of an image that has an asset, with its filename. ``kinds`` has filename."""
    parts = _grouped(kinds)
    html = F.when(F.col("kind") != "image", block_html(F.col("kind"), F.col("text"), F.col("filename")))
    piece = F.struct("block_ord", html.alias("html"), F.when(F.col("kind") == "image", F.col("filename")).alias("filename"))
    piece = F.when((F.col("block_ord") > 0) & ((F.col("kind") != "image") | F.col("filename").isNotNull()), piece)
    found = parts.groupBy("doc_id", "chapter_id").agg(F.max("title").alias("title"), F.sum("n_events").alias("n_events"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    return _retained(found).select("doc_id", "chapter_id", "chapter_ord", "title", "n_events", "pieces")


def body_html(pieces: Column, source: Callable[[Column], Column] = image_path) -> Column:
    """The markup of ``pieces``, images with the ``source`` of their filename; '' of none."""
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(p["html"], image_tag(source(p["filename"])))), "")


def chapter_bodies(kinds: DataFrame) -> DataFrame:
    """``chapter_pieces`` with body in the place of pieces; images are files beside the chapter."""
    return chapter_pieces(kinds).withColumn("body", body_html(F.col("pieces"))).drop("pieces")


def written_chapters(pieces: DataFrame) -> DataFrame:
    """Chapters whose body is not blank, numbered anew: doc_id, out_ord, href, title, pieces."""
    shows = F.exists("pieces", lambda p: p["filename"].isNotNull() | (utrim(p["html"]) != ""))
    kept = pieces.where(shows).withColumn("out_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter_ord")))
    return kept.select("doc_id", "out_ord", F.format_string("chap_%02d.xhtml", "out_ord").alias("href"), "title", "pieces")


def chapter_documents(chapters: DataFrame) -> DataFrame:
    """``written_chapters`` with body and xhtml in the place of pieces."""
    found = chapters.withColumn("body", body_html(F.col("pieces"))).drop("pieces")
    return found.withColumn("xhtml", xhtml_document(F.col("title"), F.col("body")))
