"""Cover selection, resources to write, preview pages and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import data_uri, escape_html, image_path
from .layout import body_html

# Sizes in pixels.
LEAST_WIDTH, LEAST_HEIGHT = 300, 400
GOOD_WIDTH, GOOD_HEIGHT = 625, 1000
DRAWN_WIDTH, DRAWN_HEIGHT = 1600, 2560
#: The look of a preview page: a column of text on paper, chapters told apart by a rule.
PREVIEW_STYLE = (
    "html{background:#e8e6e1}body{box-sizing:border-box;width:min(100%,44rem);min-height:100vh;margin:auto;padding:2.5rem 2rem;background:#fff;color:#222;font:1.05rem/1.6 serif}"
    "h1,h2{line-height:1.2;font-weight:600}h2[id]{margin-top:3rem}hr{border:0;height:1px;background:#bbb}figure,img{width:auto;height:auto;max-width:100%}img.cover{height:60vh;border:1px solid #bbb}"
    ".legenda{font-size:.85em;text-align:center}.direita{text-align:right}"
)


def with_candidates(profile: DataFrame) -> DataFrame:
    """``profile`` with candidates: of each of the first two pages the largest image (of equal ones the last)."""
    known = "filter(shown, s -> s.page_num = p and names[s.image_idx] is not null)"
    sized = f"transform({known}, s -> named_struct('area', cast(names[s.image_idx].width as long) * names[s.image_idx].height, 'y', s.y, 'at', s.arrival_seq, 'image_idx', s.image_idx))"
    best = f"transform(opening, (p, k) -> named_struct('page_num', p, 'page_ord', k + 1, 'best', array_max({sized})))"
    return profile.withColumn("candidates", F.expr(f"filter({best}, c -> c.best is not null)"))


def cover_candidates(profile: DataFrame) -> DataFrame:
    """The largest image of each of the first two pages, with fits and sharp."""
    found = with_candidates(profile).select("doc_id", "names", F.explode("candidates").alias("c"))
    named = found.select("doc_id", "c.page_num", "c.page_ord", F.col("c.best.image_idx").alias("image_idx"), F.element_at("names", F.col("c.best.image_idx")).alias("n"))
    return named.select("doc_id", "page_num", "page_ord", "image_idx", "n.*").withColumns(
        {"fits": (F.col("width") >= LEAST_WIDTH) & (F.col("height") >= LEAST_HEIGHT), "sharp": (F.col("width") >= GOOD_WIDTH) & (F.col("height") >= GOOD_HEIGHT)}
    )


def with_cover(profile: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """``profile`` with cover: source (given, detected or drawn), filename, mime, width, height, consumed_image.

    ``given`` has doc_id, mime, width and height of usable cover files; at most one for each document.
    """
    size = f"names[c.best.image_idx].width >= {LEAST_WIDTH} and names[c.best.image_idx].height >= {LEAST_HEIGHT}"
    out = with_candidates(profile).withColumn("_i", F.expr(f"get(filter(candidates, c -> {size}), 0).best.image_idx"))
    image = F.element_at("names", F.col("_i"))

    def cover(source: str, filename: Column, mime: Column, width: Column, height: Column, consumed: Column) -> Column:
        parts = (F.lit(source).alias("source"), filename.alias("filename"), mime.alias("mime"), width.cast("int").alias("width"), height.cast("int").alias("height"), consumed.cast("int").alias("consumed_image"))
        return F.struct(*parts)

    name = lambda mime: F.when(mime == "image/jpeg", F.lit("cover.jpg")).otherwise(F.lit("cover.png"))
    drawn = cover("drawn", F.lit("cover.svg"), F.lit("image/svg+xml"), F.lit(DRAWN_WIDTH), F.lit(DRAWN_HEIGHT), F.lit(None))
    best = F.when(F.col("_i").isNotNull(), cover("detected", name(image["mime"]), image["mime"], image["width"], image["height"], F.col("_i"))).otherwise(drawn)
    if given is not None:
        own = given.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("mime", "width", "height")])
        out = out.join(own, "doc_id", "left")
        best = F.when(F.col("_mime").isNotNull(), cover("given", name(F.col("_mime")), F.col("_mime"), F.col("_width"), F.col("_height"), F.lit(None))).otherwise(best)
    return out.withColumn("cover", best).drop("_i", "_mime", "_width", "_height", "candidates")


def consumed_images(events: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id and consumed_image, where a shown image becomes the cover: that of ``with_cover``, of documents of any size."""
    pages = events.select("doc_id", "page_num").distinct()
    first = pages.groupBy("doc_id").agg(F.min("page_num").alias("first"))
    second = pages.join(first, "doc_id").where(F.col("page_num") > F.col("first")).groupBy("doc_id").agg(F.min("page_num").alias("page_num"))
    opening = first.select("doc_id", F.col("first").alias("page_num")).unionByName(second)
    sized = images.select("doc_id", "image_idx", "width", "height")
    shown = events.where("is_image = 1").join(opening, ["doc_id", "page_num"]).join(sized, ["doc_id", "image_idx"])
    area = F.col("width").cast("long") * F.col("height")
    best = shown.groupBy("doc_id", "page_num").agg(F.max(F.struct(area.alias("area"), "y", "arrival_seq", "image_idx", "width", "height")).alias("b"))
    return best.where((F.col("b.width") >= LEAST_WIDTH) & (F.col("b.height") >= LEAST_HEIGHT)).groupBy("doc_id").agg(F.min_by("b.image_idx", "page_num").alias("consumed_image"))


def select_covers(profile: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """One row per document: its cover."""
    return with_cover(profile, given).select("doc_id", "cover.*")


def resources(images: DataFrame, covers: DataFrame) -> DataFrame:
    """Images to write: without the consumed one, the first of each filename."""
    left = images.join(covers.select("doc_id", "consumed_image"), "doc_id", "left").where("not (image_idx <=> consumed_image)")
    first = Window.partitionBy("doc_id", "filename").orderBy("image_idx")
    return left.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "consumed_image")


def image_uris(images: DataFrame) -> DataFrame:
    """images with uri in the place of bytes."""
    return images.withColumn("uri", data_uri(F.col("mime"), F.col("bytes"))).drop("bytes")


def preview_pages(chapters: DataFrame, meta: DataFrame, uris: DataFrame) -> DataFrame:
    """One page per document: cover, title, author, and all chapters with their images as data URIs.

    ``chapters``: doc_id, out_ord, title, pieces (of ``written_chapters``); ``meta``: doc_id, title, author, cover_uri;
    ``uris``: doc_id, image_idx, filename, uri, of equal names the first counts; partitioned by doc_id, so that they are not
    sent again. A document's URIs meet its page, where each image block takes its own: no chapter meets those of others.
    """
    chapter = F.struct("out_ord", "title", "pieces")
    pages = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(chapter)).alias("chapters"))
    own = uris.groupBy("doc_id", "filename").agg(F.min_by("uri", "image_idx").alias("uri"))
    own = own.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("filename", "uri"))).alias("uris"))
    part = lambda c: F.concat(
        F.lit('<h2 id="chap'), c["out_ord"].cast("string"), F.lit('">'), escape_html(c["title"]), F.lit("</h2>\n"),
        body_html(c["pieces"], lambda name: F.coalesce(F.element_at("uris", name), image_path(name))), F.lit("\n<hr/>\n"),
    )
    title, author = escape_html(F.col("title")), escape_html(F.col("author"))
    page = F.concat(
        F.lit('<!doctype html><html><head><meta charset="utf-8"><title>Preview: '), title, F.lit(f"</title><style>{PREVIEW_STYLE}</style></head><body>"),
        F.lit('<img class="cover" src="'), F.col("cover_uri"), F.lit('" alt="Capa"/>\n<h1>'), title, F.lit("</h1>\n<p><em>"), author, F.lit("</em></p>\n"),
        F.coalesce(F.array_join(F.transform("chapters", part), ""), F.lit("")), F.lit("</body></html>"),
    )
    return meta.join(pages, "doc_id", "left").join(own, "doc_id", "left").select("doc_id", page.alias("html"))


def parse_diagnostics(rows: DataFrame) -> DataFrame:
    """What the parser found, and the counts of each page."""
    counts = F.concat(F.col("k").cast("string"), F.lit(" lines"))
    stage, zero = F.lit("parse").alias("stage"), F.lit(0).alias("event_seq")
    found = rows.where("kind = 'diagnostic'").select("doc_id", stage, F.coalesce("page_num", F.lit(0)).alias("page_num"), zero, F.lit("warning").alias("level"), F.col("text").alias("message"))
    return found.unionByName(rows.where("kind = 'page'").select("doc_id", stage, "page_num", zero, F.lit("info").alias("level"), counts.alias("message")))


def diagnostics(marked: DataFrame, candidates: DataFrame) -> DataFrame:
    """What a reader should review: each heading found, covers that are too small or not sharp."""
    headings = marked.where("is_heading").select("doc_id", F.lit("chapters").alias("stage"), "page_num", "event_seq", F.lit("info").alias("level"), F.concat(F.lit("heading: "), "text").alias("message"))
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    text = F.when(~F.col("fits"), F.concat(F.lit("too small for a cover: "), size)).otherwise(F.concat(F.lit("cover below the sharp size: "), size))
    covers = candidates.where("not fits or not sharp").select("doc_id", F.lit("cover").alias("stage"), "page_num", F.lit(0).alias("event_seq"), F.lit("warning").alias("level"), text.alias("message"))
    return headings.unionByName(covers)


def newest(log: DataFrame, most: int = 500) -> DataFrame:
    """The last ``most`` rows of each stage, newest first (a view of the log, as its name says)."""
    order = Window.partitionBy("stage").orderBy(F.desc("doc_id"), F.desc("page_num"), F.desc("event_seq"))
    return log.withColumn("age", F.row_number().over(order)).where(F.col("age") <= most)
