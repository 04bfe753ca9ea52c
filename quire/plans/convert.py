"""From PDF files to EPUB files, preview pages, diagnostics and a summary: the whole way, for any number of files at once.

Files are parsed once, into a table; everything else is a plan over it. Every document is converted, whatever fails in it:
what can't be read is missing from its book and a row of its diagnostics.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import text as T
from ..functions.wrap import drawn_cover
from ..operators import covers as C
from ..operators import layout as L
from ..scratch import Scratch
from ..sources import pdf, raster, sinks


def read_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (a hash of the path), path and content of the PDF files in a folder, or of one file; no patterns."""
    folder = re.sub(r"([{}\[\]*?\\])", r"\\\1", folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), "content")


def document_metadata(files: DataFrame, rows: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """doc_id, path, title, author, lang and name of the EPUB: what ``overrides`` say, else the file, else its name.

    ``overrides`` has doc_id, title, author and lang; null or blank ones say nothing. Names that several files would have
    get the doc_id before them.
    """
    meta = rows.where("kind = 'meta'").select("doc_id", F.col("text").alias("title"), "author")
    out = files.select("doc_id", "path").join(meta, "doc_id", "left")
    if overrides is not None:
        own = overrides.select("doc_id", *[F.nullif(T.utrim(F.col(c)), F.lit("")).alias(f"own_{c}") for c in ("title", "author", "lang")])
        out = out.join(own, "doc_id", "left")
    else:
        out = out.withColumns({f"own_{c}": F.lit(None).cast("string") for c in ("title", "author", "lang")})
    # Counted before they are joined, so that a name that most files have is no task of its own.
    common = files.groupBy(T.epub_name(F.col("path")).alias("common")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    out = out.withColumn("plain", T.epub_name(F.col("path"))).join(common, F.col("plain") == F.col("common"), "left")
    out = out.withColumn("name", F.when(F.col("common").isNull(), F.col("plain")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("plain"))))
    return out.select("doc_id", "path", F.coalesce("own_title", "title", T.file_title(F.col("path"))).alias("title"), F.coalesce("own_author", "author", F.lit("")).alias("author"), F.col("own_lang").alias("lang"), "name")


def usable_covers(files: DataFrame) -> DataFrame:
    """Of cover files (doc_id, bytes) the JPEG and PNG ones: doc_id, mime, width, height, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [raster.image_size(b or b"") or (None, None, None) for b in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))), batch.column(1)]
            yield pa.record_batch(columns, ["doc_id", "mime", "width", "height", "bytes"])

    sized = files.select(F.col("doc_id").cast("long"), F.col("bytes").cast("binary"))
    return sized.mapInArrow(run, "doc_id long, mime string, width int, height int, bytes binary").where("mime is not null")


@F.arrow_udf(BinaryType())
def drawn(title: pa.Array, author: pa.Array) -> pa.Array:
    """The cover that is drawn for a title and an author; null for a null title."""
    return pa.array([None if t is None else drawn_cover(t, a or "").encode() for t, a in zip(title.to_pylist(), author.to_pylist())], pa.binary())


@dataclass
class Conversion:
    """metadata; chapters (doc_id, out_ord, href, title, body, xhtml); epubs and previews (doc_id, path, content);
    diagnostics; summary (doc_id, path, title, author, pages, images, chapters, epub, error); totals (unread files, pages, images,
    chapters: over all files). ``close`` deletes the tables that these read."""

    metadata: DataFrame
    chapters: DataFrame
    epubs: DataFrame
    previews: DataFrame
    diagnostics: DataFrame
    summary: DataFrame
    totals: dict[str, int]
    scratch: Scratch

    def close(self) -> None:
        self.scratch.close()


#: What a file that can't be read leaves.
UNREAD = "kind = 'diagnostic' and page_num is null and text like 'not loaded%'"


def convert(files: DataFrame, overrides: DataFrame | None = None, cover_files: DataFrame | None = None, lang: str = "pt") -> Conversion:
    """``files``: doc_id, path, content; ``cover_files`` (doc_id, bytes): covers to use instead of a file's own.

    What comes in is dealt out by doc_id once, before it is parsed; all tables between are in buckets of it, so that no later
    join or group by doc_id exchanges anything. Only metadata are sent once more, after names have been counted. The totals
    are observed on writes, whose tasks each count once however often they run; no table is read for them.
    """
    scratch = Scratch(files.sparkSession, "convert")
    parsed, made = Observation("parsed"), Observation("made")
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("page", "image")]
    dealt = files.select("doc_id", "content").repartition(scratch.buckets(), "doc_id")
    rows = scratch.cut_by(pdf.parse_pdfs(dealt).observe(parsed, *kinds, F.count_if(F.expr(UNREAD)).alias("unread")), "rows", "doc_id")
    paths = scratch.deal(files.select(F.col("doc_id").cast("long"), "path"), "paths", "doc_id")
    own = overrides and scratch.deal(overrides.select(F.col("doc_id").cast("long"), "title", "author", "lang"), "overrides", "doc_id")
    metadata = scratch.deal(document_metadata(paths, rows, own), "metadata", "doc_id")
    docs = rows.where("kind = 'meta'").select("doc_id")
    assets = pdf.parsed_assets(rows)
    given = scratch.deal(usable_covers(cover_files), "given", "doc_id") if cover_files is not None else None

    known = scratch.cut_by(C.with_cover(L.profile_of(pdf.parsed_profile(rows)), given), "profile", "doc_id")
    flow = known.withColumn("consumed_image", F.col("cover.consumed_image")).drop("shown", "opening", "cover").join(L.ordered(pdf.parsed_events(rows)), "doc_id", "left")
    marked = L.chapter_events(L.with_names(flow))
    written = L.written_chapters(L.chapter_pieces(L.classified(marked))).observe(made, F.count(F.lit(1)).alias("chapters"))
    written = scratch.cut_by(written, "chapters", "doc_id")
    chapters = L.chapter_documents(written)

    chosen = known.select("doc_id", "cover.*")
    # The difference keeps image_idx from being a key of the join, which then would be exchanged by both.
    shown_first = F.col("image_idx") - F.col("consumed_image") == 0
    found = assets.select("doc_id", "image_idx", F.col("bytes").alias("own")).join(chosen.select("doc_id", "consumed_image"), "doc_id").where(shown_first).select("doc_id", "own")
    covers = chosen.join(found, "doc_id", "left").join(metadata.select("doc_id", "title", "author"), "doc_id")
    covers = covers.join(given.select("doc_id", F.col("bytes").alias("file")), "doc_id", "left") if given is not None else covers.withColumn("file", F.lit(None).cast("binary"))
    covers = covers.withColumn("drawn", drawn(F.when(F.col("source") == "drawn", F.coalesce("title", F.lit(""))), F.col("author")))
    data = F.when(F.col("source") == "given", F.col("file")).when(F.col("source") == "detected", F.col("own")).otherwise(F.col("drawn"))
    covers = covers.select("doc_id", "filename", "mime", data.alias("bytes"), T.cover_xhtml(F.col("filename"), F.col("width"), F.col("height")).alias("xhtml"))
    covers = scratch.cut_by(covers, "covers", "doc_id")

    loaded = metadata.join(docs, "doc_id", "left_semi").hint("merge")
    epubs = sinks.epub_files(loaded, chapters, C.resources(assets, chosen), covers, lang)
    uris = covers.select("doc_id", T.data_uri(F.col("mime"), F.col("bytes")).alias("cover_uri"))
    html = C.preview_pages(written, loaded.select("doc_id", "title", "author").join(uris, "doc_id"), C.image_uris(assets))
    previews = html.join(loaded.select("doc_id", F.concat(F.regexp_replace("name", r"\.epub$", ""), F.lit(".preview.html")).alias("path")), "doc_id").select("doc_id", "path", F.col("html").alias("content"))
    diagnostics = C.diagnostics(marked, C.cover_candidates(known)).unionByName(C.parse_diagnostics(rows))
    if cover_files is not None:
        refused = cover_files.select("doc_id").join(given, "doc_id", "left_anti")
        diagnostics = diagnostics.unionByName(refused.select("doc_id", F.lit("cover").alias("stage"), F.lit(0).alias("page_num"), F.lit(0).alias("event_seq"), F.lit("warning").alias("level"), F.lit("the given cover is no JPEG or PNG").alias("message")))

    counts = rows.groupBy("doc_id").agg(*kinds, F.max(F.when(F.expr(UNREAD), F.col("text"))).alias("error"))
    summary = metadata.join(counts, "doc_id", "left").join(written.groupBy("doc_id").agg(F.count("*").alias("chapters")), "doc_id", "left")
    summary = summary.select("doc_id", "path", "title", "author", "pages", "images", F.coalesce("chapters", F.lit(0).cast("long")).alias("chapters"), F.when(F.col("error").isNull(), F.col("name")).alias("epub"), "error")
    totals = {k: o.get.get(k) or 0 for o, names in ((parsed, ("pages", "images", "unread")), (made, ("chapters",))) for k in names}
    return Conversion(metadata, chapters, epubs, previews, diagnostics, summary, totals, scratch)


#: Folder of the summary and the diagnostics in a target, and the file that tells it from a user's own.
REPORT, MARK = "quire-report", "made-by-quire"


def report_folder(target: str) -> str:
    """The folder of the report in ``target``, made where it isn't there; a folder that isn't ours is refused."""
    store, base = sinks.store_of(f"{target.rstrip('/')}/{REPORT}")
    if store.get_file_info(base).type != fs.FileType.NotFound and store.get_file_info(f"{base}/{MARK}").type != fs.FileType.File:
        raise ValueError(f"{target}/{REPORT} is there already, and isn't a report of this engine")
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{MARK}") as f:
        f.write(b"Rewritten by each conversion.\n")
    return f"{target.rstrip('/')}/{REPORT}"


def convert_folder(spark: SparkSession, source: str, target: str, cover: bytes | None = None, overrides: DataFrame | None = None, lang: str = "pt") -> DataFrame:
    """Convert the PDF files of ``source`` into EPUB and preview files in ``target``; returns the summary.

    Books appear all or none (``sinks.write_files``). The summary and the diagnostics are JSON in ``REPORT`` there, and so
    are the totals.
    """
    report = report_folder(target)
    files = read_pdfs(spark, source)
    covers = files.select("doc_id").withColumn("bytes", F.lit(bytearray(cover))) if cover is not None else None
    done = convert(files, overrides, covers, lang)
    made = done.epubs.select("path", "content").unionByName(done.previews.select("path", F.col("content").cast("binary").alias("content")))
    sinks.write_files(made, target)
    done.diagnostics.write.mode("overwrite").json(f"{report}/diagnostics")
    done.summary.write.mode("overwrite").json(f"{report}/summary")
    store, base = sinks.store_of(f"{report}/totals.json")
    with store.open_output_stream(base) as f:
        f.write(json.dumps(done.totals).encode())
    done.close()
    return spark.read.schema(done.summary.schema).json(f"{report}/summary")
