"""Sinks: EPUB archives, as rows (path, content), and files in a folder of any store that pyarrow can open.

Files are written by a data source with a commit: all of a job appear, or none.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Parts of an EPUB container.
CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
MODIFIED = "2000-01-01T00:00:00Z"
_META, _LINK = '<meta charset="utf-8"/></head>', '<meta charset="utf-8"/><link rel="stylesheet" type="text/css" href="stylesheet.css"/></head>'

#: How each class of the chapters' markup is set.
STYLESHEET = """\
body { padding: 0 4%; line-height: 1.45; hyphens: auto; }
h1 { font-size: 160%; page-break-before: always; margin-bottom: 1.2em; }
h2 { font-size: 125%; margin-top: 1.5em; page-break-after: avoid; }
p { margin: 0 0 0.2em; text-indent: 1.2em; }
h1 + p, h2 + p { text-indent: 0; }
p.legenda { font-size: 90%; font-style: italic; text-indent: 0; text-align: center; }
p.direita { text-indent: 0; text-align: right; }
img { width: auto; max-width: 100%; page-break-inside: avoid; }
"""


def quoted(text: str) -> str:
    """Text for an attribute."""
    return escape(text, {'"': "&quot;"})


def build_epub(
    title: str | None, author: str | None, lang: str, chapters: list[tuple[str, str | None, str]], images: list[tuple[str, str, bytes]], cover: tuple[str, str, bytes, str] | None, key: str = ""
) -> bytes:
    """An EPUB 3 of chapters (href, title, xhtml), images (filename, mime, bytes) and a cover (filename, mime, bytes, xhtml).

    ``key`` tells books of one title and author apart: the identifier is made of all three.
    """
    title, author = title or "", (author or "").strip()
    items, spine, files = [], [], {}

    def item(id_: str, href: str, mime: str, properties: str = "") -> None:
        items.append(f'<item id="{id_}" href="{quoted(href)}" media-type="{quoted(mime)}"{f" properties={chr(34)}{properties}{chr(34)}" if properties else ""}/>')

    if cover:
        name, mime, data, page = cover
        item("cover-image", name, mime, "cover-image")
        item("cover", "cover.xhtml", "application/xhtml+xml", "svg")
        spine.append("cover")
        files |= {name: data, "cover.xhtml": page.encode()}
    item("nav", "nav.xhtml", "application/xhtml+xml", "nav")
    item("css", "stylesheet.css", "text/css")
    spine.append("nav")
    for k, (name, mime, data) in enumerate(images):
        item(f"i{k}", f"images/{name}", mime)
        files[f"images/{name}"] = data
    for k, (href, _, xhtml) in enumerate(chapters):
        item(f"c{k}", href, "application/xhtml+xml")
        spine.append(f"c{k}")
        files[href] = xhtml.replace(_META, _LINK, 1).encode()
    links = "".join(f'<li><a href="{quoted(href)}">{escape(name or href)}</a></li>' for href, name, _ in chapters) or '<li><a href="nav.xhtml">–</a></li>'
    files["nav.xhtml"] = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">'
        f'<head><title>{escape(title)}</title>{_LINK.removesuffix("</head>")}</head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>'
    ).encode()
    files["stylesheet.css"] = STYLESHEET.encode()
    creator = f"<dc:creator>{escape(author)}</dc:creator>" if author else ""
    files["content.opf"] = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((key, title, author)))}</dc:identifier><dc:title>{escape(title) or "–"}</dc:title>{creator}'
        f'<dc:language>{escape(lang)}</dc:language><meta property="dcterms:modified">{MODIFIED}</meta></metadata>'
        f"<manifest>{''.join(items)}</manifest><spine>{''.join(f'<itemref idref={chr(34)}{x}{chr(34)}/>' for x in spine)}</spine></package>"
    ).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr(zipfile.ZipInfo("META-INF/container.xml"), CONTAINER, zipfile.ZIP_DEFLATED)
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(f"OEBPS/{name}"), files[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def epub_files(meta: DataFrame, chapters: DataFrame, resources: DataFrame, covers: DataFrame, lang: str = "pt") -> DataFrame:
    """doc_id, path, content. meta: doc_id, name, title, author (and lang); chapters: doc_id, out_ord, href, title, xhtml;

    resources: doc_id, image_idx, filename, mime, bytes; covers: doc_id, filename, mime, bytes, xhtml, one a document.
    Documents without meta have no file. A book meets its images in one task, where it must fit; tables that are in equal
    buckets by doc_id are not exchanged.
    """
    own = F.coalesce("lang", F.lit(lang)) if "lang" in meta.columns else F.lit(lang)
    parts = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("out_ord", "href", "title", "xhtml"))).alias("chapters"))
    cover = covers.where("bytes is not null").select("doc_id", F.struct("filename", "mime", "bytes", "xhtml").alias("cover"))
    books = meta.select("doc_id", "name", "title", "author", own.alias("lang")).join(parts, "doc_id", "left").join(cover, "doc_id", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("content", pa.binary())])

    def book(head: pa.Table, images: pa.Table) -> pa.Table:
        if not len(head):
            return schema.empty_table()
        r = head.slice(0, 1).to_pylist()[0]
        chapter = [(c["href"], c["title"], c["xhtml"]) for c in r["chapters"] or ()]
        image = [(i["filename"], i["mime"], i["bytes"]) for i in images.sort_by("image_idx").to_pylist()]
        data = build_epub(r["title"], r["author"], r["lang"], chapter, image, r["cover"] and tuple(r["cover"].values()), f"{r['doc_id']}/{r['name']}")
        return pa.table([[r["doc_id"]], [r["name"]], [data]], schema=schema)

    images = resources.select("doc_id", "image_idx", "filename", "mime", "bytes")
    return books.groupBy("doc_id").cogroup(images.groupBy("doc_id")).applyInArrow(book, "doc_id long, path string, content binary")


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: the folder of its own."""

    folder: str


class FileWriter(DataSourceArrowWriter):
    """Stages each task's files in a folder of its own, all of them in one hidden folder of the job.

    The commit moves the files of the tasks that count to their names, and takes all back if one can't be moved; then, as
    after a failure, the hidden folder goes with whatever else is in it: files of tasks that failed or ran twice.
    """

    def __init__(self, folder: str):
        self.folder, self.stage = folder.rstrip("/"), f".quire-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, base = store_of(self.folder)
        own = f"{base}/{self.stage}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                if not path or "/" in path or path in (".", ".."):
                    raise ValueError(f"not a file name: {path!r}")
                if store.get_file_info(f"{own}/{path}").type != fs.FileType.NotFound:
                    raise ValueError(f"two files are named {path!r}")
                with store.open_output_stream(f"{own}/{path}") as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
        return Staged(own)

    def commit(self, messages: list[Staged | None]) -> None:
        store, base = store_of(self.folder)
        found = [f for m in messages if m for f in store.get_file_info(fs.FileSelector(m.folder))]
        names = Counter(f.base_name for f in found)
        if twice := next((n for n, k in names.items() if k > 1), None):
            raise ValueError(f"two files are named {twice!r}")
        saved = f"{base}/{self.stage}/replaced"
        store.create_dir(saved, recursive=True)
        done: list[str] = []

        def publish(file: fs.FileInfo) -> None:
            target = f"{base}/{file.base_name}"
            there = store.get_file_info(target).type
            if there == fs.FileType.Directory:
                raise ValueError(f"{target} is a folder")
            if there == fs.FileType.File:
                store.move(target, f"{saved}/{file.base_name}")
            done.append(file.base_name)
            store.move(file.path, target)

        try:
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(publish, found))
        except Exception:
            for name in done:
                for path, to in ((f"{base}/{name}", None), (f"{saved}/{name}", f"{base}/{name}")):
                    if store.get_file_info(path).type == fs.FileType.File:
                        store.move(path, to) if to else store.delete_file(path)
            raise
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        store, base = store_of(self.folder)
        if store.get_file_info(f"{base}/{self.stage}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.stage}")


class Files(DataSource):
    """Rows (path, content) as files of the folder that is saved to."""

    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are added to a folder, or replaced one by one; it is never overwritten")
        return FileWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """Write path (a file name) and content of each row into ``folder``, a path or URI that every executor sees.

    All files appear, or none: see ``FileWriter``. A file of the same name that is there is replaced, all others are left
    alone; two rows of one name are an error; null content is an empty file. The driver moves files, one rename each, as
    Spark's own file formats do when they commit.
    """
    spark = files.sparkSession
    spark.dataSource.register(Files)
    files.select("path", F.col("content").cast("binary").alias("content")).write.format("quire_files").mode("append").save(folder)
