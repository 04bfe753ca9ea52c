"""Column functions on text, markup and file names; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line patterns that open a chapter, default names, and the markup of each kind of block.
CHAPTER_PATTERN = r"(?iU)^\s*(cap[ií]tulo|chapter|parte|part)\s+\d+"
DEFAULT_TITLE, DEFAULT_NAME, FIRST_CHAPTER = "Documento", "livro", "Introdução"
BLOCK_TAGS = {"heading": ("<h2>", "</h2>"), "paragraph": ("<p>", "</p>"), "caption": ('<p class="legenda">', "</p>"), "right": ('<p class="direita">', "</p>")}


def utrim(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_words(c: Column) -> Column:
    return c.rlike(r"[\p{IsAlphabetic}\p{N}]")


def is_chapter_line(c: Column) -> Column:
    return c.rlike(CHAPTER_PATTERN)


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def tagged(c: Column, opening: str, closing: str) -> Column:
    return F.concat(F.lit(opening), escape_html(c), F.lit(closing + "\n"))


def image_tag(source: Column) -> Column:
    return F.concat(F.lit('<img src="'), source, F.lit('" alt=""/>\n'))


def image_path(filename: Column) -> Column:
    """Where a chapter finds an image of its book."""
    return F.concat(F.lit("images/"), filename)


def block_html(kind: Column, text: Column, filename: Column) -> Column:
    """Markup of a block; null for an image without a file."""
    out = F.when(kind == "image", image_tag(image_path(filename)))
    for name, (opening, closing) in BLOCK_TAGS.items():
        out = out.when(kind == name, tagged(text, opening, closing))
    return out


#: The markup of documents is fixed: a reader of either output finds the same.
def xhtml_document(title: Column, body: Column) -> Column:
    title = escape_html(title)
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">\n<head><title>'),
        title, F.lit('</title><meta charset="utf-8"/></head>\n<body>\n<h1>'), title, F.lit("</h1>\n"), body, F.lit("\n</body>\n</html>\n"),
    )


def cover_xhtml(filename: Column, width: Column, height: Column) -> Column:
    w, h = width.cast("string"), height.cast("string")
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">\n<head><title>Capa</title><meta charset="utf-8"/>\n<style>body{margin:0;padding:0;}</style></head>\n<body epub:type="cover">\n<div style="text-align:center;page-break-after:always;">\n<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" version="1.1" width="100%" height="100%" viewBox="0 0 '),
        w, F.lit(" "), h, F.lit('" preserveAspectRatio="xMidYMid meet">\n  <image width="'), w, F.lit('" height="'), h, F.lit('" xlink:href="'),
        escape_html(filename), F.lit('"/>\n</svg>\n</div>\n</body>\n</html>\n'),
    )


def data_uri(mime: Column, data: Column) -> Column:
    """Base64 without the line breaks that the session may ask for."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), "[\r\n]", ""))


def file_stem(path: Column) -> Column:
    """The last part of a path without its last extension; null if there is none."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name != "..", F.nullif(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"), F.lit("")))


def file_title(path: Column) -> Column:
    return F.coalesce(file_stem(path), F.lit(DEFAULT_TITLE))


def epub_name(path: Column) -> Column:
    return F.concat(F.coalesce(file_stem(path), F.lit(DEFAULT_NAME)), F.lit(".epub"))
