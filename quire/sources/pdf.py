"""PDF source: files to pages, lines of text, drawn images, image assets, metadata and diagnostics.

Written from the public PDF specification. Objects are found by scanning for them, so that damaged cross-references do
no harm; object streams are opened, streams are decoded with their predictors. ``parse_pdfs`` runs one document at a time
in ``mapInArrow``: what fails in a document gives a diagnostic row, never a failed job. Encrypted files are refused.

Text is closed into lines where it is read, string by string: a line can only break where a shown string begins, so no
glyph becomes a row. Page trees and forms may be of any depth; what refers to itself is cut there, with a diagnostic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import utrim
from ..operators.glyphs import JUMP, STEP, image_y
from .filters import ascii85, ascii_hex, lzw, run_length
from .fonts import Font
from .raster import decode_raster, encode_png


class Name(str):
    """A PDF name, apart from strings (which are bytes)."""


@dataclass(frozen=True)
class Ref:
    obj: int
    gen: int


@dataclass
class Stream:
    info: dict
    raw: bytes


_SPACE = b"\x00\t\n\x0c\r "
_TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\x00\t\n\x0c\r ]*)*(<<|>>|\[|\]|\(|<|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+|[{}>)])")
_REF = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_NUMERIC, _WORDS = frozenset(b"+-.0123456789"), {b"true": True, b"false": False, b"null": None}
_STREAM, _ENDSTREAM = re.compile(rb"[\x00\t\n\x0c\r ]*stream\r?\n?"), re.compile(rb"[\x00\t\n\x0c\r ]*endstream")
_NOT_HEX = re.compile(rb"[^0-9A-Fa-f]")
_ESCAPES = {110: b"\n", 114: b"\r", 116: b"\t", 98: b"\b", 102: b"\f"}


class Reader:
    """Values of PDF syntax, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def value(self):
        """The next value; operators are bytes; EOFError at the end."""
        m = _TOKEN.match(self.data, self.at)
        if not m:
            raise EOFError
        token, self.at = m[1], m.end()
        if token[0] in _NUMERIC and _NUMBER.match(token):
            if token.isdigit() and (r := _REF.match(self.data, self.at)):
                self.at = r.end()
                return Ref(int(token), int(r[1]))
            return float(token) if b"." in token else int(token)
        if token == b"<<":
            out = {}
            while (key := self.value()) != b">>":
                out[key] = self.value()
            return out
        if token == b"[":
            items = []
            while (item := self.value()) != b"]":
                items.append(item)
            return items
        if token == b"(":
            return ("s", self._string())
        if token == b"<":
            end = self.data.find(b">", self.at)
            end = len(self.data) if end < 0 else end
            digits = self.data[self.at : end]
            if not digits.isalnum():
                digits = _NOT_HEX.sub(b"", digits)
            self.at = end + 1
            return ("s", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        if token[:1] == b"/":
            if b"#" in token:
                token = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), token)
            return Name(token[1:].decode("latin-1"))
        return _WORDS.get(token, token)

    def _string(self) -> bytes:
        out, depth, data, n = bytearray(), 1, self.data, len(self.data)
        while self.at < n:
            c = data[self.at]
            self.at += 1
            if c == 92 and self.at < n:
                e = data[self.at]
                self.at += 1
                if e in _ESCAPES:
                    out += _ESCAPES[e]
                elif 48 <= e <= 55:
                    m = re.compile(rb"[0-7]{1,3}").match(data, self.at - 1)
                    self.at = m.end()
                    out.append(int(m[0], 8) & 255)
                elif e == 13:
                    self.at += data[self.at : self.at + 1] == b"\n"
                elif e != 10:
                    out.append(e)
                continue
            depth += (c == 40) - (c == 41)
            if not depth:
                break
            out.append(c)
        return bytes(out)


def unpredicted(data: bytes, predictor: int, colors: int, bits: int, columns: int) -> bytes:
    """Undo a PNG or TIFF predictor."""
    size, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if predictor == 2 and bits == 8:
        rows = np.frombuffer(data[: len(data) // row * row], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    if predictor < 10:
        return data
    out, before = bytearray(), bytes(row)
    for k in range(0, len(data), row + 1):
        kind, line = data[k], bytearray(data[k + 1 : k + 1 + row].ljust(row, b"\0"))
        for i in range(row):
            a, b = (line[i - size] if i >= size else 0), before[i]
            c = before[i - size] if i >= size else 0
            if kind == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                near = (0, a, b, (a + b) // 2)[kind] if kind < 4 else 0
            line[i] = (line[i] + near) & 255
        before = bytes(line)
        out += before
    return bytes(out)


class Document:
    """Objects of a file by number; the last of a number counts."""

    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise ValueError("no PDF header")
        self.data, self.objects, self.trailer = data, {}, {}
        self.places = {(int(m[1])): (m.end(), int(m[2])) for m in re.finditer(rb"(?<![0-9])(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj(?![a-z])", data)}
        for m in re.finditer(rb"(?<![a-z])trailer", data):
            found = Reader(data, m.end()).value()
            if isinstance(found, dict):
                self.trailer |= found
        for number in list(self.places):
            found = self.get(Ref(number, 0))
            if isinstance(found, Stream) and found.info.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in found.info.items() if k in ("Root", "Info", "Encrypt")}
            elif isinstance(found, Stream) and found.info.get("Type") == "ObjStm":
                body = self.content(found)
                head, first = Reader(body), int(self.get(found.info.get("First", 0)))
                pairs = [(head.value(), head.value()) for _ in range(int(self.get(found.info.get("N", 0))))]
                for obj, offset in pairs:
                    if obj not in self.places:
                        self.objects[obj] = Reader(body, first + offset).value()
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")
        if "Root" not in self.trailer:
            raise ValueError("no catalog")

    def get(self, x, depth: int = 0):
        """What a reference stands for."""
        while isinstance(x, Ref) and depth < 32:
            if x.obj not in self.objects:
                if x.obj not in self.places:
                    return None
                self.objects[x.obj] = self._read(self.places[x.obj][0])
            x, depth = self.objects[x.obj], depth + 1
        return x

    def _read(self, at: int):
        reader = Reader(self.data, at)
        try:
            found = reader.value()
        except EOFError:
            return None
        m = _STREAM.match(self.data, reader.at)
        if not m or not isinstance(found, dict):
            return found
        size = found.get("Length")
        size = self.get(size) if not isinstance(size, Ref) or size.obj in self.places else None
        end = m.end() + size if isinstance(size, int) else -1
        if end < 0 or not _ENDSTREAM.match(self.data, end):
            end = self.data.find(b"endstream", m.end())
            end = len(self.data) if end < 0 else end
            if self.data[end - 1 : end] in (b"\n", b"\r"):
                end -= 1
        return Stream(found, self.data[m.end() : end])

    def filters(self, stream: Stream) -> list[str]:
        found = self.get(stream.info.get("Filter"))
        return [str(self.get(x)) for x in found] if isinstance(found, list) else [str(found)] if found else []

    def content(self, stream: Stream) -> bytes:
        """The stream without its filters; ValueError for those of images that are no samples."""
        data, parms = stream.raw, self.get(stream.info.get("DecodeParms"))
        for k, kind in enumerate(self.filters(stream)):
            own = self.get(parms[k]) if isinstance(parms, list) and k < len(parms) else parms if isinstance(parms, dict) else None
            one = lambda key, default: int(self.get(own.get(key, default))) if own else default  # noqa: B023, E731
            if kind in ("FlateDecode", "Fl"):
                data = zlib.decompressobj().decompress(data)
            elif kind in ("LZWDecode", "LZW"):
                data = lzw(data, one("EarlyChange", 1))
            elif kind in ("ASCIIHexDecode", "AHx"):
                data = ascii_hex(data)
            elif kind in ("ASCII85Decode", "A85"):
                data = ascii85(data)
            elif kind in ("RunLengthDecode", "RL"):
                data = run_length(data)
            else:
                raise ValueError(f"unsupported filter: {kind}")
            if own and kind in ("FlateDecode", "Fl", "LZWDecode", "LZW"):
                data = unpredicted(data, one("Predictor", 1), one("Colors", 1), one("BitsPerComponent", 8), one("Columns", 1))
        return data

    def pages(self) -> tuple[list[dict], list[str]]:
        """Pages in order, and what was cut."""
        out, cut, walked = [], [], set()
        left = [(self.get(self.trailer["Root"]) or {}).get("Pages")]
        while left:
            ref = left.pop()
            if isinstance(ref, Ref):
                if ref in walked:
                    cut.append(f"object {ref.obj} stands in the page tree again")
                    continue
                walked.add(ref)
            node = self.get(ref)
            if isinstance(node, dict):
                if isinstance(kids := self.get(node.get("Kids")), list):
                    left += reversed(kids)
                else:
                    out.append(node)
        return out, cut

    def inherited(self, page: dict, key: str, kind: type):
        """The nearest value of a type on the way up from a page."""
        node, walked = page, set()
        while isinstance(node, dict):
            if isinstance(found := self.get(node.get(key)), kind):
                return found
            up = node.get("Parent")
            if not isinstance(up, Ref) or up in walked:
                return None
            walked.add(up)
            node = self.get(up)
        return None

    def metadata(self) -> tuple[bytes | None, bytes | None]:
        """The raw title and author; only direct strings count."""
        info = self.get(self.trailer.get("Info"))
        one = lambda k: info[k][1] if isinstance(info, dict) and isinstance(info.get(k), tuple) else None
        return one("Title"), one("Author")


# What is white space at the ends of a text (the Unicode property of that name).
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def pdf_text(raw: bytes) -> str:
    """A PDF text string: UTF-16BE after its mark (an odd last byte is left out, lone surrogates are U+FFFD), else Latin-1."""
    if raw[:2] == b"\xfe\xff":
        return raw[2 : len(raw) // 2 * 2].decode("utf-16-be", "replace")
    return raw.decode("latin-1")


def metadata_text(raw: bytes | None) -> str | None:
    """Without white space at its ends; null if nothing is left."""
    return (pdf_text(raw).strip(_WHITE) or None) if raw is not None else None


def number(x) -> float:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else 0.0


def times(m: tuple, n: tuple) -> tuple:
    """The matrix that applies m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


@dataclass
class Page:
    number: int
    width: float = 0.0
    height: float = 0.0
    lines: list[tuple[float, float, float, str]] = field(default_factory=list)  # y, font size, x as a share of the width, text
    images: list[tuple[float, float, int]] = field(default_factory=list)  # the last two numbers d and f of the matrix, image number
    failed: list[str] = field(default_factory=list)


class _Lines:
    """Shown strings to lines of a page."""

    def __init__(self, page: Page):
        self.page, self.parts = page, []
        self.y = self.font = 0.0
        self.x = float("inf")
        self.end: tuple[float, float] | None = None  # right end and y of the last glyph

    def show(self, text: str, x: float, least: float, last: float, y: float, last_y: float, font: float) -> None:
        """A string whose first glyph is at x, y; ``least`` is the smallest x of its glyphs, ``last`` its right end."""
        if self.end is not None:
            down = abs(y - self.end[1])
            if down > JUMP * font or (x < self.end[0] and down > STEP * font):
                self.close()
        if not self.parts:
            self.y = y
        self.parts.append(text)
        self.font, self.x, self.end = max(self.font, font), min(self.x, least), (last, last_y)

    def close(self) -> None:
        if text := "".join(self.parts).strip(_WHITE):
            share = self.x / (self.page.width if self.page.width > 0 else 1.0)
            self.page.lines.append((self.y, self.font if self.font > 0 else 1.0, min(max(share, 0.0), 1.0), text))
        self.parts, self.font, self.x = [], 0.0, float("inf")


def walk_page(doc: Document, node: dict, page: Page, indices: dict[Ref, int], fonts: dict) -> None:
    """Lines and drawn images of a page, in the order of its content. Text that fails ends the text, not the images."""
    box = doc.inherited(node, "MediaBox", list)
    if box is None or len(box) < 4:
        raise ValueError("no media box")
    x0, y0, x1, y1 = (number(doc.get(v)) for v in box[:4])
    page.width, page.height = x1 - x0, y1 - y0
    content = doc.get(node.get("Contents"))
    streams = [doc.get(c) for c in content] if isinstance(content, list) else [content]
    data = b"\n".join(doc.content(s) for s in streams if isinstance(s, Stream))
    lines = _Lines(page)

    def font_of(ref, info: dict) -> Font:
        key = ref if isinstance(ref, Ref) else ("direct", id(info))
        if key not in fonts:
            fonts[key] = (Font(info, doc.get, doc.content, _values), info)  # with info, so that its id stays its own
        return fonts[key][0]

    def run(data: bytes, resources: dict, ctm: tuple, forms: tuple) -> None:
        saved, stack = [], []
        state = _Text(ctm)
        reader = Reader(data)
        text_ends = False
        while True:
            try:
                x = reader.value()
            except EOFError:
                return
            if not isinstance(x, bytes):
                stack.append(x)
                continue
            args, stack = stack, []
            if x == b"q":
                saved.append(ctm)
            elif x == b"Q":
                ctm = saved.pop() if saved else ctm
            elif x == b"cm" and len(args) == 6:
                ctm = times(tuple(map(number, args)), ctm)
            elif x == b"Do" and args:
                ref = (doc.get(resources.get("XObject")) or {}).get(args[0])
                if ref in indices:
                    if not forms:
                        page.images.append((ctm[3], ctm[5], indices[ref]))
                elif isinstance(form := doc.get(ref), Stream) and form.info.get("Subtype") == "Form":
                    if ref in forms:
                        page.failed.append(f"form {getattr(ref, 'obj', '')} draws itself")
                        continue
                    matrix = doc.get(form.info.get("Matrix"))
                    matrix = tuple(number(doc.get(v)) for v in matrix) if isinstance(matrix, list) and len(matrix) == 6 else _UNIT
                    try:
                        run(doc.content(form), doc.get(form.info.get("Resources")) or resources, times(matrix, ctm), (*forms, ref))
                    except (ValueError, TypeError, RecursionError, zlib.error) as e:
                        page.failed.append(f"form {getattr(ref, 'obj', '')}: {e}")
            elif x == b"BI":
                end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(data, reader.at)
                reader.at = end.end() if end else len(data)
            elif not text_ends:
                try:
                    if x == b"Tf" and len(args) == 2:
                        named = (doc.get(resources.get("Font")) or {}).get(args[0])
                        state.size = number(args[1])
                        if isinstance(info := doc.get(named), dict):
                            state.font = font_of(named, info)
                    else:
                        state.ctm = ctm
                        state.operator(x, args, lines, page.height)
                except Exception as e:  # noqa: BLE001
                    page.failed.append(f"text: {e}")
                    text_ends = True

    try:
        run(data, doc.inherited(node, "Resources", dict) or {}, _UNIT, ())
    finally:
        lines.close()


def _values(data: bytes) -> Iterator:
    reader = Reader(data)
    while True:
        try:
            yield reader.value()
        except EOFError:
            return


class _Text:
    """The text state of a content stream."""

    def __init__(self, ctm: tuple):
        self.ctm, self.tm, self.line, self.font = ctm, _UNIT, _UNIT, None
        self.size = self.spacing = self.word_spacing = self.leading = self.rise = 0.0
        self.scale = 1.0

    def operator(self, x: bytes, args: list, lines: _Lines, height: float) -> None:
        if x == b"Tj" and args and isinstance(args[-1], tuple):
            self._show(args[-1][1], lines, height)
        elif x == b"TJ" and args and isinstance(args[-1], list):
            for part in args[-1]:
                if isinstance(part, tuple):
                    self._show(part[1], lines, height)
                else:
                    self._advance(-number(part) / 1000 * self.size * self.scale)
        elif x == b"BT":
            self.tm = self.line = _UNIT
        elif x == b"Tm" and len(args) == 6:
            self.tm = self.line = tuple(map(number, args))
        elif x in (b"Td", b"TD") and len(args) == 2:
            self.leading = -number(args[1]) if x == b"TD" else self.leading
            self._move(number(args[0]), number(args[1]))
        elif x == b"T*":
            self._move(0.0, -self.leading)
        elif x == b"'" and args and isinstance(args[-1], tuple):
            self._move(0.0, -self.leading)
            self._show(args[-1][1], lines, height)
        elif x == b'"' and len(args) == 3 and isinstance(args[2], tuple):
            self.word_spacing, self.spacing = number(args[0]), number(args[1])
            self._move(0.0, -self.leading)
            self._show(args[2][1], lines, height)
        elif x in _SETTINGS and args:
            setattr(self, _SETTINGS[x], number(args[0]) / (100 if x == b"Tz" else 1))

    def _move(self, x: float, y: float) -> None:
        self.tm = self.line = times((1.0, 0.0, 0.0, 1.0, x, y), self.line)

    def _advance(self, x: float) -> None:
        a, b, c, d, e, f = self.tm
        self.tm = (a, b, c, d, e + x * a, f + x * b)

    def _show(self, shown: bytes, lines: _Lines, height: float) -> None:
        if self.font is None or not shown:
            return
        text, widths, blanks = self.font.shown(shown)
        if not widths:
            return
        a, b, c, d, e, f = times((self.scale, 0.0, 0.0, 1.0, 0.0, self.rise), times(self.tm, self.ctm))
        size = abs((a * self.size + c * self.size) * (b * self.size + d * self.size)) ** 0.5
        # Glyphs of a string stand along one line: x and y change with what was advanced before them.
        m = times(self.tm, self.ctm)
        if widths.count(widths[0]) == len(widths):
            steps = [(widths[0] * self.size + self.spacing) * self.scale] * len(widths)
        else:
            steps = [(w * self.size + self.spacing) * self.scale for w in widths]
        if self.word_spacing and blanks:
            steps = [s + self.word_spacing * self.scale * k for s, k in zip(steps, blanks)]
        before = sum(steps[:-1])
        x, y = e, height - f
        least = x if m[0] >= 0 and min(steps) >= 0 else x + min(m[0] * s for s in accumulate(steps[:-1], initial=0.0))
        lines.show(text, x, least, x + before * m[0] + widths[-1] * size, y, y - before * m[1], size)
        self._advance(before + steps[-1])


_SETTINGS = {b"Tc": "spacing", b"Tw": "word_spacing", b"TL": "leading", b"Ts": "rise", b"Tz": "scale"}


# Filters whose data is no row of samples.
_CODECS = ("JPXDecode", "CCITTFaxDecode", "JBIG2Decode")


def image_error(filters: list[str]) -> str | None:
    """Why an image with these stream filters can't become an asset; None if it may."""
    if "DCTDecode" in filters:
        return "DCTDecode with other filters" if len(filters) > 1 else None
    return "unsupported codec" if any(x in _CODECS for x in filters) else None


def image_filename(obj: int, gen: int, filters: list[str]) -> str:
    return f"img_{obj}_{gen}.{'jpg' if 'DCTDecode' in filters else 'png'}"


def page_assets(doc: Document, node: dict) -> Iterator[tuple[Ref, str, str, int, int, bytes | None, str | None]]:
    """(reference, filename, mime, width, height, bytes, error) of each image in a page's resources."""
    xobjects = doc.get((doc.inherited(node, "Resources", dict) or {}).get("XObject")) or {}
    for ref in xobjects.values():
        image = doc.get(ref)
        if not isinstance(ref, Ref) or not isinstance(image, Stream) or image.info.get("Subtype") != "Image":
            continue
        info, filters = image.info, doc.filters(image)
        name = image_filename(ref.obj, ref.gen, filters)
        width, height = (max(0, int(number(doc.get(info.get(k))))) for k in ("Width", "Height"))
        try:
            if error := image_error(filters):
                raise ValueError(error)
            if "DCTDecode" in filters:
                yield ref, name, "image/jpeg", width, height, image.raw, None
                continue
            space = doc.get(info.get("ColorSpace", Name("DeviceGray")))
            palette, under = b"", ""
            if isinstance(space, list):
                if doc.get(space[0]) == "Indexed":
                    if len(space) < 4:
                        raise ValueError("malformed indexed colour space")
                    below, table = doc.get(space[1]), doc.get(space[3])
                    under = str(doc.get(below[0]) if isinstance(below, list) and below else below)
                    palette = doc.content(table) if isinstance(table, Stream) else table[1] if isinstance(table, tuple) else b""
                space = doc.get(space[0])
            bits = int(number(doc.get(info.get("BitsPerComponent", 8))))
            kind, samples = decode_raster(doc.content(image), width, height, bits, str(space), palette, under)
            yield ref, name, "image/png", width, height, encode_png(kind, samples, width, height), None
        except (ValueError, TypeError, zlib.error) as e:
            yield ref, name, "", width, height, None, str(e)


# One row per thing that a document holds; ``kind`` tells which columns count.
_TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
ROWS_DDL = (
    "doc_id long, kind string, page_num int, k int, y double, width double, height double, font_size double, x_start double, text string, author string, image_idx int, filename string, mime string, bytes binary"
)
ROWS = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in ROWS_DDL.split(", "))])


def parse_document(key: int, data: bytes, metadata_only: bool = False) -> Iterator[dict[str, list]]:
    """Columns of rows, page by page, of kinds

    meta (text: title, author), page (width, height, k: lines), line (k, y, font_size, x_start, text), drawn (k, y: f of the
    matrix, height: d of it, width: the page's height, image_idx), image (image_idx, filename, mime, width, height, bytes)
    and diagnostic (text).
    """

    def diagnostic(text: str, page: int | None = None) -> dict[str, list]:
        return {"kind": ["diagnostic"], "page_num": [page], "text": [text]}

    try:
        doc = Document(data)
        title, author = doc.metadata()
    except Exception as e:  # noqa: BLE001 - any damage is a row, not a failed job
        yield diagnostic(f"not loaded: {e}")
        return
    yield {"kind": ["meta"], "text": [metadata_text(title)], "author": [metadata_text(author)]}
    if metadata_only:
        return
    count, fonts = 0, {}
    pages, cut = doc.pages()
    for text in cut:
        yield diagnostic(text)
    for n, node in enumerate(pages, 1):
        page, indices = Page(n), {}
        try:
            for ref, filename, mime, width, height, body, error in page_assets(doc, node):
                if error:
                    yield diagnostic(f"image {filename}: {error}", n)
                else:
                    indices[ref] = count
                    yield {"kind": ["image"], "page_num": [n], "image_idx": [count], "filename": [filename], "mime": [mime], "width": [float(width)], "height": [float(height)], "bytes": [body]}
                    count += 1
        except Exception as e:  # noqa: BLE001
            yield diagnostic(f"images: {e}", n)
        try:
            walk_page(doc, node, page, indices, fonts)
        except Exception as e:  # noqa: BLE001
            page.failed.append(f"page: {e}")
        for text in page.failed:
            yield diagnostic(text, n)
        yield {"kind": ["page"], "page_num": [n], "width": [page.width], "height": [page.height], "k": [len(page.lines)]}
        if page.lines:
            y, size, x, text = (list(c) for c in zip(*page.lines))
            yield {"kind": ["line"] * len(y), "page_num": [n] * len(y), "k": list(range(len(y))), "y": y, "font_size": size, "x_start": x, "text": text}
        if page.images:
            d, f, index = (list(c) for c in zip(*page.images))
            m = len(d)
            yield {"kind": ["drawn"] * m, "page_num": [n] * m, "k": list(range(m)), "y": f, "height": d, "width": [page.height] * m, "image_idx": index}


def _parsed(metadata_only: bool):
    def batch_of(held: list[tuple[int, dict[str, list]]]) -> pa.RecordBatch:
        sizes = [len(c["kind"]) for _, c in held]
        columns = [pa.array([key for (key, _), n in zip(held, sizes) for _ in range(n)], pa.int64())]
        for name in ROWS.names[1:]:
            columns.append(pa.array([x for (_, c), n in zip(held, sizes) for x in (c.get(name) or [None] * n)], ROWS.field(name).type))
        return pa.record_batch(columns, schema=ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for columns in parse_document(key, data.as_py() or b"", metadata_only):
                    held.append((key, columns))
                    rows, size = rows + len(columns["kind"]), size + len((columns.get("bytes") or [b""])[0] or b"") + sum(len(t or "") for t in columns.get("text", ()))
                    if rows > 5000 or size > 1 << 24:
                        yield batch_of(held)
                        held, rows, size = [], 0, 0
        if held:
            yield batch_of(held)

    return run


def parse_pdfs(files: DataFrame, metadata_only: bool = False) -> DataFrame:
    """Rows of all documents of ``files`` (doc_id, content); write them once, then take the kinds apart."""
    return files.select(F.col("doc_id").cast("long"), F.col("content")).mapInArrow(_parsed(metadata_only), ROWS_DDL)


def parsed_events(rows: DataFrame) -> DataFrame:
    """The lines and the drawn images as events, in one scan; images follow lines of the same y."""
    line = F.col("kind") == "line"
    y = F.when(line, F.col("y")).otherwise(image_y(F.col("width"), F.col("height"), F.col("y")))
    own = [F.when(line, F.col(c)).alias(c) for c in ("text", "font_size", "x_start")]
    found = rows.where("kind in ('line', 'drawn')")
    return found.select("doc_id", "page_num", F.col("k").alias("arrival_seq"), y.alias("y"), F.when(line, 0).otherwise(1).alias("is_image"), *own, F.when(~line, F.col("image_idx")).alias("image_idx"))


def parsed_profile(rows: DataFrame) -> DataFrame:
    """What ``layout.profile_rows`` makes of documents, events, images and pages, in one scan."""
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    place = ("page_num", F.col("k").alias("arrival_seq"))
    y = image_y(F.col("width"), F.col("height"), F.col("y")).alias("y")
    line = F.struct(place[0], "y", place[1], (utrim(F.col("text")) == "").alias("blank"), "font_size", "x_start")
    size = [F.col(c).cast("int").alias(c) for c in ("width", "height")]
    entry = F.struct(F.col("image_idx").alias("key"), F.struct("filename", "mime", *size).alias("value"))
    found = rows.where("kind in ('meta', 'page', 'line', 'drawn', 'image')")
    shown = F.struct(place[0], y, place[1], "image_idx")
    return found.select("doc_id", of("page", F.col("page_num")).alias("page_num"), of("line", line).alias("line"), of("drawn", shown).alias("shown"), of("image", entry).alias("entry"))


def parsed_assets(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'image'").select("doc_id", "image_idx", "filename", "mime", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "bytes")


def write_pdf(pages: list[list[tuple[float, float, float, str]]], title: str = "", author: str = "", width: int = 600, height: int = 800) -> bytes:
    """A plain PDF of text in lines (x, y from the top, size, text) and metadata; any text, as codes of UTF-16."""
    string = lambda t: b"<feff%s>" % t.encode("utf-16-be", "surrogatepass").hex().encode()
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0000> <ffff> <0000> endbfrange"
    bodies = [b"", b"", b"<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 6 0 R >>"]
    bodies.append(b"<< /Title " + string(title) + b" /Author " + string(author) + b" >>")
    bodies.append(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Plain /DW 500 >>")
    bodies.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap))
    kids = []
    for lines in pages:
        shown = b"".join(b"/F1 %g Tf 1 0 0 1 %.9g %.9g Tm <%s> Tj\n" % (s, x, height - y, t.encode("utf-16-be", "surrogatepass").hex().encode()) for x, y, s, t in lines)
        content = zlib.compress(b"BT\n" + shown + b"ET", 1)
        bodies.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(content), content))
        bodies.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % len(bodies))
        kids.append(len(bodies))
    bodies[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    bodies[1] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids), width, height)
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info 4 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start)
    return bytes(out)
