"""TIFF media columns: a writer, and a reader that gives one row per page.

The reader walks the chain of image directories of either byte order and decodes strips and tiles that are stored plain
or compressed by PackBits, LZW or deflate, undoes horizontal differencing, and gives each page's samples: 1, 2, 4, 8 or 16
bits, chunky or in planes. It is written from the public TIFF 6.0 specification. A page that can't be decoded is a row
with ``error``, and the chain goes on; a chain that can't be followed ends in such a row.

Defined results: a null or empty file has no pages; a directory that was walked before ends the chain; a page of more than
``MOST_BYTES`` samples is an error row, so that no claim of a size takes a task's memory; null texts are empty; texts of
any length are stored, in several pages; repeated rows are files each; null ids stay null; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tags, field type sizes and codes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
_FIELD = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_NAMES = {PLAIN: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}

#: Samples of a page, at most.
MOST_BYTES = 1 << 30
#: The query's pages: rows of this many samples, at most so many rows a page and a strip.
ROW = 576
PAGE_ROWS, STRIP_ROWS = 4096, 256
#: Its tiles, for payloads of at least one tile's rows, and its compressions.
TILE, KINDS = (16, 192), (DEFLATE, LZW, PACKBITS)


_RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    """Runs of 3 to 128 equal bytes as two, all else as literals of at most 128."""
    out, at = bytearray(), 0

    def literals(upto: int) -> None:
        for k in range(at, upto, 128):
            part = data[k : min(k + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUNS.finditer(data):
        literals(run.start())
        out += bytes((257 - (run.end() - run.start()), data[run.start()]))
        at = run.end()
    literals(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        else:
            if head > 128:
                out += data[i + 1 : i + 2] * (257 - head)
            i += 1 if head == 128 else 2
    return bytes(out[:size])


#: Bits of the codes after a clear: 9 to 12, widened one code early. Later ones have 12.
_WIDTHS = np.array([min(12, (258 + k).bit_length()) for k in range(1 << 12)])


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: high bits first; 256 clears, 257 ends."""
    codes, runs, start = [256], [_WIDTHS[:1]], 1  # runs: widths, from clear to clear
    table: dict[int, int] = {}  # of a code and the byte after it: code << 8 | byte
    following, have = 258, -1
    for byte in data:
        if have < 0:
            have = byte
            continue
        longer = have << 8 | byte
        if longer in table:
            have = table[longer]
            continue
        codes.append(have)
        table[longer] = following
        following += 1
        if following == 4094:
            codes.append(256)
            runs.append(_WIDTHS[: len(codes) - start])
            start, following = len(codes), 258
            table.clear()
        have = byte
    codes += [have, 257] if have >= 0 else [257]
    runs.append(_WIDTHS[: len(codes) - start])
    wide, bit = np.concatenate(runs)[:, None], np.arange(12)
    bits = np.array(codes)[:, None] >> np.maximum(wide - 1 - bit, 0) & 1
    return np.packbits(bits[bit < wide].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """The first ``size`` bytes. Codes are taken apart in blocks, as their widths depend on how many follow a clear only."""
    raw = np.frombuffer(data + bytes(2), np.uint8).astype(np.uint32)
    words, total = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:], 8 * len(data)
    out, table, before = bytearray(), [bytes((k,)) for k in range(256)] + [b"", b""], b""
    at = since = 0
    while len(out) < size:
        widths = _WIDTHS[np.minimum(np.arange(since, since + min(4096, (total - at) // 9 + 1)), 4095)]
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, total, "right"))
        if not n:
            raise ValueError("LZW codes end early")
        widths, starts = widths[:n], (ends - widths)[:n]
        codes = words[starts >> 3] >> (24 - widths - (starts & 7)) & (1 << widths) - 1
        marks = np.flatnonzero(codes >> 1 == 128)
        n = int(marks[0]) if len(marks) else n
        parts = []
        for code in codes[:n].tolist():
            if before:
                entry = table[code] if code < len(table) else before + before[:1]
                table.append(before + entry[:1])
            else:
                entry = table[code]
            parts.append(entry)
            before = entry
        out += b"".join(parts)
        if not len(marks):
            at, since = int(ends[n - 1]), since + n
        elif codes[n] == 257:
            break
        else:
            at, since, before = int(ends[n]), 0, b""
            del table[258:]
    return bytes(out[:size])


def _packed(block: np.ndarray, compression: int, predictor: int) -> bytes:
    """The stored form of rows (or a tile) of samples; block: rows x width x samples."""
    if predictor == 2:
        block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
    raw = block.tobytes()
    if compression == LZW:
        return lzw_encode(raw)
    if compression == PACKBITS:
        return b"".join(packbits_encode(r.tobytes()) for r in block)
    return zlib.compress(raw, 1) if compression in (DEFLATE, OLD_DEFLATE) else raw


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of 8-bit pages (rows x width, or rows x width x samples), in strips or in tiles of (height, width)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        height, width, samples = page.shape
        if tile:
            th, tw = tile
            parts = []
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    block = np.zeros((th, tw, samples), np.uint8)
                    cut = page[y : y + th, x : x + tw]
                    block[: cut.shape[0], : cut.shape[1]] = cut
                    parts.append(_packed(block, compression, predictor))
        else:
            parts = [_packed(page[y : y + rows_per_strip], compression, predictor) for y in range(0, height, rows_per_strip)]
        offsets = []
        for p in parts:
            offsets.append(len(out))
            out += p
        counts = [len(p) for p in parts]
        fields = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]),
            (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]),
        ]
        if tile:
            fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, kind, values in sorted(fields):
            size, code = _FIELD[kind]
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, at = struct.pack(order + "I", len(out)), raw
                out += at
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def read_pages(file: bytes, most: int = MOST_BYTES) -> Iterator[tuple[dict[int, list[int]], np.ndarray | str]]:
    """The fields and the samples (rows x width x samples) of each page; a text in their place says why there are none."""
    order = {b"II": "<", b"MM": ">"}.get(file[:2])
    if order is None or struct.unpack_from(order + "H", file, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, walked = struct.unpack_from(order + "I", file, 4)[0], set()
    while at and at not in walked:
        walked.add(at)
        (n,) = struct.unpack_from(order + "H", file, at)
        (after,) = struct.unpack_from(order + "I", file, at + 2 + 12 * n)
        fields: dict[int, list[int]] = {}
        try:
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", file, at + 2 + 12 * k)
                if kind in _FIELD:
                    size, code = _FIELD[kind]
                    where = at + 2 + 12 * k + 8
                    if size * count > 4:
                        (where,) = struct.unpack_from(order + "I", file, where)
                    if where + size * count > len(file):
                        raise ValueError("a field beyond the file")
                    fields[tag] = list(struct.unpack_from(f"{order}{count}{code}", file, where))
            page = _samples(file, fields, order, most)
        except _DAMAGE as e:
            page = f"{type(e).__name__}: {e}"[:200]
        yield fields, page
        at = after


_DAMAGE = (ValueError, KeyError, IndexError, MemoryError, OverflowError, struct.error, zlib.error)


def _samples(file: bytes, fields: dict[int, list[int]], order: str, most: int) -> np.ndarray:
    one = lambda tag, default: fields.get(tag, [default])[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    compression, predictor, bits = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(BITS, 1)
    if any(b != bits for b in fields.get(BITS, [1])) or bits not in (1, 2, 4, 8, 16) or compression not in _NAMES or predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise ValueError("unsupported samples or compression")
    planes, deep = (samples, 1) if one(PLANAR, 1) == 2 else (1, samples)
    if width * height * samples * (bits // 16 + 1) > most:
        raise ValueError("the page is too large")
    if TILE_OFFSETS in fields:
        th, tw = one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)
        offsets, counts = fields[TILE_OFFSETS], fields[TILE_COUNTS]
    else:
        th, tw = min(one(ROWS_PER_STRIP, height), height), width
        offsets, counts = fields[STRIP_OFFSETS], fields[STRIP_COUNTS]
    if min(width, height, samples, th, tw) < 1 or th * tw * deep * 2 > most:
        raise ValueError("no size, or too large a strip or tile")
    across, down = -(-width // tw), -(-height // th)
    if len(offsets) != planes * across * down or len(counts) != len(offsets):
        raise ValueError("strips or tiles are missing")
    kind = np.dtype(order + "u2") if bits == 16 else np.dtype(np.uint8)
    page = None
    for k, (start, count) in enumerate(zip(offsets, counts)):
        plane, y, x = k // (across * down), k // across % down * th, k % across * tw
        rows = th if TILE_OFFSETS in fields else min(th, height - y)
        line = -(-tw * deep * bits // 8)
        size, raw = rows * line, file[start : start + count]
        if compression in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompressobj().decompress(raw, size)
        elif compression == LZW:
            raw = lzw_decode(raw, size)
        elif compression == PACKBITS:
            raw = packbits_decode(raw, size)
        if len(raw) < size:
            raise ValueError("a strip or tile is too short")
        if bits < 8:
            packed = np.unpackbits(np.frombuffer(raw, np.uint8, size).reshape(rows, line), axis=1)[:, : tw * deep * bits].reshape(rows, -1, bits)
            block = (packed << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
        else:
            block = np.frombuffer(raw, kind, rows * tw * deep)
        block = block.reshape(rows, tw, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        if page is None:  # only once a strip holds what it claims
            page = np.zeros((height, width, samples), kind.newbyteorder("="))
        part = slice(plane, plane + 1) if planes > 1 else slice(None)
        page[y : y + rows, x : x + tw, part] = block[: height - y, : width - x]
    return page


_PAGE_DDL = "file_id long, page int, width int, height int, samples int, compression string, predictor int, bytes binary, error string"
_PAGE = pa.schema(
    [("file_id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()),
     ("compression", pa.string()), ("predictor", pa.int32()), ("bytes", pa.binary()), ("error", pa.string())]
)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch for each page, so that one page's samples are held at once."""
    for batch in batches:
        for key, file in zip(batch.column(0).to_pylist(), batch.column(1)):
            count, file = 0, file.as_py()
            row = lambda *x: pa.RecordBatch.from_pylist([dict(zip(_PAGE.names, (key, count, *x)))], _PAGE)  # noqa: B023, E731
            try:
                for fields, page in read_pages(file) if file else ():
                    if isinstance(page, str):
                        yield row(*[None] * 6, page)
                    else:
                        kind = _NAMES[fields.get(COMPRESSION, [PLAIN])[0]]
                        raw = page.astype(page.dtype.newbyteorder("<"), copy=False).tobytes()
                        yield row(page.shape[1], page.shape[0], page.shape[2], kind, fields.get(PREDICTOR, [1])[0], raw, None)
                    count += 1
            except _DAMAGE as e:
                yield row(*[None] * 6, f"{type(e).__name__}: {e}"[:200])


def tiff_pages(files: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """One row per page of the files in ``bytes_col``: its size, kind and samples (a byte each; of 16 bits two, low first)."""
    return files.select(F.col(id_col).cast("long"), F.col(bytes_col)).mapInArrow(_pages, _PAGE_DDL)


def payload_of(text: bytes) -> np.ndarray:
    """The text's bytes and then bytes 255 up to a positive multiple of ROW, as rows."""
    size = max(1, -(-len(text) // ROW)) * ROW
    return np.frombuffer(text.ljust(size, b"\xff"), np.uint8).reshape(-1, ROW)


def text_tiff(text: bytes) -> bytes:
    """A grey file of the text's payload; long ones take several pages.

    The crc32 of the text chooses how it is stored, so that equal texts are equal files, and a corpus has all kinds:
    deflate, LZW or PackBits, strips or (of texts that fill one) tiles, differenced or not, of either byte order.
    """
    rows, way = payload_of(text), zlib.crc32(text)
    pages = [rows[k : k + PAGE_ROWS] for k in range(0, len(rows), PAGE_ROWS)]
    tile = TILE if len(rows) >= TILE[0] and way // 3 % 2 else None
    return write_tiff(pages, KINDS[way % 3], 1 + way // 6 % 2, STRIP_ROWS, tile, "<>"[way // 12 % 2])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages", "compression", "tiled"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = (text.as_py() or "").encode()
            file = text_tiff(text)
            whole, count, tail, total, size, high, fields = hashlib.sha256(), 0, b"", 0, 0, 0, {}
            for fields, page in read_pages(file):
                raw = page.tobytes()
                whole.update(raw)
                tail = (tail + raw)[-32:]
                count, size, total = count + 1, size + len(raw), total + int(page.sum(dtype=np.int64))
                high += int((page >= 128).sum())
            feature = f"pages={count};rows={size // ROW};mean={total / size:.6f};high={high / size:.6f}"
            rows.append((key, len(text), size, whole.hexdigest(), zlib.crc32(tail), len(file), hashlib.sha256(file).hexdigest(), feature, count, _NAMES[fields[COMPRESSION][0]], TILE_OFFSETS in fields))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(names), kinds)], names)


def text_media(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: digests of its text stored as TIFF and read back (null text: empty)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int, compression string, tiled boolean"
    )
