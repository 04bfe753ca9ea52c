"""Python steps over Arrow batches: what they hold and give at a time is small, however large a batch is."""

import hashlib

import pyarrow as pa
import pytest

from quire.plans import registry as R
from quire.sources import pdf, raster
from quire.sources.fonts import Font

TEXT = "".join(chr(97 + k % 26) for k in range(40000))
KEYS = pa.array(range(200), pa.int64())


def batch(*columns):
    return pa.record_batch([KEYS, *columns], [f"c{k}" for k in range(1 + len(columns))])


def pieces(step, *columns):
    """What a step gives for a batch of 8 MB: many small batches, with all rows in order."""
    found = list(step(iter([batch(*columns)])))
    assert len(found) > 5 and max(b.num_rows for b in found) < 50
    assert [x for b in found for x in b.column(0).to_pylist()] == KEYS.to_pylist()
    return [row for b in found for row in b.to_pylist()]


def test_titles_of_long_first_lines():
    text = pa.array([TEXT] * 200)
    rows = pieces(R._titled_pdf, pa.array(["/in/a.pdf"] * 200), text, pa.array([2] * 200, pa.int32()), pa.array(["s"] * 200))
    assert next(pdf.parse_document(0, rows[0]["content"], metadata_only=True)) == {"kind": ["meta"], "text": [TEXT], "author": ["s"]}


@pytest.mark.parametrize("base", ["DeviceGray", "DeviceRGB", "DeviceCMYK"])
def test_palettes_of_long_texts(base):
    rows = pieces(R._palettes, pa.array([TEXT] * 200), pa.array([base] * 200))
    assert {hashlib.md5(r["rgb"]).digest() for r in rows} == {hashlib.md5(raster.indexed_to_rgb(TEXT.encode(), 1 << 30, bytes(range(200)), base)).digest()}


def test_bits_of_long_lines():
    rows = pieces(R._bits, pa.array(range(200), pa.int32()), pa.array([TEXT] * 200))
    raw, width = "".join(f"{b:08b}" for b in TEXT.encode()), 3 + len(TEXT) % 9
    for r in rows[:4]:
        depth = 1 << r["i"] % 4
        size = -(-width * depth // 8) * 8
        assert r["bits"] == "".join(raw[at + x * depth] if at + x * depth < len(raw) else "0" for at in range(0, len(raw), size) for x in range(width))


def font(ranges: bytes) -> Font:
    info = {"Subtype": "Type0", "Encoding": "Identity-H", "ToUnicode": pdf.Stream({}, ranges), "DescendantFonts": [{"DW": 500}]}
    return Font(info, lambda x: x, lambda s: s.raw, pdf._values)


def test_codes_that_are_utf16_are_not_looked_up():
    space = b"1 begincodespacerange <0000> <ffff> endcodespacerange "
    plain = font(space + b"1 beginbfrange <0000> <ffff> <0000> endbfrange")
    looked = font(space + b"2 beginbfrange <0000> <0fff> <0000> <1000> <ffff> <1000> endbfrange")
    for text in ("", "plain", "á€漢", "\U0001f600 and \ud800 alone"):
        data = text.encode("utf-16-be", "surrogatepass")
        for shown in (data, data + b"\0"):
            assert plain.shown(shown) == looked.shown(shown)
    assert not plain.map and looked.map
