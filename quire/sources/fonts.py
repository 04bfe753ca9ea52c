"""Fonts of PDF content: codes of shown strings to text and advances (in ems)."""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Callable, Sequence

# Widths of characters 32 to 126 in thousandths of an em, of the standard fonts that a file need not describe.
_SANS = (
    "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778"
    " 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
)
_SERIF = (
    "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722"
    " 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"
)
STANDARD = {"Helvetica": _SANS, "Arial": _SANS, "Times": _SERIF, "TimesNewRoman": _SERIF, "Courier": " ".join(["600"] * 95), "CourierNew": " ".join(["600"] * 95)}
# Names of glyphs that are neither letters nor letters with a mark, and of marks.
_NAMES = dict(
    zip(
        "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at"
        " bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde exclamdown cent sterling currency yen brokenbar section dieresis copyright ordfeminine guillemotleft logicalnot registered macron"
        " degree plusminus acute mu paragraph periodcentered cedilla ordmasculine guillemotright onequarter onehalf threequarters questiondown AE Eth multiply Oslash Thorn germandbls ae eth divide oslash thorn dotlessi OE oe Lslash lslash"
        " florin circumflex tilde endash emdash quoteleft quoteright quotesinglbase quotedblleft quotedblright quotedblbase dagger daggerdbl bullet ellipsis perthousand guilsinglleft guilsinglright Euro trademark fi fl minus nbspace".split(),
        " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~¡¢£¤¥¦§¨©ª«¬®¯°±´µ¶·¸º»¼½¾¿ÆÐ×ØÞßæð÷øþıŒœŁłƒˆ˜–—‘’‚“”„†‡•…‰‹›€™ﬁﬂ−\xa0",
        strict=True,
    )
)
_MARKS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}


def named_glyph(name: str) -> str:
    """The text of a glyph by its name; '' if the name says nothing."""
    name = name.split(".")[0]
    if name in _NAMES:
        return _NAMES[name]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", name):
        return bytes.fromhex(m[1]).decode("utf-16-be", "replace")
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", name):
        code = int(m[1], 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
    if name[1:] in _MARKS:
        return unicodedata.normalize("NFC", name[0] + _MARKS[name[1:]])
    return ""


def _default(code: int, table: str) -> str:
    return bytes((code,)).decode(table, "replace")


class Font:
    """What a font says of its codes: their bytes, text and advances.

    ``get`` resolves references, ``content`` gives a stream's data, ``values`` reads the values of a CMap.
    """

    def __init__(self, info: dict, get: Callable, content: Callable, values: Callable):
        number = lambda x: float(x) if isinstance(x := get(x), (int, float)) and not isinstance(x, bool) else 0.0
        self.wide = get(info.get("Subtype")) == "Type0"
        self.map: dict[int, str] = {}
        self.ranges: list[tuple[int, int, bytes]] = []
        self.spaces: list[tuple[int, int, int]] = []
        encoding = get(info.get("Encoding"))
        if hasattr(encoding, "raw"):
            self._cmap(values(content(encoding)), spaces_only=True)
        self.utf16 = self.wide and isinstance(encoding, str) and ("UCS2" in encoding or "UTF16" in encoding)
        if hasattr(stream := get(info.get("ToUnicode")), "raw"):
            self._cmap(values(content(stream)))
        widths: dict[int, float] = {}
        self.width = 0.0
        if self.wide:
            kids = get(info.get("DescendantFonts"))
            inner = get(kids[0]) if isinstance(kids, list) and kids else None
            if isinstance(inner, dict):
                self.width = number(inner["DW"]) / 1000 if "DW" in inner else 1.0
                widths = self._wide_widths([get(x) for x in get(inner.get("W")) or []], get, number)
        else:
            first, own = int(number(info.get("FirstChar"))), get(info.get("Widths"))
            described = get(info.get("FontDescriptor"))
            if isinstance(described, dict):
                self.width = number(described.get("MissingWidth")) / 1000
            if isinstance(own, list):
                widths = {first + k: number(w) / 1000 for k, w in enumerate(own)}
            else:
                base = re.split(r"[-,]", str(get(info.get("BaseFont")) or "").split("+")[-1])[0].removesuffix("PSMT").removesuffix("MT")
                if base in STANDARD:
                    widths = {32 + k: int(w) / 1000 for k, w in enumerate(STANDARD[base].split())}
        self.widths = widths
        if self.wide:
            self.pairs = all(n == 2 for n, _, _ in self.spaces)
            #: Codes that are the text in UTF-16, and of one width.
            self.plain = self.pairs and not self.map and self.ranges[:1] == [(0, 65535, b"\0\0")]
            self.even = self.pairs and not widths
            self.map, self.widths = _Known(self.map, self._text), _Known(widths, lambda _: self.width)
        else:
            self._simple(encoding, get)

    def _simple(self, encoding, get: Callable) -> None:
        base = get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        table = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        text = {c: _default(c, table) for c in range(256)}
        if isinstance(encoding, dict):
            code = 0
            for x in get(encoding.get("Differences")) or []:
                x = get(x)
                if isinstance(x, str):
                    if found := named_glyph(x):
                        text[code & 255] = found
                    code += 1
                elif isinstance(x, (int, float)):
                    code = int(x)
        self.map = text | {c: t for c, t in self.map.items() if c < 256}
        for low, high, raw in self.ranges:
            self.map |= {c: _next(raw, c - low) for c in range(low, min(high, 255) + 1)}
        self.text = [self.map[c] for c in range(256)]
        self.advance = [self.widths.get(c, self.width) for c in range(256)]

    @staticmethod
    def _wide_widths(items: list, get: Callable, number: Callable) -> dict[int, float]:
        out, k = {}, 0
        while k + 1 < len(items):
            first = int(number(items[k]))
            if isinstance(items[k + 1], list):
                out |= {first + j: number(w) / 1000 for j, w in enumerate(items[k + 1])}
                k += 2
            elif k + 2 < len(items):
                out |= dict.fromkeys(range(first, min(int(number(items[k + 1])), 65535) + 1), number(items[k + 2]) / 1000)
                k += 3
            else:
                break
        return out

    def _cmap(self, values, spaces_only: bool = False) -> None:
        stack: list = []
        code = lambda x: int.from_bytes(x[1], "big")
        for x in values:
            if not isinstance(x, bytes):
                stack.append(x)
                continue
            held = [v for v in stack if isinstance(v, (tuple, list))]
            if x == b"endcodespacerange":
                self.spaces += [(len(a[1]), code(a), code(b)) for a, b in zip(held[::2], held[1::2])]
            elif x == b"endbfchar" and not spaces_only:
                self.map |= {code(a): b[1].decode("utf-16-be", "surrogatepass") for a, b in zip(held[::2], held[1::2])}
            elif x == b"endbfrange" and not spaces_only:
                for a, b, to in zip(held[::3], held[1::3], held[2::3]):
                    if isinstance(to, list):
                        self.map |= {code(a) + j: t[1].decode("utf-16-be", "surrogatepass") for j, t in enumerate(to) if code(a) + j <= code(b)}
                    else:
                        self.ranges.append((code(a), code(b), to[1]))
            stack = []

    def _codes(self, shown: bytes) -> tuple[Sequence[int], list[bool]]:
        """Codes of a wide font, two bytes each or what its code spaces say, and which are a space of one byte."""
        if self.pairs:
            return struct.unpack(f">{len(shown) // 2}H", shown[: len(shown) // 2 * 2]), []
        codes, blanks, at = [], [], 0
        while at < len(shown):
            for n in range(1, 5):
                value = int.from_bytes(shown[at : at + n], "big")
                if at + n <= len(shown) and any(m == n and low <= value <= high for m, low, high in self.spaces):
                    break
            else:
                n, value = 1, shown[at]
            codes.append(value)
            blanks.append(value == 32 and n == 1)
            at += n
        return codes, blanks

    def shown(self, data: bytes) -> tuple[str, list[float], list[bool]]:
        """The text of a shown string; the advance of each code, and whether it is a space that word spacing widens (or none)."""
        if not self.wide:
            return "".join(map(self.text.__getitem__, data)), list(map(self.advance.__getitem__, data)), [c == 32 for c in data] if 32 in data else []
        if self.plain and self.even:
            n = len(data) // 2
            return data[: 2 * n].decode("utf-16-be", "replace"), [self.width] * n, []
        codes, blanks = self._codes(data)
        text = "".join(map(self.map.__getitem__, codes))
        if not text.isascii():  # halves of a pair may come from two codes
            text = text.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")
        return text, list(map(self.widths.__getitem__, codes)), blanks

    def _text(self, code: int) -> str:
        for low, high, raw in self.ranges:
            if low <= code <= high:
                return _next(raw, code - low)
        return chr(code) if self.utf16 else ""


class _Known(dict):
    """A dictionary that asks for what it doesn't hold, once."""

    def __init__(self, held: dict, ask: Callable):
        super().__init__(held)
        self.ask = ask

    def __missing__(self, key):
        self[key] = found = self.ask(key)
        return found


def _next(raw: bytes, step: int) -> str:
    """The text ``step`` places after ``raw`` (UTF-16BE)."""
    return (raw[:-2] + ((int.from_bytes(raw[-2:], "big") + step) & 65535).to_bytes(2, "big")).decode("utf-16-be", "surrogatepass")
