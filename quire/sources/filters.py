"""Stream filters of PDF: LZW, ASCII85, ASCII hexadecimal and run lengths, after the public specification."""

from __future__ import annotations

import re

_BLANK = re.compile(rb"[\x00\t\n\x0c\r ]+")


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    """Groups of five digits of base 85 up to '~>'; 'z' is four zeros; a last short group gives one byte less than it has."""
    data = _BLANK.sub(b"", data.split(b"~>")[0].removeprefix(b"<~"))
    out, group = bytearray(), []
    for c in data:
        if c == 122 and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (_number(group) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        out += (_number(group + [84] * (5 - len(group))) & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def _number(digits: list[int]) -> int:
    value = 0
    for x in digits:
        value = value * 85 + x
    return value


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (head := data[at]) != 128:
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        else:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends; ``early`` widens codes one code sooner."""
    out, table = bytearray(), [bytes((k,)) for k in range(256)] + [b"", b""]
    width, held, bits, last = 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("a code that LZW doesn't have yet")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        if len(table) + early >= 1 << width and width < 12:
            width += 1
    return bytes(out)
