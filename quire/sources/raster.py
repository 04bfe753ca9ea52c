"""Raster images of PDF streams: samples to RGB or grey, and lossless PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Components of colour spaces.
COMPONENTS = {"DeviceGray": 1, "CalGray": 1, "DeviceRGB": 3, "CalRGB": 3, "DeviceCMYK": 4}


def cmyk_to_rgb(raw: bytes) -> bytes:
    """Single precision, truncated; an incomplete last pixel is left out."""
    inks = np.frombuffer(raw, np.uint8, len(raw) // 4 * 4).reshape(-1, 4).astype(np.float32) / np.float32(255)
    left = np.float32(1) - inks
    return (np.float32(255) * left[:, :3] * left[:, 3:]).astype(np.uint8).tobytes()


def unpack_bits(raw: bytes, width: int, height: int, bits: int = 1) -> np.ndarray:
    """The first bit of each sample; rows begin at whole bytes, missing ones are 0."""
    row = (width * bits + 7) // 8
    data = np.frombuffer(raw[: row * height].ljust(row * height, b"\0"), np.uint8).reshape(height, row)
    return np.unpackbits(data, axis=1)[:, : width * bits : bits]


def indexed_to_rgb(raw: bytes, count: int, palette: bytes, base: str) -> bytes:
    """Colours of at most ``count`` samples; components beyond the palette's end are 0."""
    n = COMPONENTS.get(base)
    if n is None:
        raise ValueError(f"unsupported base of an indexed colour space: {base}")
    table = np.frombuffer(palette[: 256 * n].ljust(256 * n, b"\0"), np.uint8).reshape(256, n)
    colours = table[np.frombuffer(raw[:count], np.uint8)]
    if n == 4:
        return cmyk_to_rgb(colours.tobytes())
    return (np.repeat(colours, 3, axis=1) if n == 1 else colours).tobytes()


def decode_raster(raw: bytes, width: int, height: int, bits: int, space: str, palette: bytes = b"", base: str = "") -> tuple[str, bytes]:
    """("gray" or "rgb", samples); ValueError for what is not supported."""
    if not width or not height:
        raise ValueError("no size")
    if space == "Indexed" and bits == 8:
        kind, out = "rgb", indexed_to_rgb(raw, width * height, palette, base)
    elif space in ("DeviceGray", "CalGray") and bits == 8:
        kind, out = "gray", raw
    elif space in ("DeviceGray", "CalGray") and bits == 1:
        kind, out = "gray", (unpack_bits(raw, width, height) * np.uint8(255)).tobytes()
    elif space in ("DeviceRGB", "CalRGB") and bits == 8:
        kind, out = "rgb", raw
    elif space == "DeviceCMYK" and bits == 8:
        kind, out = "rgb", cmyk_to_rgb(raw)
    else:
        raise ValueError(f"unsupported: {space} with {bits} bits")
    size = width * height * (3 if kind == "rgb" else 1)
    if len(out) < size:
        raise ValueError(f"too few samples for {kind}")
    return kind, out[:size]


def encode_png(kind: str, samples: bytes, width: int, height: int) -> bytes:
    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    row = width * (3 if kind == "rgb" else 1)
    lines = b"".join(b"\0" + samples[k : k + row] for k in range(0, row * height, row))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if kind == "rgb" else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """(mime, width, height) of a JPEG or PNG file; None for others."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "image/png", *struct.unpack(">II", data[16:24])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if data[at + 1] == 0xFF:  # fill
                at += 1
                continue
            (size,) = struct.unpack(">H", data[at + 2 : at + 4])
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return "image/jpeg", width, height
            at += 2 + size
    return None
