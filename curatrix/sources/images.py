"""Decoding of 8-bit grey pictures (PNG without interlace, binary PGM), pixel hashes and perceptual bits.

There is no image library here; other formats are left undecoded (null), or decoded by one if it can be imported.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    from PIL import Image
except ImportError:
    Image = None


def png_pixels(data: bytes) -> np.ndarray | None:
    """Pixels of a non-interlaced 8-bit grey PNG, any filter."""
    parts, header, at = [], None, 8
    while at + 12 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        if name == b"IDAT":
            parts.append(body)
    if header is None or header[2:4] != (8, 0) or header[6]:
        return None
    width, height = header[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if raw.size != height * (width + 1):
        return None
    rows = raw.reshape(height, width + 1)
    if not rows[:, 0].any():
        return rows[:, 1:].copy()
    out = np.zeros((height, width), np.uint8)
    above = np.zeros(width, np.int64)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            left = corner = 0
            for x in range(width):
                up = int(above[x])
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[x] = left = (int(line[x]) + guess) & 255
                corner = up
        above = line & 255
        out[y] = above
    return out


def pgm_pixels(data: bytes) -> np.ndarray | None:
    """Pixels of a binary PGM of one byte a pixel; comments in the header are skipped."""
    fields, at = [], 2
    while len(fields) < 3 and at < len(data):
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
        elif data[at : at + 1].isspace():
            at += 1
        else:
            stop = at
            while data[stop : stop + 1].isdigit():
                stop += 1
            if stop == at:
                return None
            fields.append(int(data[at:stop]))
            at = stop
    if len(fields) < 3 or fields[2] > 255:
        return None
    body = np.frombuffer(data[at + 1 : at + 1 + fields[0] * fields[1]], np.uint8)
    return body.reshape(fields[1], fields[0]) if body.size == fields[0] * fields[1] and body.size else None


def pixels(data: bytes | None) -> np.ndarray | None:
    if not data:
        return None
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and (found := png_pixels(data)) is not None:
            return found
        if data[:2] == b"P5" and (found := pgm_pixels(data)) is not None:
            return found
        if Image is not None:
            return np.asarray(Image.open(io.BytesIO(data)).convert("L"))
    except (ValueError, IndexError, zlib.error, struct.error, OSError):
        return None
    return None


def encode_png(grey: np.ndarray) -> bytes:
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    height, width = grey.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), grey.astype(np.uint8)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def shrink(grey: np.ndarray, longest: int) -> np.ndarray:
    """Scaled down to a longest side by nearest neighbour; never enlarged."""
    height, width = grey.shape
    scale = min(1.0, longest / max(height, width))
    h, w = max(1, round(height * scale)), max(1, round(width * scale))
    return grey[(np.arange(h) * height // h)[:, None], (np.arange(w) * width // w)[None, :]]


def perceptual_bits(grey: np.ndarray, side: int = 32, low: int = 8) -> int:
    """64 bits: whether each of the 8 x 8 lowest cosine coefficients of the picture, scaled to 32 x 32, exceeds their
    median; the first coefficient is the highest bit. Signed."""
    height, width = grey.shape
    small = grey[(np.arange(side) * height // side)[:, None], (np.arange(side) * width // side)[None, :]].astype(float)
    n = np.arange(side)
    basis = np.cos(np.pi * (2 * n[None, :] + 1) * np.arange(low)[:, None] / (2 * side))
    c = np.round(basis @ small @ basis.T, 6).ravel()
    bits = 0
    for b in c > np.median(c):
        bits = bits << 1 | int(b)
    return bits - (1 << 64) if bits >> 63 else bits


@F.pandas_udf(T.BinaryType())
def bytes_or_file(data: pd.Series, path: pd.Series) -> pd.Series:
    """A picture's bytes, else the content of the file its path names on a mounted folder; null if it cannot be read."""

    def load(b, p):
        if b:
            return b
        try:
            with open(p.removeprefix("file://"), "rb") as f:
                return f.read() or None
        except (OSError, AttributeError, ValueError):
            return None

    return pd.Series([load(b, p) for b, p in zip(data, path)], dtype=object)


@F.pandas_udf(T.StringType())
def pixel_md5(data: pd.Series) -> pd.Series:
    """MD5 of a picture's size and pixels; null if it cannot be decoded."""

    def one(x):
        p = pixels(bytes(x)) if x is not None else None
        return None if p is None else hashlib.md5(f"{p.shape[1]}x{p.shape[0]}:".encode() + p.tobytes()).hexdigest()

    return data.map(one)


@F.pandas_udf(T.LongType())
def phash(data: pd.Series) -> pd.Series:
    """Perceptual bits of a picture; null if it cannot be decoded."""

    def one(x):
        p = pixels(bytes(x)) if x is not None else None
        return None if p is None else perceptual_bits(p)

    return pd.Series([one(x) for x in data], dtype="Int64")


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def picture_size(data: pd.Series) -> pd.DataFrame:
    found = [pixels(bytes(x)) if x is not None else None for x in data]
    return pd.DataFrame({"width": pd.array([None if p is None else p.shape[1] for p in found], "Int32"), "height": pd.array([None if p is None else p.shape[0] for p in found], "Int32")})


def resized_png(longest: int = 384):
    """Arrow function: a picture as PNG, scaled down to a longest side; null if it cannot be decoded."""

    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series) -> pd.Series:
        def one(x):
            p = pixels(bytes(x)) if x is not None else None
            return None if p is None else encode_png(shrink(p, longest))

        return data.map(one)

    return run
