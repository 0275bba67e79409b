"""Images as PNG: palettes and grey with alpha become RGBA, everything else RGB, RGBA stays.

PNG files are decoded and encoded here with numpy; other formats need Pillow, where it is installed.
Bytes that can't be decoded stay as they are.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
LEVEL = 1
#: Pixels of the largest image that is decoded; larger ones stay as they are.
MOST_PIXELS = 1 << 26


def _chunks(raw: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(raw):
        (size,) = struct.unpack_from(">I", raw, at)
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]
        if len(raw) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack_from(">I", raw, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        yield kind, body
        at += 12 + size


def _unfilter(data: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes from filtered ones; ``step`` is the distance to the pixel on the left."""
    rows = np.zeros((height + 1, stride + step), np.uint8)  # a row and a pixel of zeros stand before the first
    for y in range(height):
        kind = data[y * (stride + 1)]
        line = np.frombuffer(data, np.uint8, stride, y * (stride + 1) + 1)
        above, own = rows[y, step:], rows[y + 1]
        if kind == 0:
            own[step:] = line
        elif kind == 1:
            for k in range(step):
                own[step + k :: step] = np.cumsum(line[k::step], dtype=np.uint32).astype(np.uint8)
        elif kind == 2:
            own[step:] = line + above
        elif kind in (3, 4):
            left, up, corner = [0] * step, rows[y].tolist(), rows[y].tolist()
            out = left + [0] * stride
            values = line.tolist()
            for x in range(stride):
                a, b, c = out[x], up[x + step], corner[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                out[x + step] = (values[x] + guess) & 255
            own[:] = out
        else:
            raise ValueError("unknown filter")
    return rows[1:, step:]


def decode_png(raw: bytes) -> np.ndarray:
    """Pixels (height, width, 3 or 4) of a PNG that isn't interlaced; 16-bit samples keep their upper half."""
    if not raw.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    parts: dict[bytes, list[bytes]] = {}
    for kind, body in _chunks(raw):
        parts.setdefault(kind, []).append(body)
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"][0])
    if interlaced or colour not in CHANNELS or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("interlaced, empty, too large or of an unknown kind")
    channels = CHANNELS[colour]
    stride, step = -(-width * channels * depth // 8), max(1, channels * depth // 8)
    need = height * (stride + 1)
    data = zlib.decompressobj().decompress(b"".join(parts[b"IDAT"]), need)
    if len(data) != need:
        raise ValueError("too few pixels")
    rows = _unfilter(data, height, stride, step)
    if depth == 16:
        samples = rows[:, ::2]
    elif depth == 8:
        samples = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, : width * channels]
        samples = bits @ (1 << np.arange(depth - 1, -1, -1))
        if colour != 3:
            samples = samples * 255 // ((1 << depth) - 1)
    pixels = samples.astype(np.uint8).reshape(height, width, channels)
    if colour == 3:
        table = np.frombuffer(parts[b"PLTE"][0], np.uint8).reshape(-1, 3)
        alpha = np.full(len(table), 255, np.uint8)
        known = np.frombuffer(parts.get(b"tRNS", [b""])[0], np.uint8)[: len(table)]
        alpha[: len(known)] = known
        return np.concatenate([table, alpha[:, None]], axis=1)[pixels[:, :, 0]]
    if colour == 4:
        return np.concatenate([np.repeat(pixels[:, :, :1], 3, axis=2), pixels[:, :, 1:]], axis=2)
    return np.repeat(pixels, 3, axis=2) if colour == 0 else pixels


def encode_png(pixels: np.ndarray, level: int = LEVEL) -> bytes:
    """A PNG of (height, width, 3 or 4) bytes, unfiltered."""
    height, width, channels = pixels.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 6, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def to_png(raw: bytes | None) -> bytes | None:
    """The image as PNG, or the bytes as they are if they can't be decoded."""
    if raw is None:
        return None
    try:
        return encode_png(decode_png(raw))
    except (ValueError, KeyError, IndexError, struct.error, zlib.error):
        pass
    try:
        from PIL import Image
    except ImportError:
        return raw
    try:
        image = Image.open(io.BytesIO(raw))
        image = image.convert("RGBA" if image.mode in ("P", "PA", "LA", "RGBA") else "RGB")
        out = io.BytesIO()
        image.save(out, format="PNG", compress_level=LEVEL)
        return out.getvalue()
    except Exception:  # whatever a broken image makes the library raise
        return raw


def png(image: Column) -> Column:
    """``to_png`` of a binary column."""

    def convert(images: pd.Series) -> pd.Series:
        return images.map(to_png)

    return F.pandas_udf(convert, "binary")(image)
