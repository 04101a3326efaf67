"""Images in binary columns: a PNG codec in zlib and numpy, and perceptual hashes of low-frequency cosine terms.

Writing: 8-bit grey samples, each row filtered by None, Sub or Up (whichever has the least sum of signed samples),
deflated, in chunks with CRC-32. Reading tests the signature, every chunk's CRC and the sizes, inflates, and undoes
any of the five filters with numpy. A payload of bytes becomes an image of WIDTH columns, so it comes back bit by bit.
The hash shrinks the image to SIDE x SIDE means, takes the lowest CORNER x CORNER cosine terms and writes a bit for
each: above the median of the terms but the first, or not.

Cases: a null text is empty, and an empty payload is one row of zeros; equal texts give equal media; texts of any
length are stored whole; other columns pass, those named as a new one give way. A damaged image raises ValueError.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexiquarry.llm.common import append_by_text

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, SIDE, CORNER, LEVEL = 64, 32, 8, 6


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_write(image: np.ndarray) -> bytes:
    """An 8-bit grey PNG of a uint8 array (rows, columns)."""
    height, width = image.shape
    ways = np.stack([image, np.diff(image, axis=1, prepend=np.uint8(0)), np.diff(image, axis=0, prepend=np.uint8(0))])
    kind = np.abs(ways.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = ways[kind, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def chunks(data: bytes):
    """(kind, content) of each chunk, its CRC tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        yield kind, body
        at += 12 + n


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """The samples of filtered rows (a filter byte before each); bytes per sample: one."""
    kinds, raw = rows[:, 0], rows[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    out = np.empty_like(raw)
    flat = kinds == 0
    out[flat] = raw[flat]
    sub = kinds == 1
    out[sub] = np.cumsum(raw[sub], axis=1, dtype=np.uint8)
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for lo, hi in zip(edges, edges[1:]):
        if hi == lo or kinds[lo] < 2:
            continue
        above = out[lo - 1] if lo else np.zeros(raw.shape[1], np.uint8)
        if kinds[lo] == 2:
            out[lo:hi] = np.cumsum(raw[lo:hi], axis=0, dtype=np.uint8) + above
            continue
        for y in range(lo, hi):
            up, left, corner = above.astype(int).tolist(), 0, 0
            line = []
            for x, v in enumerate(raw[y].tolist()):
                if kinds[y] == 3:
                    left = (v + (left + up[x]) // 2) & 255
                else:
                    p = left + up[x] - corner
                    a, b, c = abs(p - left), abs(p - up[x]), abs(p - corner)
                    left = (v + (left if a <= b and a <= c else up[x] if b <= c else corner)) & 255
                    corner = up[x]
                line.append(left)
            out[y] = above = np.array(line, np.uint8)
    return out


def png_read(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG."""
    head, body, ended = None, [], False
    for kind, content in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey PNG without interlace")
    width, height = head[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if rows.size != height * (width + 1):
        raise ValueError("the image has another size than its header says")
    return unfiltered(rows.reshape(height, width + 1))


@functools.cache
def cosines() -> np.ndarray:
    k, x = np.arange(CORNER)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def shrunk(image: np.ndarray, axis: int) -> np.ndarray:
    """Means of SIDE equal parts of an axis; parts share a sample where there are fewer samples than parts."""
    n = image.shape[axis]
    edges = np.arange(SIDE + 1) * n / SIDE
    lo = np.floor(edges[:-1]).astype(int)
    hi = np.maximum(np.ceil(edges[1:]).astype(int), lo + 1)
    total = np.concatenate([np.zeros_like(np.take(image, [0], axis)), np.cumsum(image, axis=axis)], axis=axis)
    width = (hi - lo).reshape(-1, 1) if axis == 0 else (hi - lo).reshape(1, -1)
    return (np.take(total, hi, axis) - np.take(total, lo, axis)) / width


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as 16 hexadecimal digits."""
    small = shrunk(shrunk(image.astype(np.float64), 0), 1)
    terms = (cosines() @ small @ cosines().T).ravel()
    return np.packbits(terms > np.median(terms[1:])).tobytes().hex()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes with zeros up to a positive multiple of WIDTH, and how many bytes the text has."""
    data = (text or "").encode()
    return data + bytes(max(1, -(-len(data) // WIDTH)) * WIDTH - len(data)), len(data)


def store_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df and n_bytes, media (binary: a PNG of the text's payload), and from the bytes of media read back: payload (binary) and feature (hash)."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())]

    def make():
        def work(texts):
            made = [payload_of(t) for t in texts]
            media = [png_write(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for p, _ in made]
            images = [png_read(m) for m in media]
            return [n for _, n in made], media, [i.tobytes() for i in images], [cosine_hash(i) for i in images]

        return work

    return append_by_text(df, text_col, fields, make)
