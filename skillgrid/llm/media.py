"""Media in binary columns: PNG files written and read with zlib and numpy, and a perceptual hash.

The file holds 8-bit RGB samples. Rows are written with the one of the filters None, Sub and Up whose differences
are least, all of which numpy undoes whole rows at a time. Reading tests every chunk's checksum and undoes all five
row filters.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_BYTES = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 1
OUT_BYTES = 1 << 23


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, row_bytes: int = ROW_BYTES) -> bytes:
    """An RGB file with rows of `row_bytes` samples, whole pixels, that holds the payload, which must fill its rows."""
    rows, rest = divmod(len(payload), row_bytes)
    if rest or not rows:
        raise ValueError("the payload doesn't fill whole rows")
    lines = filtered(np.frombuffer(payload, np.uint8).reshape(rows, row_bytes), 3)
    head = struct.pack(">IIBBBBB", row_bytes // 3, rows, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def filtered(x: np.ndarray, step: int) -> np.ndarray:
    """Rows of samples after their filter's type: None, Sub or Up, that with the least sum of the differences'
    sizes, the first of equal ones; step: bytes a pixel."""
    ways = np.stack([x, x, x])
    ways[1, :, step:] -= x[:, :-step]
    ways[2, 1:] -= x[:-1]
    kinds = np.minimum(ways, -ways).sum(axis=2, dtype=np.int64).argmin(axis=0)
    return np.column_stack([kinds.astype(np.uint8), ways[kinds, np.arange(len(x))]])


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Samples of rows that begin with their filter's type; step: bytes a pixel."""
    kinds, x = lines[:, 0], lines[:, 1:].copy()
    n, left = x.shape[1], np.flatnonzero(kinds == 1)
    x[left] = x[left].reshape(len(left), n // step, step).cumsum(axis=1, dtype=np.uint8).reshape(len(left), n)
    for r in np.flatnonzero(kinds > 1):
        row, up, kind = x[r], x[r - 1] if r else np.zeros(n, np.uint8), int(kinds[r])
        if kind == 2:
            row += up
        elif kind in (3, 4):
            above, out = up.tolist(), row.tolist()
            for i in range(n):
                left = out[i - step] if i >= step else 0
                if kind == 3:
                    guess = (left + above[i]) // 2
                else:
                    corner = above[i - step] if i >= step else 0
                    p = left + above[i] - corner
                    a, b, c = abs(p - left), abs(p - above[i]), abs(p - corner)
                    guess = left if a <= b and a <= c else above[i] if b <= c else corner
                out[i] = (out[i] + guess) & 255
            row[:] = out
        else:
            raise ValueError("unknown row filter")
    return x


def read_png(data: bytes) -> np.ndarray:
    """Samples (rows, columns, channels) of an 8-bit grey, RGB or RGBA file without interlacing; raises
    ValueError where the file is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        content = data[at + 8 : at + 8 + n]
        if len(content) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + content)):
            raise ValueError("a chunk's checksum doesn't match")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("not a whole file of a kind that is read here")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != height * (width * channels + 1):
        raise ValueError("the samples don't fill the picture")
    return unfilter(raw.reshape(height, width * channels + 1), channels).reshape(height, width, channels)


def _cosines(n: int, kept: int) -> np.ndarray:
    k, i = np.arange(kept)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


_BASIS = _cosines(32, 8)


def cosine_hash(samples: np.ndarray) -> int:
    """64 bits: which of the 8 x 8 lowest frequencies of the cosine transform of the picture, as 32 x 32
    mean greys, lie above their median (the first, the mean brightness, isn't counted for it)."""
    grey = samples.mean(axis=2)
    h, w = grey.shape
    edges = lambda n: (np.arange(32) * n // 32, np.maximum(np.arange(1, 33) * n // 32, np.arange(32) * n // 32 + 1))
    (top, bottom), (left, right) = edges(h), edges(w)
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)
    sums = total[bottom][:, right] - total[top][:, right] - total[bottom][:, left] + total[top][:, left]
    small = sums / ((bottom - top)[:, None] * (right - left)[None, :])
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    return int.from_bytes(np.packbits(low > np.median(low[1:])).tobytes(), "big")


def store(docs: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, padded with spaces to a positive multiple of
    `row_bytes`, as a PNG file. A null text counts as an empty one; rows stand for themselves, so repeated
    rows and ties come out as they went in; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            lo, media, size, held = 0, [], [], 0
            for i in range(len(texts)):
                raw = texts[i].as_py() or b""
                media.append(write_png(raw.ljust(max(1, -(-len(raw) // row_bytes)) * row_bytes, b" "), row_bytes))
                size.append(len(raw))
                held += len(media[-1])
                if held >= OUT_BYTES or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, len(size)), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    lo, media, size, held = i + 1, [], [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def load(media: DataFrame) -> DataFrame:
    """Adds to (doc_id, n_bytes, media) what the files hold: payload and feature (16 hexadecimal digits of
    cosine_hash). Damaged or null files give null in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, payload, feature, held = 0, [], [], 0
            files = batch.column(2)
            for i in range(len(files)):
                try:
                    samples = read_png(files[i].as_py() or b"")
                    payload.append(samples.tobytes())
                    feature.append(f"{cosine_hash(samples):016x}")
                except (ValueError, zlib.error, struct.error):
                    payload.append(None)
                    feature.append(None)
                held += len(payload[-1] or b"")
                if held >= OUT_BYTES or i == len(files) - 1:
                    part = batch.slice(lo, len(payload))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payload, pa.binary()), pa.array(feature, pa.string())], ["doc_id", "n_bytes", "media", "payload", "feature"])
                    lo, payload, feature, held = i + 1, [], [], 0

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")
