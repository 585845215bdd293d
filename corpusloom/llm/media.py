"""Media columns: texts kept losslessly as PNG images, and hashes of the images.

A text's UTF-8 bytes, filled up with spaces to whole rows, are the samples of an
8-bit RGB image of 64 pixels a row. The image is written as a PNG (signature, IHDR,
IDAT parts, IEND, each with its CRC) and read back with every checksum tested and
the rows' filters undone. Its feature hashes the low frequencies of a cosine
transform, so that images that look alike get hashes of few different bits.

Edge cases: a null or empty text is one row of spaces; equal texts have equal
values; repeated rows each get a row; broken media raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from corpusloom.llm.arrays import column, map_text

SIGNATURE = b"\x89PNG\r\n\x1a\n"
PIXELS, CHANNELS = 64, 3
ROW = PIXELS * CHANNELS
PART = 1 << 16


def padded(raw: bytes) -> bytes:
    """Filled up with spaces to a positive multiple of a row."""
    return raw + b" " * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray) -> np.ndarray:
    """Rows with their filter byte: of none, left and above the one of least sum."""
    left, above = rows.copy(), rows.copy()
    left[:, CHANNELS:] -= rows[:, :-CHANNELS]
    above[1:] -= rows[:-1]
    choices = np.stack([rows, left, above])
    cost = np.abs(choices.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64)
    best = cost.argmin(0)
    out = np.empty((len(rows), ROW + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = choices[best, np.arange(len(rows))]
    return out


def encode_png(payload: bytes) -> bytes:
    """The smaller of two losslessly packed forms: unfiltered, or filtered by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    plain = np.zeros((len(rows), ROW + 1), np.uint8)
    plain[:, 1:] = rows
    packed = min((zlib.compress(x.tobytes(), 6) for x in (plain, filtered(rows))), key=len)
    head = struct.pack(">IIBBBBB", PIXELS, len(rows), 8, 2, 0, 0, 0)
    parts = [_chunk(b"IDAT", packed[i : i + PART]) for i in range(0, len(packed), PART)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def decode_png(media: bytes) -> tuple[np.ndarray, int]:
    """Samples (height, width x channels) and channels of an 8-bit RGB or grey PNG."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, head, ended = 8, [], None, False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("a chunk is cut off")
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if media[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"wrong checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or head is None:
        raise ValueError("IHDR or IEND is missing")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in (0, 2) or interlaced:
        raise ValueError("only 8-bit grey or RGB without interlace is read")
    channels = 3 if colour == 2 else 1
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if lines.size != height * (width * channels + 1):
        raise ValueError("wrong number of samples")
    return unfiltered(lines.reshape(height, -1), channels), channels


def unfiltered(lines: np.ndarray, channels: int) -> np.ndarray:
    """Undoes the five row filters; runs of rows of one filter are done at once."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    height, width = out.shape
    left = np.flatnonzero(kinds == 1)
    if len(left):
        out[left] = np.cumsum(out[left].reshape(len(left), -1, channels), 1, dtype=np.uint8).reshape(len(left), -1)
    bounds = np.flatnonzero(np.diff(kinds, prepend=kinds[:1] ^ 1)).tolist()
    for a, b in zip(bounds, [*bounds[1:], height], strict=True):
        if kinds[a] == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], 0, dtype=np.uint8)
        elif kinds[a] > 2:
            for r in range(a, b):
                above = out[r - 1].astype(np.int64) if r else np.zeros(width, np.int64)
                _undo_row(out[r], above, channels, kinds[r] == 3)
    return out


def _undo_row(row: np.ndarray, above: np.ndarray, channels: int, average: bool) -> None:
    """A row whose every pixel needs the one before: mean, or nearest of three."""
    left, corner = np.zeros(channels, np.int64), np.zeros(channels, np.int64)
    for i in range(0, len(row), channels):
        up = above[i : i + channels]
        if average:
            guess = (left + up) >> 1
        else:
            far = left + up - corner
            gaps = np.stack([np.abs(far - left), np.abs(far - up), np.abs(far - corner)])
            guess = np.choose(gaps.argmin(0), [left, up, corner])
        row[i : i + channels] = (row[i : i + channels] + guess) & 255
        left, corner = row[i : i + channels].astype(np.int64), up


_SIDE, _LOW = 32, 8
_COSINE = np.cos(np.pi / _SIDE * (np.arange(_SIDE) + 0.5)[None, :] * np.arange(_LOW)[:, None])


def _shrunk(x: np.ndarray, side: int) -> np.ndarray:
    """Means over ``side`` equal spans of the first axis, of one row at least."""
    n = len(x)
    low = np.arange(side) * n // side
    high = np.maximum(low + 1, -(-(np.arange(side) + 1) * n // side))
    sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, 0)])
    return (sums[high] - sums[low]) / (high - low)[:, None]


def cosine_hash(samples: np.ndarray, channels: int) -> str:
    """64 bits: which low-frequency coefficients of the grey image exceed their median."""
    pixels = samples.reshape(len(samples), -1, channels).astype(np.float64)
    grey = pixels @ np.array([0.299, 0.587, 0.114]) if channels == 3 else pixels[:, :, 0]
    small = _shrunk(_shrunk(grey, _SIDE).T, _SIDE).T
    low = np.round(_COSINE @ small @ _COSINE.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


STORED = [StructField("n_bytes", LongType()), StructField("media", BinaryType())]
READ = [
    StructField("payload_bytes", LongType()),
    StructField("payload_sha256", StringType()),
    StructField("tail_crc32", LongType()),
    StructField("media_bytes", LongType()),
    StructField("media_sha256", StringType()),
    StructField("feature", StringType()),
]


def store(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each text as a PNG in the column ``media``, with its length in bytes."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        texts = [x or b"" for x in column(batch, "text").cast(pa.binary()).to_pylist()]
        return {"n_bytes": [len(x) for x in texts], "media": [encode_png(padded(x)) for x in texts]}

    return map_text(docs, list(keep), STORED, work)


def read_back(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Decodes the column ``media`` and describes payload and image."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {f.name: [] for f in READ}
        for stored in column(batch, "media").to_pylist():
            samples, channels = decode_png(stored)
            payload = samples.tobytes()
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-16:]))
            out["media_bytes"].append(len(stored))
            out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
            out["feature"].append(cosine_hash(samples, channels))
        return out

    return map_text(media.where(F.col("media").isNotNull()), list(keep), READ, work, text="media")
