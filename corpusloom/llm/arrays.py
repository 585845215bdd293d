"""Vectorised work on Arrow text columns: byte views, words, hashes, ranges."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from corpusloom.plans.session import ship

#: Separators of the plain word rule: space and the bytes 9 to 13.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def map_text(
    docs: DataFrame,
    keep: list[str],
    fields: list[StructField],
    work: Callable[[pa.RecordBatch], dict[str, object]],
    text: str = "text",
    batch_bytes: int = 4 << 20,
) -> DataFrame:
    """One output row per row: the columns ``keep`` and those that ``work`` makes.

    ``work`` gets batches that hold ``keep`` and ``text``, of about ``batch_bytes``
    of text or one longer row. A made column replaces a kept one of its name.
    """
    ship(docs.sparkSession)
    made = {f.name for f in fields}
    kept = [c for c in keep if c not in made]
    schema = StructType([*(docs.schema[c] for c in kept), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text, batch_bytes):
                out = work(batch)
                columns = []
                for f in arrow:
                    x = batch.column(f.name) if f.name in kept else out[f.name]
                    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
                    if not isinstance(x, pa.Array):
                        x = pa.array(x, type=f.type)
                    columns.append(x if x.type == f.type else x.cast(f.type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            trim()

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def trim() -> None:
    """Gives freed memory back, so that a worker that serves many stages does not keep the most of each."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def pieces(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``most`` bytes of ``text``, or of one longer row."""
    if not batch.num_rows:
        return
    _, ends = byte_view(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, rows: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words lie before each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    inside = ~separators[data]
    full = rows[:-1][np.diff(rows) > 0]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[full] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[full[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, rows)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the longest n so far."""
    found = _powers.get(base)
    if found is None or len(found) <= n:
        step = np.full(max(n + 1, 1 << 16), base, np.uint64)
        step[0] = 1
        found = _powers[base] = np.cumprod(step, dtype=np.uint64)
        if len(found) > 1 << 24:  # a huge row is rare; its table is not kept
            del _powers[base]
    return found


class PrefixHash:
    """Polynomial hashes of all byte ranges of an array, from its prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(0x51ED)) * _power(_BASE, n)[:n], out=self.sums[1:])
        self.back = _power(_INVERSE, n)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]

    def every(self, length: int) -> np.ndarray:
        """Of all ranges of one length, in order of their starts."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.back[:n] if n > 0 else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, in order of the first word."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m].copy()
    for k in range(1, n):
        out = out * np.uint64(_BASE) + mixed(words[k : k + m] + np.uint64(k))
    return mixed(out)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ranges one after another, and the offsets between them."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    kind = np.int32 if max(len(data), offsets[-1]) < 1 << 31 else np.int64  # half the memory
    at = np.arange(offsets[-1], dtype=kind)
    at += np.repeat((starts - offsets[:-1]).astype(kind), sizes)
    return data[at], offsets


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def union_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted maximal ranges of a set of ranges; touching ones merge."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[new], np.concatenate([ends[new[1:] - 1], ends[-1:]])


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
