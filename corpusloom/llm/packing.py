"""Packed rows: many strings of a bucket travel as one compressed value.

A map task sends each bucket one row per batch of texts. It holds the bucket's
strings, each distinct one once, and where they occur (row of the document, place).
Copies thus combine before the shuffle, and a bucket's rows are few and large.

With more buckets a row gets smaller, and small values compress badly by themselves. So
every compressor knows some text of the same table beforehand, of ``SAMPLE`` bytes at
most; that changes sizes, never results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from corpusloom.llm.arrays import binary_array, byte_view, column, gather, map_text, pieces, sliding_min, trim
from corpusloom.plans.session import shuffle_partitions

#: Bytes of text for each bucket: what one task holds at a time grows with this only.
BUCKET_BYTES = 6 << 20
MOST = np.iinfo(np.int64).max


#: Rows and bytes of text that compressors know beforehand.
SAMPLE_ROWS, SAMPLE = 256, 1 << 17
_codecs: dict[tuple[int, bytes], tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]] = {}


def known_text(docs: DataFrame) -> bytes:
    """Beginnings of a few texts of the table, for the compressors."""
    rows = docs.where(F.octet_length("text") > 100).select(F.substring("text", 1, SAMPLE // 64).alias("t")).limit(SAMPLE_ROWS).collect()
    return b"\n".join(r.t.encode("utf-8", "replace") for r in rows)[:SAMPLE]


def codec(known: bytes, level: int = 6) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """A compressor that knows some text, and its counterpart; made once in each worker."""
    key = (level, known)
    if key not in _codecs:
        if len(_codecs) > 8:
            _codecs.clear()
        text = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(known) > 8 else None
        if text:
            text.precompute_compress(level=level)
        _codecs[key] = zstandard.ZstdCompressor(level=level, dict_data=text), zstandard.ZstdDecompressor(dict_data=text)
    return _codecs[key]


def pack(*arrays: np.ndarray, known: bytes = b"", level: int = 6) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], np.int64)
    return codec(known, level)[0].compress(b"".join([sizes.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(blob: bytes, *types: type, known: bytes = b"") -> list[np.ndarray]:
    raw = np.frombuffer(codec(known)[1].decompress(blob), np.uint8)
    sizes, at, out = raw[: 8 * len(types)].view(np.int64), 8 * len(types), []
    for size, kind in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(raw[at : at + size].tobytes(), kind))
        at += size
    return out


#: Bytes or words of a text that are worked on at a time; places within fit in ``PLACE``.
SEGMENT = 4 << 20
PLACE = np.uint64((1 << 24) - 1)


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Of every ``width`` consecutive hashes the place of the least, the first of equal ones.

    The hash counts without its last bits, whatever the number of hashes, so equal windows
    choose alike wherever they stand. There are at most ``PLACE`` hashes.
    """
    return (sliding_min((hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64), width) & PLACE).astype(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _key): the key tells rows apart by id and text."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return plain.withColumn("_key", F.xxhash64(F.col("doc_id").cast("string"), "text"))


def in_blocks(docs: DataFrame, blocks: int, known: bytes) -> DataFrame:
    """(doc_id, _key, packed, block) of keyed documents: texts compressed for the way."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        c = codec(known, 3)[0]
        return {"packed": [c.compress(t) for t in column(batch, "text").cast(pa.binary()).to_pylist()]}

    packed = map_text(docs, ["doc_id", "_key"], [StructField("packed", BinaryType())], work)
    return packed.withColumn("block", F.pmod("_key", F.lit(blocks)))


def unpacked_texts(table: pa.Table, known: bytes) -> list[bytes]:
    d = codec(known, 3)[1]
    return [d.decompress(t) for t in table.column("packed").to_pylist()]


def bucket_count(docs: DataFrame) -> int:
    """From the bytes of all texts, and at least the shuffle's partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


def crowded(docs: DataFrame, tags_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], buckets: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that more than ``most`` strings go to, sorted, and how many do.

    ``tags_of`` yields the tags of a batch's strings. There is at most one such bucket
    for every ``most`` strings of the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 3 << 20):
                for tags in tags_of(batch):
                    names, n = np.unique((tags % np.uint64(buckets)).astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n.astype(np.int64))], names=["bucket", "n"])
            trim()

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") > most).orderBy("bucket").collect()
    return np.array([r.bucket for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def among(tags: np.ndarray, buckets: int, names: np.ndarray) -> np.ndarray:
    """Which tags go to one of the named buckets."""
    return np.isin((tags % np.uint64(buckets)).astype(np.int64), names) if len(names) else np.zeros(len(tags), bool)


@dataclass
class Strings:
    """Distinct strings with a tag each, and their occurrences in documents."""

    data: np.ndarray
    offsets: np.ndarray
    tags: np.ndarray  #: uint64 and int64 columns that a string's content determines
    marks: np.ndarray
    code: np.ndarray  #: of each occurrence: which string, whose document, and where
    doc_id: np.ndarray
    key: np.ndarray
    place: np.ndarray


def pack_buckets(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tags: np.ndarray, marks: np.ndarray, doc: np.ndarray, place: np.ndarray, ids: np.ndarray, keys: np.ndarray, buckets: int, tagged: bool = True, known: bytes = b"", most: int = 16 << 20
) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed strings) of occurrences ``data[starts:ends]``, by their tags.

    Without ``tagged`` the tags only choose the bucket and do not travel.
    """
    at = 0
    sums = np.concatenate([[0], np.cumsum(ends - starts)])
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + most, "right")) - 1)
        own, offsets = gather(data, starts[at:to], ends[at:to])
        coded = binary_array(own, offsets).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(coded.dictionary), np.int64)
        first[code[::-1]] = np.arange(to - at)[::-1]
        bucket = (tags[at:to][first] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        members = np.argsort(number[code], kind="stable")
        coded_at = number[code][members]
        names, begins = np.unique(bucket[order], return_index=True)
        for b, a, z in zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
            mine = first[order[a:z]]
            body, cuts = gather(own, offsets[mine], offsets[mine + 1])
            inside = members[np.searchsorted(coded_at, a) : np.searchsorted(coded_at, z)]
            rows, local = np.unique(doc[at:to][inside], return_inverse=True)
            yield b, pack(body, np.diff(cuts).astype(np.int32), tags[at:to][mine] * np.uint64(tagged), marks[at:to][mine].astype(np.int32), (number[code[inside]] - a).astype(np.int32), local.astype(np.int32), place[at:to][inside], ids[rows], keys[rows], known=known)
        at = to


def unpack_bucket(blobs: list[bytes], known: bytes = b"") -> Strings:
    """All strings of a bucket, each distinct one once over all its rows."""
    parts = [unpack(b, np.uint8, np.int32, np.uint64, np.int32, np.int32, np.int32, np.int64, np.int64, np.int64, known=known) for b in blobs]
    join = lambda i: np.concatenate([p[i] for p in parts])
    sizes = join(1).astype(np.int64)
    base = np.cumsum([0, *(len(p[1]) for p in parts)])
    coded = binary_array(join(0), np.concatenate([[0], np.cumsum(sizes)])).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    first = np.zeros(len(coded.dictionary), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    data, offsets = byte_view(coded.dictionary)
    return Strings(
        data=data,
        offsets=offsets,
        tags=join(2)[first],
        marks=join(3)[first].astype(np.int64),
        code=code[np.concatenate([p[4].astype(np.int64) + b for p, b in zip(parts, base[:-1], strict=True)])],
        doc_id=np.concatenate([p[7][p[5]] for p in parts]),
        key=np.concatenate([p[8][p[5]] for p in parts]),
        place=join(6),
    )


def pack_ranges(key: np.ndarray, a: np.ndarray, b: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """(block, packed ranges) of documents' ranges, by the block of their keys."""
    if not len(key):
        return
    block = np.mod(key, blocks)
    order = np.lexsort((a, key, block))
    names, begins = np.unique(block[order], return_index=True)
    for name, x, y in zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
        own = order[x:y]
        yield name, pack(key[own], a[own], b[own])


def unpack_ranges(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and ranges, sorted by key."""
    parts = [unpack(b, np.int64, np.int64, np.int64) for b in blobs]
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    key, a, b = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(key, kind="stable")
    return key[order], a[order], b[order]


def row_ranges(keys: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) for every row of ``keys``; rows of one key get the same."""
    key, a, b = unpack_ranges(blobs)
    low, high = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
    at, _ = gather(np.arange(len(key)), low, high)
    return np.repeat(np.arange(len(keys)), high - low), a[at], b[at]


def blob_rows(rows: Iterator[tuple[int, bytes]], name: str) -> pa.RecordBatch:
    found = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.binary())], names=[name, "blob"])


def blobs_of(table: pa.Table) -> list[bytes]:
    return table.column("blob").to_pylist()


def numbers(column: pa.Array, null: int) -> np.ndarray:
    return pc.fill_null(column, null).to_numpy(zero_copy_only=False).astype(np.int64)
