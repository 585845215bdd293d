"""Benchmark decontamination by one Aho-Corasick automaton over word windows.

Texts are normalised to their words, joined and framed by single spaces; a pattern
is a window of benchmark words framed likewise, so that matches keep to words. The
automaton reads each text once, and the few matches are mapped back to word numbers
and to code points of the original text.

The windows are a table of (window, item). Its size is summed before any of it is
broadcast: up to ``BLOCK_BYTES`` one automaton holds it all. A larger benchmark is cut
by hash into blocks of that size; for each block in turn the texts are read once, the
hits are written, and the block is dropped, so a worker holds one automaton at a time
and the driver one block.

Edge cases: a null text or item has no words; a text of separators only has none; an
item of fewer words than a window is one window; items of a null item_id are one item,
which counts but has no name in the joined ids; repeated rows each get a row; an empty
benchmark hits nothing; other columns are ignored unless kept, and a made column
replaces a kept one of its name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corpusloom.llm.arrays import column, map_text, sha256_hex
from corpusloom.plans.session import materialize, ship

#: Windows with their ids that one automaton may hold (about 36 bytes of memory for each), and what a row costs beside its bytes.
BLOCK_BYTES, ROW_BYTES = 8 << 20, 16

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-cases A-Z and turns every separator into a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or WORD.match(bytes([c])) else 32 for c in range(256))
SPAN = StructType([StructField("item_id", StringType()), StructField("start", LongType()), StructField("end", LongType())])
FIELDS = [
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("item_ids", ArrayType(StringType())),
    StructField("spans", ArrayType(SPAN)),
]


def normalised(text: bytes | None) -> bytes:
    """The words of a UTF-8 text, lower-cased from A-Z, joined by single spaces."""
    return b" ".join((text or b"").translate(_PLAIN).split())


def item_windows(text: str | bytes | None, n: int) -> set[bytes]:
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text
    words = normalised(raw).split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct (window, item) of a benchmark, made where its rows lie."""
    ship(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(column(batch, "item").to_pylist(), column(batch, "text").cast(pa.binary()).to_pylist(), strict=True):
                own = sorted(item_windows(text, n))
                for at in range(0, len(own), 50_000):
                    part = own[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([item] * len(part), pa.string())], names=["window", "item"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "window binary, item string").distinct()


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, block: Broadcast) -> ahocorasick.Automaton:
    """Built once in each worker process, which keeps that of one block."""
    if key not in _built:
        _built.clear()
        ids: dict[bytes, list[str | None]] = {}
        for window, item in block.value:
            ids.setdefault(window, []).append(item)
        found = ahocorasick.Automaton()
        for window, own in ids.items():
            found.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, own))
        if ids:
            found.make_automaton()
        _built[key] = found
    return _built[key]


Ranges = dict[str | None, list[tuple[int, int]]]


def _matches(automaton: ahocorasick.Automaton, text: bytes) -> Ranges:
    """By item the (first word, word after the last) of every window in a normalised text."""
    by_item: Ranges = {}
    if not text or not len(automaton):
        return by_item
    hits = list(automaton.iter(f" {text.decode('latin-1')} "))
    if hits:
        gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1
        for (_, (size, ids)), word in zip(hits, np.searchsorted(gaps, [e for e, _ in hits]).tolist(), strict=True):
            for i in ids:
                by_item.setdefault(i, []).append((word + 1 - size, word + 1))
    return by_item


def _runs(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of word ranges."""
    run: list[list[int]] = []
    for a, b in sorted(ranges):
        if run and a <= run[-1][1]:
            run[-1][1] = max(run[-1][1], b)
        else:
            run.append([a, b])
    return [(a, b) for a, b in run]


def _named(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: its words, hit words, items found and their original spans.

    ``spans`` holds one row per item and maximal run of its hit words, in code points
    of the text.
    """
    context = docs.sparkSession.sparkContext
    table = materialize(windows(benchmark, n), "windows")
    size = table.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))

    def block(k: int) -> tuple[str, Broadcast]:
        own = table.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k) if blocks > 1 else table
        return uuid.uuid4().hex, context.broadcast([(bytes(w), i) for w, i in own.collect()])  # about block_bytes

    if blocks == 1:
        key, shared = block(0)

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            automaton, texts = _automaton(key, shared), column(batch, "text").cast(pa.binary()).to_pylist()
            return _described(texts, [_matches(automaton, normalised(t)) for t in texts])

        return map_text(docs, list(keep), FIELDS, work)
    own_key = _fresh("_row", docs.columns)
    rows = docs.withColumn(own_key, F.sha2(F.to_json(F.struct(F.col("doc_id").cast("string").alias("i"), F.col("text").alias("t"))), 256))  # rows of one key have one result
    hits = [materialize(_hits(rows, own_key, *block(k)), "hits") for k in range(blocks)]
    found = reduce(DataFrame.unionByName, hits).distinct().groupBy(own_key).agg(F.collect_list(F.struct("item", "a", "b")).alias("_found"))
    own_found = _fresh("_found", docs.columns)
    joined = rows.join(found.withColumnRenamed("_found", own_found), own_key, "left").drop(own_key)

    def merge(batch: pa.RecordBatch) -> dict[str, object]:
        by_row: list[Ranges] = []
        for listed in column(batch, own_found).to_pylist():
            by_row.append({})
            for r in listed or ():
                by_row[-1].setdefault(r["item"], []).append((r["a"], r["b"]))
        return _described(column(batch, "text").cast(pa.binary()).to_pylist(), by_row)

    made = {f.name for f in FIELDS}
    kept = [c for c in keep if c not in made]
    return map_text(joined, [*kept, own_found], FIELDS, merge).drop(own_found)


def _fresh(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _hits(rows: DataFrame, key: str, block_key: str, shared: Broadcast) -> DataFrame:
    """(key, item, a, b): runs of words of each row that windows of one block hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            automaton, out = _automaton(block_key, shared), []
            for name, text in zip(column(batch, key).to_pylist(), column(batch, "text").cast(pa.binary()).to_pylist(), strict=True):
                out += [(name, item, a, b) for item, own in _matches(automaton, normalised(text)).items() for a, b in _runs(own)]
            for at in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[at : at + 50_000], strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[key, "item", "a", "b"])

    return rows.select(key, "text").mapInArrow(run, f"`{key}` string, item string, a long, b long")


def _described(texts: list[bytes | None], found: list[Ranges]) -> dict[str, object]:
    """The made columns of texts, from their word ranges by item."""
    out: dict[str, list] = {f.name: [] for f in FIELDS}
    for text, by_item in zip(texts, found, strict=True):
        plain = normalised(text)
        out["n_words"].append(plain.count(b" ") + 1 if plain else 0)
        out["n_hit"].append(sum(b - a for a, b in _runs([r for own in by_item.values() for r in own])))
        out["item_ids"].append(sorted(by_item, key=_named))
        out["spans"].append(_original(text, by_item) if by_item else [])
    return out


def _original(raw: bytes, by_item: Ranges) -> list[dict[str, object]]:
    at = [m.span() for m in WORD.finditer(raw.lower())]
    points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to and with each byte
    return [{"item_id": item, "start": int(points[at[a][0]]) - 1, "end": int(points[at[b - 1][1] - 1])} for item in sorted(by_item, key=_named) for a, b in _runs(by_item[item])]


def digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of ``scan``; item ids sorted as strings, comma-joined, hashed.

    An item without an id counts, and is not among the joined ones.
    """
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(documents: list[tuple[object, str | None]], items: list[tuple[object, str | None]], n: int = 10) -> list[tuple]:
    """The contract word by word, for tests on small tables."""
    windows = [(None if i is None else str(i), item_windows(t, n)) for i, t in items]
    rows = []
    for doc, text in documents:
        words = normalised((text or "").encode()).split()
        hit, ids = set(), set()
        for item, own in windows:
            for w in own:
                size = w.count(b" ") + 1
                for i in range(len(words) - size + 1):
                    if b" ".join(words[i : i + size]) == w:
                        hit |= set(range(i, i + size))
                        ids.add(item)
        rows.append((doc, len(words), len(hit), len(ids), sha256_hex(",".join(sorted(i for i in ids if i is not None)).encode()), bool(hit)))
    return rows
