"""Substring dedup: windows of words that an earlier document has, by super-k-mers.

A window's minimiser is its gram of ``GRAM`` words with the least hash. Consecutive
windows with one minimiser make a super-k-mer; it travels as one packed string to the
bucket of the minimiser's hash, so all copies of a window meet in one bucket. There
the windows of the distinct strings are sorted by hash, equal hashes are compared
byte by byte, and each window gets the smallest doc_id that holds it. Ranges of words
to remove then travel to the block of their document.

A bucket of more than ``CROWD`` strings, as a passage in many documents makes one, goes
in parts: each part names its distinct windows with their smallest doc_id, a window over
all parts finds the smallest of all, and what is smaller than a part's own goes back.

Edge cases: null or empty text, or fewer words than a window, loses nothing; a null
doc_id counts as larger than any other; rows with one doc_id do not dedup each other;
repeated rows each get a row; a text may have any length, and is worked on in segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrays import PrefixHash, binary_array, byte_view, column, gather, gram_hashes, mixed, pieces, trim, words_of
from corpusloom.llm.packing import MOST, SEGMENT, Strings, among, anchors, blob_rows, blobs_of, bucket_count, crowded, in_blocks, keyed, known_text, numbers, pack_buckets, pack_ranges, row_ranges, unpack_bucket, unpacked_texts
from corpusloom.plans.session import materialize

GRAM = 3
#: Strings beyond which a bucket goes in parts, and strings of a part.
CROWD, PART = 1 << 19, 1 << 14


def super_kmers(data: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(single-spaced bytes, starts, ends, minimiser hash, row, first word) of each."""
    starts, ends, first = words_of(data, rows)
    # words joined by one space: a word's bytes and one byte after it
    wide = ends - starts
    spaced = np.cumsum(wide + 1) - (wide + 1)
    body, offsets = gather(data, starts, ends)
    joined = np.full(int((wide + 1).sum()), 0x20, np.uint8)
    joined[np.arange(len(body)) + np.repeat(np.arange(len(wide)), wide)] = body
    grams = gram_hashes(PrefixHash(body).of(offsets[:-1], offsets[1:]), GRAM)
    span = window - GRAM + 1
    anchor = anchors(grams, span)
    valid = np.zeros(len(anchor) + 1, np.int64)
    sizes = np.diff(first)
    long = sizes >= window
    np.add.at(valid, first[:-1][long], 1)
    np.add.at(valid, first[1:][long] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(at):
        none = np.zeros(0, np.int64)
        return joined, none, none, none.astype(np.uint64), none, none
    row = np.searchsorted(first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(anchor[at]) != 0) | (np.diff(row) != 0)
    a = at[new]
    z = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])] + window - 1
    return joined, spaced[a], spaced[z] + wide[z], grams[anchor[a]], row[new], a - first[row[new]]


def segments(data: np.ndarray, rows: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets of rows, words before): a very long text in parts that share ``window`` - 1 words."""
    if len(data) <= 2 * SEGMENT:
        yield data, rows, 0
        return
    starts, ends, first = words_of(data, rows)
    step = SEGMENT // 4
    for row in range(len(rows) - 1):  # long texts come one at a time
        for at in range(int(first[row]), max(int(first[row]) + 1, int(first[row + 1]) - window + 1), step):
            to = min(int(first[row + 1]), at + step + window - 1)
            if to > at:
                a, z = int(starts[at]), int(ends[to - 1])
                yield data[a:z], np.concatenate([np.zeros(row + 1, np.int64), np.full(len(rows) - 1 - row, z - a)]), at - int(first[row])


def window_owners(strings: Strings, window: int, chunk: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The smallest doc_id of every window of every string, and offsets by string."""
    n = len(strings.offsets) - 1
    least = np.full(n, MOST)
    np.minimum.at(least, strings.code, strings.doc_id)
    hashes, begins, ends, of = [], [], [], []
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(strings.offsets, strings.offsets[at] + chunk, "right")) - 1)
        base = strings.offsets[at]
        own, rows = strings.data[base : strings.offsets[to]], strings.offsets[at : to + 1] - base
        a, z, first = words_of(own, rows)
        count = np.diff(first) - window + 1
        k, _ = gather(np.arange(len(a)), first[:-1], first[:-1] + count)
        hashes.append(mixed(PrefixHash(own).of(a[k], z[k + window - 1])))
        begins.append(a[k] + base)
        ends.append(z[k + window - 1] + base)
        of.append(np.repeat(np.arange(at, to), count))
        at = to
    h, a, z, s = (np.concatenate(x) for x in (hashes, begins, ends, of))
    owner = least[s]
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    in_run = same | np.concatenate([same[1:], [False]])
    if in_run.any():
        picked = order[in_run]
        run = np.cumsum(~same[in_run]) - 1
        run = _verified(strings.data, a[picked], z[picked], run)
        best = np.full(int(run.max()) + 1, MOST)
        np.minimum.at(best, run, owner[picked])
        owner[picked] = best[run]
    return owner, np.searchsorted(s, np.arange(n + 1))


def _verified(data: np.ndarray, a: np.ndarray, z: np.ndarray, run: np.ndarray, most: int = 200_000) -> np.ndarray:
    """Runs of equal hashes, split where the bytes differ from those of the first."""
    lead = np.searchsorted(run, np.arange(run[-1] + 1))[run]
    odd = (z - a) != (z - a)[lead]
    for at in range(0, len(a), most):
        part = np.arange(at, min(at + most, len(a)))
        part = part[~odd[part] & (lead[part] != part)]
        own, cuts = gather(data, a[part], z[part])
        other, _ = gather(data, a[lead[part]], z[lead[part]])
        if len(part):
            odd[part] = np.logical_or.reduceat(own != other, cuts[:-1])
    if odd.any():
        names: dict[bytes, int] = {}
        run = run.copy()
        for i in np.flatnonzero(odd).tolist():
            run[i] = names.setdefault(data[a[i] : z[i]].tobytes(), int(run.max()) + 1 + len(names))
    return run


def distinct_windows(strings: Strings, window: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct windows, their smallest doc_ids, which of them each window is, offsets by string)."""
    n = len(strings.offsets) - 1
    least = np.full(n, MOST)
    np.minimum.at(least, strings.code, strings.doc_id)
    a, z, first = words_of(strings.data, strings.offsets)
    count = np.diff(first) - window + 1
    k, offsets = gather(np.arange(len(a)), first[:-1], first[:-1] + count)
    coded = binary_array(*gather(strings.data, a[k], z[k + window - 1])).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    own = np.full(len(coded.dictionary), MOST)
    np.minimum.at(own, code, np.repeat(least, count))
    return coded.dictionary, own, code, offsets


def ranges_to_remove(strings: Strings, window: int, owners: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first word, word after the last) of what occurrences lose, run by run."""
    owner, offsets = owners or window_owners(strings, window)
    low, high = offsets[strings.code], offsets[strings.code + 1]
    at, cuts = gather(np.arange(len(owner)), low, high)
    who = np.repeat(np.arange(len(strings.code)), high - low)
    gone = owner[at] < strings.doc_id[who]
    before = np.concatenate([[False], gone[:-1]])
    before[cuts[:-1][cuts[:-1] < len(gone)]] = False
    after = np.concatenate([gone[1:], [False]])
    after[cuts[1:] - 1] = False
    a, z = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
    k = np.arange(len(at)) - cuts[who]
    return strings.key[who[a]], strings.place[who[a]] + k[a], strings.place[who[a]] + k[z] + window


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every text without its earlier windows.

    ``kept`` joins the remaining words by single spaces.
    """
    docs = keyed(docs)
    buckets, known = bucket_count(docs), known_text(docs)

    def tags_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for data, rows, _ in segments(*byte_view(column(batch, "text")), window):
            yield mixed(super_kmers(data, rows, window)[3])

    hot, sizes = crowded(docs, tags_of, buckets, CROWD)
    parts = -(-sizes // PART)

    def strings_of(batch: pa.RecordBatch, crowds: bool) -> Iterator[tuple[int, bytes]]:
        ids, keys = numbers(column(batch, "doc_id"), MOST), numbers(column(batch, "_key"), 0)
        for data, rows, before in segments(*byte_view(column(batch, "text")), window):
            joined, a, z, tags, row, place = super_kmers(data, rows, window)
            tags = mixed(tags)
            own = np.flatnonzero(among(tags, buckets, hot) == crowds)
            yield from pack_buckets(joined, a[own], z[own], tags[own], np.zeros(len(own), np.int64), row[own], (place + before)[own], ids, keys, buckets, tagged=False, known=known)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 3 << 20):
                yield blob_rows(strings_of(batch, False), "bucket")

    def count(table: pa.Table) -> pa.Table:
        found = ranges_to_remove(unpack_bucket(blobs_of(table), known), window)
        trim()
        return pa.Table.from_batches([blob_rows(pack_ranges(*found, buckets), "block")])

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
        texts = unpacked_texts(left, known)
        row, a, b = row_ranges(numbers(left.column("_key"), 0), blobs_of(right))
        bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        for i, text in enumerate(texts):
            words = text.split()
            out["n_words"].append(len(words))
            if bounds[i] < bounds[i + 1]:
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, a[bounds[i] : bounds[i + 1]], 1)
                np.add.at(gone, b[bounds[i] : bounds[i + 1]], -1)
                stays = (np.cumsum(gone[:-1]) == 0).tolist()
                words = [w for w, s in zip(words, stays, strict=True) if s]
            out["n_removed"].append(out["n_words"][-1] - len(words))
            out["kept"].append(b" ".join(words).decode())
        return pa.table({"doc_id": left.column("doc_id"), **{k: pa.array(v, pa.int64() if k != "kept" else pa.string()) for k, v in out.items()}})

    def split_crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 3 << 20):
                found = blob_rows(strings_of(batch, True), "bucket")
                turn = int(numbers(column(batch, "_key"), 0)[0])  # alike if the task runs again
                part = turn % parts[np.searchsorted(hot, found.column(0).to_numpy())]
                yield pa.RecordBatch.from_arrays([found.column(0), pa.array(part), found.column(1)], names=["bucket", "part", "blob"])

    def name(table: pa.Table) -> pa.Table:
        windows, own, _, _ = distinct_windows(unpack_bucket(blobs_of(table), known), window)
        trim()
        place = [pa.array(np.full(len(own), table.column(c)[0].as_py(), np.int64)) for c in ("bucket", "part")]
        return pa.table([windows.cast(pa.binary()), pa.array(own), *place], names=["window", "own", "bucket", "part"])

    def count_part(left: pa.Table, right: pa.Table) -> pa.Table:
        strings = unpack_bucket(blobs_of(left), known)
        windows, own, code, offsets = distinct_windows(strings, window)
        if right.num_rows:
            at = pc.index_in(right.column("window").combine_chunks().cast(windows.type), value_set=windows).to_numpy()
            own[at] = right.column("least").to_numpy()
        found = ranges_to_remove(strings, window, (own[code], offsets))
        trim()
        return pa.Table.from_batches([blob_rows(pack_ranges(*found, buckets), "block")])

    def in_parts() -> DataFrame:
        crowds = materialize(docs.mapInArrow(split_crowds, "bucket long, part long, blob binary"), "crowds")
        named = crowds.groupBy("bucket", "part").applyInArrow(name, "window binary, own long, bucket long, part long")
        least = named.withColumn("least", F.min("own").over(Window.partitionBy("window"))).where("own > least").select("bucket", "part", "window", "least")
        return crowds.groupBy("bucket", "part").cogroup(least.groupBy("bucket", "part")).applyInArrow(count_part, "block long, blob binary")

    packed = docs.mapInArrow(split, "bucket long, blob binary")
    ranges = packed.groupBy("bucket").applyInArrow(count, "block long, blob binary")
    if len(hot):
        ranges = ranges.unionAll(in_parts())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_blocks(docs, buckets, known).groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, kept string")


def brute_force(documents: list[tuple[int, str | None]], window: int = 13) -> dict[int, tuple[int, int, str]]:
    """The contract word by word, for tests on small tables."""
    words = {d: [w.decode() for w in (t or "").encode().split()] for d, t in documents}
    first: dict[tuple[str, ...], int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, own in words.items():
        gone = set()
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out[d] = (len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone))
    return out
