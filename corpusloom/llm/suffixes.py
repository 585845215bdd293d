"""Byte-level dedup of long repeats by a suffix sort that compares by hashes.

Every string of ``length`` bytes has an anchor, the place with the least hash of the
next ``GRAM`` bytes among its first places. Strings with one anchor overlap; they
travel as one packed string to the bucket of the anchor's hash, where all copies of
each meet. A packed string that occurs twice repeats wholly. For the others, the
suffixes that begin at the anchor, and the prefixes that end there read backwards,
are merge-sorted within each anchor's group. Two suffixes are compared by binary
search for their common extension on prefix polynomial hashes, a logarithmic number
of steps; the bytes found equal are then compared, so a collision changes nothing. A
string at some distance before the anchor repeats if another has the same prefix to
that distance and the same suffix for the rest: neighbours in both sorted orders tell.

A bucket of more than ``CROWD`` packed strings, as a line in many documents makes one,
is not sorted by one task. It goes in parts; each part counts its distinct strings of
``length`` bytes under two independent 64-bit hashes, the counts are summed by hash in
as many tasks as they need, and what occurs in other parts goes back.

Edge cases: null or empty text, or fewer bytes than ``length``, loses nothing; rows
with one doc_id are documents of their own, so exact copies lose all; a text may have
any length, and is worked on in segments; matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.arrays import _BASE, PrefixHash, byte_view, column, gather, mixed, pieces, trim, union_ranges
from corpusloom.llm.packing import MOST, SEGMENT, Strings, among, anchors, blob_rows, blobs_of, bucket_count, crowded, in_blocks, keyed, known_text, numbers, pack, pack_buckets, pack_ranges, row_ranges, unpack, unpack_bucket, unpacked_texts
from corpusloom.plans.session import materialize

GRAM = 41
#: Packed strings beyond which a bucket goes in parts, those of a part, and hashes of a task that sums them.
CROWD, PART, SLOT = 1 << 18, 1 << 13, 1 << 21
#: Another value for each byte, for a second hash.
_OTHER = np.random.default_rng(9).permutation(256).astype(np.uint8)
_PAIR = np.dtype([("a", np.uint64), ("b", np.uint64)])
_ALL = (1 << 64) - 1


def anchored_strings(data: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, end, anchor hash, anchor place in it, row) of strings of one anchor each."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none, none
    hashes = mixed(PrefixHash(data).every(GRAM))
    anchor = anchors(hashes, length - GRAM + 1)
    valid = np.zeros(len(anchor) + 1, np.int32)
    long = np.diff(rows) >= length
    np.add.at(valid, rows[:-1][long], 1)
    np.add.at(valid, rows[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(at):
        return none, none, none.astype(np.uint64), none, none
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(anchor[at]) != 0)
    new[1:] |= np.isin(at[1:], rows)
    a = at[new]
    z = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])] + length
    return a, z, hashes[anchor[a]], anchor[a] - a, np.searchsorted(rows, a, "right") - 1


def segments(data: np.ndarray, rows: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets of rows, bytes before): a very long text in parts that share ``length`` - 1 bytes."""
    if len(data) <= 2 * SEGMENT:
        yield data, rows, 0
        return
    for row in range(len(rows) - 1):  # long texts come one at a time
        for at in range(int(rows[row]), max(int(rows[row]) + 1, int(rows[row + 1]) - length + 1), SEGMENT):
            to = min(int(rows[row + 1]), at + SEGMENT + length - 1)
            yield data[at:to], np.concatenate([np.zeros(row + 1, np.int64), np.full(len(rows) - 1 - row, to - at)]), at - int(rows[row])


class Extensions:
    """Common extensions of places of an array, by hashes and then by bytes."""

    def __init__(self, data: np.ndarray):
        self.raw = data.tobytes()
        self.sums = PrefixHash(data).sums.tolist()
        self.power: list[int] = [1]

    def _same(self, i: int, j: int, n: int) -> bool:
        """Whether n bytes at i and at j > i hash alike."""
        s = self.sums
        while len(self.power) <= j - i:
            self.power.append(self.power[-1] * _BASE & _ALL)
        return (s[i + n] - s[i]) * self.power[j - i] & _ALL == (s[j + n] - s[j]) & _ALL

    def common(self, i: int, j: int, most: int) -> int:
        """How many bytes from i and j on agree, up to ``most``."""
        if i > j:
            i, j = j, i
        low, high = 0, most
        while low < high:
            n = (low + high + 1) // 2
            if self._same(i, j, n):
                low = n
            else:
                high = n - 1
        if self.raw[i : i + low] != self.raw[j : j + low]:  # a collision: compare bytes
            low = next(k for k in range(most) if self.raw[i + k] != self.raw[j + k])
        return low


def sorted_runs(ext: Extensions, group: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes within groups, and the common extension with the one before."""
    begins, sizes = begin.tolist(), size.tolist()

    def compare(x: int, y: int) -> int:
        most = min(sizes[x], sizes[y])
        n = ext.common(begins[x], begins[y], most)
        if n == most:
            return sizes[x] - sizes[y]
        return ext.raw[begins[x] + n] - ext.raw[begins[y] + n]

    order, lcp = [], []
    bounds = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    for a, z in zip(bounds, [*bounds[1:], len(group)], strict=True):
        own = sorted(range(a, z), key=cmp_to_key(compare))  # a merge sort
        order += own
        lcp.append(0)
        lcp += [ext.common(begins[x], begins[y], min(sizes[x], sizes[y])) for x, y in zip(own, own[1:], strict=False)]
    return np.array(order, np.int64), np.array(lcp, np.int64)


def repeated_windows(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """(string, distance before the anchor): which windows another string has, too.

    The strings are distinct and sorted by group.
    """
    n, sizes = len(group), np.diff(offsets)
    ahead, behind = sizes - anchor, anchor
    right, right_lcp = sorted_runs(Extensions(data), group, offsets[:-1] + anchor, ahead)
    left, left_lcp = sorted_runs(Extensions(data[::-1].copy()), group, len(data) - (offsets[:-1] + anchor), behind)
    farthest, nearest = anchor, anchor - (sizes - length)
    found = np.zeros((n, length), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for r in range(int(nearest.min()), int(farthest.max()) + 1):
        own = np.flatnonzero((nearest <= r) & (r <= farthest))
        if len(own) < 2:
            continue
        right_class[right] = np.cumsum(right_lcp < length - r)
        left_class[left] = np.cumsum(left_lcp < r) if r else np.cumsum(np.diff(group[left], prepend=-1) != 0)
        pair = right_class[own] * (n + 1) + left_class[own]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        found[own[order][1:][same], r] = True
        found[own[order][:-1][same], r] = True
    return found


def repeats(strings: Strings, length: int, chunk: int = 2 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) of every repeated stretch of every occurrence."""
    n, sizes = len(strings.offsets) - 1, np.diff(strings.offsets)
    times = np.bincount(strings.code, minlength=n)
    whole = np.flatnonzero(times > 1)
    of, low, high = [whole], [np.zeros(len(whole), np.int64)], [sizes[whole]]
    order = np.argsort(strings.tags, kind="stable")
    tag = strings.tags[order]
    shared = np.concatenate([[False], tag[1:] == tag[:-1]])
    shared |= np.concatenate([shared[1:], [False]])
    order = order[shared]
    begins = np.flatnonzero(np.concatenate([[True], strings.tags[order][1:] != strings.tags[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    weight = np.concatenate([[0], np.cumsum(sizes[order])])
    at = 0
    while at < len(begins):  # whole groups, of about ``chunk`` bytes
        to = max(at + 1, int(np.searchsorted(weight[begins], weight[begins[at]] + chunk, "right")) - 1)
        to = len(begins) if to >= len(begins) - 1 and weight[-1] - weight[begins[at]] <= chunk else to
        part = order[begins[at] : begins[to] if to < len(begins) else len(order)]
        at = to
        if not (times[part] == 1).any():
            continue
        data, offsets = gather(strings.data, strings.offsets[part], strings.offsets[part + 1])
        group = np.unique(strings.tags[part], return_inverse=True)[1]
        found = repeated_windows(data, offsets, group, strings.marks[part], length)
        string, r = np.nonzero(found & (times[part] == 1)[:, None])
        start = strings.marks[part][string] - r
        order_ = np.lexsort((start, string))
        string, start = string[order_], start[order_]
        new = np.ones(len(string), bool)
        new[1:] = (np.diff(string) != 0) | (np.diff(start) != 1)
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(string) - 1]]) if len(string) else np.zeros(0, np.int64)
        of.append(part[string[new]])
        low.append(start[new])
        high.append(start[last] + length)
    return placed(strings, np.concatenate(of), np.concatenate(low), np.concatenate(high))


def placed(strings: Strings, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) in documents of stretches within strings, for every occurrence."""
    by = np.argsort(which, kind="stable")
    which, low, high = which[by], low[by], high[by]
    a, z = np.searchsorted(which, strings.code, "left"), np.searchsorted(which, strings.code, "right")
    at, _ = gather(np.arange(len(which)), a, z)
    who = np.repeat(np.arange(len(strings.code)), z - a)
    return strings.key[who], strings.place[who] + low[at], strings.place[who] + high[at]


@dataclass
class Windows:
    """The distinct strings of ``length`` bytes of a part, how often each occurs, and where."""

    pair: np.ndarray
    times: np.ndarray
    which: np.ndarray  #: of each place: the string of the part, its offset there, and the distinct one
    at: np.ndarray
    code: np.ndarray


def hashed_windows(strings: Strings, length: int) -> Windows:
    n = len(strings.offsets) - 1
    base, ends = strings.offsets[:-1], strings.offsets[1:] - length + 1
    start, cuts = gather(np.arange(len(strings.data)), base, ends)
    which = np.repeat(np.arange(n), np.diff(cuts))
    pair = np.empty(len(start), _PAIR)
    pair["a"] = mixed(PrefixHash(strings.data).of(start, start + length))
    pair["b"] = mixed(PrefixHash(_OTHER[strings.data]).of(start, start + length))
    order = np.lexsort((pair["b"], pair["a"]))
    new = np.ones(len(order), bool)
    new[1:] = pair[order][1:] != pair[order][:-1]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    weight = np.bincount(strings.code, minlength=n)[which]
    return Windows(pair[order][new], np.bincount(code, weight, minlength=int(new.sum())).astype(np.int64), which, start - base[which], code)


def found_elsewhere(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of each part's hashes with their counts, those that occur once there and again in another part."""
    pairs, times = np.concatenate([p for p, _ in parts]), np.concatenate([t for _, t in parts])
    order = np.lexsort((pairs["b"], pairs["a"]))
    new = np.ones(len(order), bool)
    new[1:] = pairs[order][1:] != pairs[order][:-1]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    again = (times == 1) & (np.bincount(code, times)[code] > 1)
    cuts = np.cumsum([0, *(len(p) for p, _ in parts)])
    return [p[again[a:z]] for (p, _), a, z in zip(parts, cuts[:-1], cuts[1:], strict=True)]


def part_repeats(strings: Strings, windows: Windows, others: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) of the repeated stretches of a part's occurrences."""
    gone = ((windows.times > 1) | np.isin(windows.pair, others))[windows.code]
    which, at = windows.which[gone], windows.at[gone]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(which) != 0) | (np.diff(at) != 1)
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]]) if len(at) else np.zeros(0, np.int64)
    return placed(strings, which[new], at[new], at[last] + length)


def suffix_dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): texts without bytes that repeat.

    ``kept`` is binary: what remains may begin inside a character.
    """
    docs = keyed(docs)
    buckets, known = bucket_count(docs), known_text(docs)

    def tags_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for data, rows, _ in segments(*byte_view(column(batch, "text")), length):
            yield mixed(anchored_strings(data, rows, length)[2])

    hot, sizes = crowded(docs, tags_of, buckets, CROWD)
    parts = -(-sizes // PART)
    slots = max(1, int(sizes.sum()) * length // SLOT)

    def strings_of(batch: pa.RecordBatch, crowds: bool) -> Iterator[tuple[int, bytes]]:
        ids, keys = numbers(column(batch, "doc_id"), MOST), numbers(column(batch, "_key"), 0)
        for data, rows, before in segments(*byte_view(column(batch, "text")), length):
            a, z, tags, marks, row = anchored_strings(data, rows, length)
            tags, place = mixed(tags), a - rows[row] + before
            own = np.flatnonzero(among(tags, buckets, hot) == crowds)
            yield from pack_buckets(data, a[own], z[own], tags[own], marks[own], row[own], place[own], ids, keys, buckets, known=known)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 3 << 20):
                yield blob_rows(strings_of(batch, False), "bucket")

    def sort(table: pa.Table) -> pa.Table:
        found = repeats(unpack_bucket(blobs_of(table), known), length)
        trim()
        return pa.Table.from_batches([blob_rows(pack_ranges(*found, buckets), "block")])

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        texts = unpacked_texts(left, known)
        row, a, b = row_ranges(numbers(left.column("_key"), 0), blobs_of(right))
        bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        for i, text in enumerate(texts):
            begins, ends = union_ranges(a[bounds[i] : bounds[i + 1]], b[bounds[i] : bounds[i + 1]])
            at, parts = 0, []
            for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
                parts.append(text[at:x])
                at = y
            parts.append(text[at:])
            out["n_bytes"].append(len(text))
            out["kept"].append(b"".join(parts))
            out["n_removed"].append(len(text) - len(out["kept"][-1]))
            out["n_spans"].append(len(begins))
        return pa.table({"doc_id": left.column("doc_id"), **{k: pa.array(v, pa.int64() if k != "kept" else pa.binary()) for k, v in out.items()}})

    def split_crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 3 << 20):
                found = blob_rows(strings_of(batch, True), "bucket")
                turn = int(numbers(column(batch, "_key"), 0)[0])  # alike if the task runs again
                part = turn % parts[np.searchsorted(hot, found.column(0).to_numpy())]
                yield pa.RecordBatch.from_arrays([found.column(0), pa.array(part), found.column(1)], names=["bucket", "part", "blob"])

    def name(table: pa.Table) -> pa.Table:
        windows = hashed_windows(unpack_bucket(blobs_of(table), known), length)
        trim()
        slot = (windows.pair["a"] % np.uint64(slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        cuts = np.searchsorted(slot[order], np.arange(slots + 1))
        used = np.flatnonzero(np.diff(cuts))
        blobs = [pack(windows.pair[order[cuts[i] : cuts[i + 1]]].view(np.uint64), windows.times[order[cuts[i] : cuts[i + 1]]]) for i in used.tolist()]
        place = [pa.array(np.full(len(used), table.column(c)[0].as_py(), np.int64)) for c in ("bucket", "part")]
        return pa.table([pa.array(used.astype(np.int64)), *place, pa.array(blobs, pa.binary())], names=["slot", "bucket", "part", "blob"])

    def total(table: pa.Table) -> pa.Table:
        held = [unpack(b, np.uint64, np.int64) for b in blobs_of(table)]
        back = found_elsewhere([(pair.view(_PAIR), times) for pair, times in held])
        trim()
        some = pa.array([i for i, pair in enumerate(back) if len(pair)], pa.int64())
        return pa.table([table.column("bucket").take(some), table.column("part").take(some), pa.array([pack(back[i].view(np.uint64)) for i in some.to_pylist()], pa.binary())], names=["bucket", "part", "blob"])

    def sort_part(left: pa.Table, right: pa.Table) -> pa.Table:
        strings = unpack_bucket(blobs_of(left), known)
        others = [unpack(b, np.uint64)[0].view(_PAIR) for b in blobs_of(right)]
        found = part_repeats(strings, hashed_windows(strings, length), np.concatenate([np.zeros(0, _PAIR), *others]), length)
        trim()
        return pa.Table.from_batches([blob_rows(pack_ranges(*found, buckets), "block")])

    def in_parts() -> DataFrame:
        crowds = materialize(docs.mapInArrow(split_crowds, "bucket long, part long, blob binary"), "crowds")
        named = crowds.groupBy("bucket", "part").applyInArrow(name, "slot long, bucket long, part long, blob binary")
        back = named.groupBy("slot").applyInArrow(total, "bucket long, part long, blob binary")
        return crowds.groupBy("bucket", "part").cogroup(back.groupBy("bucket", "part")).applyInArrow(sort_part, "block long, blob binary")

    packed = docs.mapInArrow(split, "bucket long, blob binary")
    ranges = packed.groupBy("bucket").applyInArrow(sort, "block long, blob binary")
    if len(hot):
        ranges = ranges.unionAll(in_parts())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_blocks(docs, buckets, known).groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(keep, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def brute_force(documents: list[tuple[object, str | None]], length: int = 400) -> list[tuple[object, int, int, int, bytes]]:
    """The contract byte by byte, for tests on small tables."""
    seen: dict[bytes, int] = {}
    raws = [(d, (t or "").encode()) for d, t in documents]
    for _, raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        spans = int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(raw) else 0
        out.append((d, len(raw), int(mask.sum()), spans, np.frombuffer(raw, np.uint8)[~mask].tobytes()))
    return out
