"""Dedup operators against brute force on small adversarial tables."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import decontaminate, neardup, packing, substring, suffixes
from corpusloom.llm.arrays import PrefixHash, byte_view, sliding_min, union_ranges, words_of

R = np.random.default_rng(4)
WORDS = ["the", "of", "anea", "from", "in", "élan", "日本", "x" * 30, "b", "and"]


def prose(n, words=WORDS):
    return " ".join(R.choice(words, n))


@cache
def table():
    a, b, passage = prose(300, [f"w{i}" for i in range(90)]), prose(200), prose(60, [f"p{i}" for i in range(200)])
    near = a.split()
    near[150] = "other"
    texts = [a, a, " ".join(near), b, None, "", "  \t\n", "one two three", "one  TWO three", passage + " " + prose(50), prose(20) + " " + passage, "from " * 400, "a" * 1500, "a" * 1500 + "b", prose(9), a + " " + a, "　ideographic　space " * 30, passage]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = table()
    return spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id long, text string, block string, _key int, kept string").repartition(3)


def test_substring(docs):
    want = substring.brute_force(table())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.substring_dedup(docs).collect()}
    assert got == want


def test_suffixes(docs):
    want = {r[0]: r[1:] for r in suffixes.brute_force(table())}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.suffix_dedup(docs).collect()}
    assert got == want


@pytest.mark.parametrize("segment", [40, 700])
def test_segments(monkeypatch, segment):
    """Texts longer than a segment are cut, and every window lies in exactly one part."""
    long = prose(400, [f"w{i}" for i in range(60)])
    texts = [long, "x " + long[300:1500] + " y", "", None, long[5:] * 2, "z" * 900]
    for module in (suffixes, substring):
        monkeypatch.setattr(module, "SEGMENT", segment)
        assert len(list(module.segments(*byte_view(pa.array([long])), 13))) > 1
    for text in texts:
        data, rows = byte_view(pa.array([text], pa.string()))
        for length in (60, 400):
            starts = set()
            for part, own, before in suffixes.segments(data, rows, length):
                a, z, *_ = suffixes.anchored_strings(part, own, length)
                for x, y in zip(a.tolist(), z.tolist(), strict=True):
                    here = set(range(x + before, y + before - length + 1))
                    assert not here & starts and part[x:y].tobytes() == data[x + before : y + before].tobytes()
                    starts |= here
            assert starts == set(range(max(0, len(data) - length + 1)))
        words, seen = bytes(data).split(), set()
        for part, own, before in substring.segments(data, rows, 13):
            joined, a, z, _, _, place = substring.super_kmers(part, own, 13)
            for x, y, k in zip(a.tolist(), z.tolist(), place.tolist(), strict=True):
                own_words = joined[x:y].tobytes().split()
                assert own_words == words[k + before : k + before + len(own_words)]
                here = set(range(k + before, k + before + len(own_words) - 12))
                assert not here & seen
                seen |= here
        assert seen == set(range(max(0, len(words) - 12)))


def test_anchors_are_alike():
    """Equal windows choose equal places, however many hashes stand around them, ties included."""
    for data in (np.array([5, 5, 5, 5, 9, 5, 5], np.uint64) << np.uint64(40), R.integers(0, 4, 300).astype(np.uint64) << np.uint64(30)):
        alone = packing.anchors(data, 3)
        for pad in (1, 1000, 70_000):
            assert (packing.anchors(np.concatenate([np.arange(pad, dtype=np.uint64) << np.uint64(50), data]), 3)[pad:] - pad == alone).all()


def test_known_text_changes_nothing():
    parts = [np.arange(50), np.frombuffer(b"some text that the dictionary has" * 4, np.uint8)]
    for known in (b"", b"short", b"some text that the dictionary has, and more" * 20):
        back = packing.unpack(packing.pack(*parts, known=known), np.int64, np.uint8, known=known)
        assert all((x == y).all() for x, y in zip(parts, back, strict=True))


def test_boilerplate_everywhere(spark):
    """One passage in every row, as the first place of many others: nothing is lost."""
    line = prose(80, [f"b{i}" for i in range(300)])
    rows = [(i, f"{prose(12)} {line} {prose(12)}" if i % 3 else f"{line} {line}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = substring.brute_force(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.substring_dedup(df).collect()} == want
    want = {r[0]: r[1:] for r in suffixes.brute_force(rows)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.suffix_dedup(df).collect()} == want


@pytest.mark.parametrize(("crowd", "part"), [(0, 3), (20, 8), (200, 1 << 14)])
def test_crowded_buckets(spark, docs, monkeypatch, crowd, part):
    """Buckets that go in parts give what whole ones give."""
    for module in (substring, suffixes):
        monkeypatch.setattr(module, "CROWD", crowd)
        monkeypatch.setattr(module, "PART", part)
    monkeypatch.setattr(suffixes, "SLOT", 1 << 12)
    line = prose(80, [f"c{i}" for i in range(300)])
    rows = [(i, f"{prose(12)} {line} {prose(12)}" if i % 3 else f"{line} {line}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for own, given in ((docs, table()), (df, rows)):
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.substring_dedup(own).collect()} == substring.brute_force(given)
        want = {r[0]: r[1:] for r in suffixes.brute_force(given)}
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.suffix_dedup(own).collect()} == want


def test_near_duplicates(docs):
    want = neardup.brute_force(table())
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == want


def test_dense_group(spark):
    """A hundred edited copies, their exact copies, and a document linked to one of them only."""
    base = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(100):
        own = list(base)
        for k in range(3):
            own[(7 * i + 131 * k) % 400] = f"e{i}_{k}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own))]
    edge = rows[0][1].split()
    for k in range(0, 24, 4):
        edge[k] = f"z{k}"
    rows += [(1000, " ".join(edge)), (1001, "far " + " ".join(f"q{i}" for i in range(50)))]
    want = neardup.brute_force(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()} == want


def test_more_partitions_than_rows(spark):
    """Pairs of near-duplicates, in far more partitions than there are rows."""
    rows = []
    for i in range(4):
        own = [f"w{i}_{k}" for k in range(300)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:-1], "other"]))]
    want = neardup.brute_force(rows)
    assert sum(not kept for _, _, kept in want.values()) == 4
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_star(spark):
    """Three hundred copies that are near one original only, and not near each other."""
    base = [f"s{i}" for i in range(400)]
    rows = [(5000, " ".join(base))]
    for i in range(300):
        own, rng = list(base), np.random.default_rng(i)
        start = int(rng.integers(0, 35))
        for k in range(6):
            own[start + 60 * k + int(rng.integers(0, 20))] = f"e{i}_{k}"
        rows.append((i, " ".join(own)))
    want = neardup.brute_force(rows)
    assert sum(c == 0 for _, c, _ in want.values()) > 250
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()} == want


def crowd(n, places, values, edits, seed):
    """Documents of one text with a few edits each, from few places and values: a dense region."""
    r, base, rows = np.random.default_rng(seed), [f"w{i}" for i in range(300)], []
    where = r.choice(300, places, replace=False)
    for i in range(n):
        own = list(base)
        for at in r.choice(where, edits, replace=False):
            own[at] = f"e{at}_{r.integers(values)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("n, places, values, edits, partitions", [(400, 58, 20, 3, 3), (400, 58, 20, 3, 50), (500, 90, 6, 4, 3), (500, 200, 30, 5, 7)])
def test_crowds(spark, n, places, values, edits, partitions):
    """Every link between components is found in regions of hundreds of similar documents."""
    rows = crowd(n, places, values, edits, n + places)
    want = neardup.brute_force(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring.substring_dedup(none).count() == suffixes.suffix_dedup(none).count() == neardup.near_duplicates(none).count() == 0
    text = prose(500, [f"w{i}" for i in range(80)])
    odd = spark.createDataFrame([(None, text), (5, text), (5, text)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in substring.substring_dedup(odd).collect()) == [(-1, 500), (5, 0), (5, 0)]
    assert all(r.n_removed == r.n_bytes for r in suffixes.suffix_dedup(odd).collect())
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(odd).collect()) == [(-1, -1, True), (5, 5, True), (5, 5, True)]


def bench_tables():
    items = [(1, prose(25, [f"q{i}" for i in range(99)])), (2, "Short item, here"), (10, None), (11, "..."), (3, prose(12, ["a", "b"])), (4, "Über x1 Straße"), (None, "nameless item"), (None, "short item here")]
    long = items[0][1].split()
    texts = [items[0][1], " ".join(long[:10]) + " stop " + " ".join(long[3:14]), "no SHORT item--here", None, "", "!!", items[4][1] * 3, "übER x1 straße Über X1 straße", " ".join(long[:9]), "é" + items[0][1], "a nameless item"]
    return items, [*enumerate(texts), (0, texts[0]), (0, texts[2])]


@pytest.mark.parametrize("block_bytes", [1 << 20, 400, 60])
def test_scan(spark, block_bytes):
    """One automaton, or many blocks, each of which a worker builds once."""
    items, docs = bench_tables()
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in docs], "doc_id long, text string, item_ids string, _row int, _found string")
    found = decontaminate.scan(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = sorted(tuple(r) for r in decontaminate.digest(found).collect())
    assert got == sorted(decontaminate.brute_force(docs, items))
    spans = {r.doc_id: [docs[r.doc_id][1][s.start : s.end] for s in r.spans] for r in found.collect() if r.doc_id}
    assert spans[2] == ["SHORT item--here"] * 2 and spans[9] == [items[0][1].split(" ", 1)[1]] and spans[10] == ["nameless item"]


def test_scan_nothing(spark):
    _, docs = bench_tables()
    df, nothing = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(df, nothing).where("n_hit > 0").count() == 0
    assert decontaminate.scan(df.limit(0), nothing).count() == 0


def test_one_automaton_a_worker():
    """Texts of a block never build its automaton again; another block's takes its place."""
    class Shared:
        def __init__(self, name):
            self.value = [(name, "i")]

    first = decontaminate._automaton("x", Shared(b"a"))
    assert all(decontaminate._automaton("x", Shared(b"a")) is first for _ in range(100))
    decontaminate._automaton("y", Shared(b"b"))
    assert len(decontaminate._built) == 1


def test_array_helpers():
    data, rows = byte_view(pa.array(["a  bc", None, "", "d e"]).slice(0, 4))
    starts, ends, first = words_of(data, rows)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"a", b"bc", b"d", b"e"] and first.tolist() == [0, 2, 2, 2, 4]
    x = np.frombuffer(b"abcabcab", np.uint8)
    h = PrefixHash(x)
    assert h.of(np.array([0]), np.array([3]))[0] == h.of(np.array([3]), np.array([6]))[0] and (h.every(3) == h.of(np.arange(6), np.arange(6) + 3))[:5].all()
    y = R.integers(0, 50, 40)
    assert all((sliding_min(y, w) == [y[i : i + w].min() for i in range(40 - w + 1)]).all() for w in (1, 2, 3, 7, 40))
    a, b = union_ranges(np.array([5, 0, 3, 9]), np.array([7, 2, 5, 12]))
    assert a.tolist() == [0, 3, 9] and b.tolist() == [2, 7, 12]


def test_collisions_change_nothing(monkeypatch):
    """With a hash that always collides, extensions still come from the bytes."""
    ext = suffixes.Extensions(np.frombuffer(b"abcdabceabcd", np.uint8))
    monkeypatch.setattr(ext, "_same", lambda i, j, n: True)
    assert ext.common(0, 4, 4) == 3 and ext.common(0, 8, 4) == 4
