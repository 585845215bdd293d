"""Near-duplicates by an LSH forest of MinHash signatures.

A document is the set of its hashed five-word shingles. Equal sets are one class and
its smallest doc_id stands for it. A signature holds ``TREES`` runs of ``DEPTH``
minimum hashes; each run, a tree, sorts all classes by its values. Classes that share
a long prefix lie side by side, so candidates are

1. neighbours in the order of a few trees that share ``START`` values at least; their
   confirmed links already join what is dense, and only save work, then
2. all pairs of different components in a run, that is, of classes that share the first
   ``START`` values of a tree, in all trees. Runs of more than ``REGION`` classes are cut
   into chunks, and every two chunks of a run meet in a task of their own.

A pair of similarity 0.85 shares 4 values of a tree with probability 0.52, and misses
that in all 16 trees with probability 1e-5. Links are confirmed on the full sets.
Copies never become pairs, and a dense run spreads over tasks.

Edge cases: null or empty text has an empty set and links with nothing; fewer than
five words are one shingle; rows of one doc_id are one document; a row without doc_id
links with nothing, has no component and is kept; texts may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from corpusloom.llm.arrays import SPACES, PrefixHash, byte_view, column, gather, gram_hashes, lower_ascii, map_text, mixed, trim, words_of
from corpusloom.operators.components import connected_components
from corpusloom.plans.session import Scratch, materialize, scratch, shuffle_partitions

SHINGLE = 5
TREES, DEPTH, START = 16, 8, 4
FIRST_TREES = 2
REGION = 32
#: Shingles, and as many as ``CHUNK_ROW`` more a class, of a chunk of a longer run.
CHUNK, CHUNK_ROW = 200_000, 64
_MULTIPLIERS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted within the row, and their offsets."""
    data = lower_ascii(data)
    starts, ends, first = words_of(data, rows, SPACES)
    words = mixed(PrefixHash(data).of(starts, ends))
    sizes = np.diff(first)
    grams = gram_hashes(words, SHINGLE)
    at, _ = gather(np.arange(len(words)), first[:-1], np.maximum(first[:-1], first[1:] - SHINGLE + 1))
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - SHINGLE + 1, 0))
    hashes = grams[at]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        whole = np.array([hash_of_few(words[first[i] : first[i + 1]]) for i in short], np.uint64)
        row, hashes = np.concatenate([row, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[new], hashes[new]
    return hashes, np.searchsorted(row, np.arange(len(sizes) + 1))


def hash_of_few(words: np.ndarray) -> np.uint64:
    return gram_hashes(words, len(words))[0] ^ np.uint64(len(words))


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(row, tree x depth) minimum hashes of rows with a set that is not empty."""
    begins = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(begins), TREES * DEPTH), np.uint32)
    if len(begins):
        for i, m in enumerate(_MULTIPLIERS):
            out[:, i] = np.minimum.reduceat(((hashes * m) >> np.uint64(32)).astype(np.uint32), begins)
    return out


SET_FIELDS = [StructField("n_shingles", LongType()), StructField("set_key", BinaryType()), StructField("signature", BinaryType())]


def _sets(batch: pa.RecordBatch) -> dict[str, object]:
    hashes, offsets = shingle_sets(*byte_view(column(batch, "text")))
    sizes = np.diff(offsets)
    values = iter(signatures(hashes, offsets).astype(">u4"))
    keys = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return {"n_shingles": sizes, "set_key": keys, "signature": [next(values).tobytes() if n else None for n in sizes.tolist()]}


def forest_order(classes: DataFrame, trees: int) -> DataFrame:
    """(tree, values, node, n) of every class and tree, in the trees' orders."""
    size = 4 * DEPTH
    parts = F.array(*(F.struct(F.lit(t).alias("tree"), F.substring("signature", 1 + size * t, size).alias("values")) for t in range(trees)))
    rows = classes.select(F.explode(parts).alias("r"), "node", "n").select("r.tree", "r.values", "node", "n")
    return rows.repartitionByRange(shuffle_partitions(classes.sparkSession), "tree", "values", "node").sortWithinPartitions("tree", "values", "node")


def candidates(tree: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of neighbours in order that share ``START`` values."""
    same = (tree[1:] == tree[:-1]) & (values[1:, :START] == values[:-1, :START]).all(1)
    left = np.flatnonzero(same)
    return left, left + 1


def candidate_pairs(classes: DataFrame, trees: int) -> DataFrame:
    """Distinct (a, b) of neighbouring classes, of sizes that allow a link.

    Neighbours on two sides of a partition's edge do not meet; see ``run_links``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in batches if x.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        data, _ = byte_view(table.column("values").chunk(0))
        values = data.reshape(-1, 4 * DEPTH).view(">u4")
        number = lambda c: table.column(c).to_numpy()
        node, size = number("node"), number("n")
        a, b = candidates(number("tree"), values)
        fits = 100 * np.minimum(size[a], size[b]) >= 85 * np.maximum(size[a], size[b])
        pairs = np.unique(np.stack([np.minimum(node[a], node[b])[fits], np.maximum(node[a], node[b])[fits]], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        for at in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 50_000, i]) for i in range(2)], names=["a", "b"])

    return forest_order(classes, trees).mapInArrow(run, "a long, b long").distinct()


def run_keys() -> Column:
    """Of every tree, a number for its first ``START`` values.

    Runs whose numbers collide are one run, whose pairs are confirmed as all others.
    """
    return F.array(*(F.xxhash64(F.lit(t), F.substring("signature", 1 + 4 * DEPTH * t, 4 * START)) for t in range(TREES)))


def neighboured(classes: DataFrame) -> DataFrame:
    """(id) of the classes that share ``START`` values of some tree with another."""
    keys = classes.select(F.explode(run_keys()).alias("key"), "node")
    runs = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    return keys.join(runs, "key", "left_semi").select(F.col("node").alias("id")).distinct()


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, packed): compressed texts of the documents named by ``ids``."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        c = zstandard.ZstdCompressor(level=3)
        return {"packed": [c.compress(x or b"") for x in column(batch, "text").cast(pa.binary()).to_pylist()]}

    packed = map_text(docs, ["doc_id"], [StructField("packed", BinaryType())], work)
    return packed.select(F.col("doc_id").alias("id"), "packed").join(ids, "id", "left_semi")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= 85 * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                a, b = column(batch, "a").to_numpy(), column(batch, "b").to_numpy()
                texts: dict[bytes, int] = {}
                x, y = ([texts.setdefault(t, len(texts)) for t in column(batch, c).to_pylist()] for c in ("text_a", "text_b"))
                raws = [d.decompress(t) for t in texts]
                data = np.frombuffer(b"".join(raws), np.uint8)
                hashes, offsets = shingle_sets(data, np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64))
                sets = [hashes[p:q] for p, q in zip(offsets[:-1], offsets[1:], strict=True)]
                keep = np.array([linked(sets[i], sets[j]) for i, j in zip(x, y, strict=True)], bool)
                del raws, data, hashes, sets, texts
                trim()
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("text_a")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("packed").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sorted sets are similar enough; empty sets never are."""
    if not len(a) or not len(b):
        return False
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * shared >= 85 * (len(a) + len(b) - shared)


def run_links(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that join all components between which a run has a link.

    ``classes`` has node, n, signature and component. Every pair of different components
    in a run is confirmed or refused, or its components are joined by other links.
    """
    keyed = materialize(classes.select("node", "n", "component", run_keys().alias("keys")), "keyed")
    rows = keyed.select(F.explode("keys").alias("key"), "node", "n", "component")
    runs = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_rows = materialize(rows.join(runs.select("key", "m"), "key"), "runs")
    x, y = (open_rows.where(F.col("m") <= REGION).select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "component"))) for s in "xy")
    fits = 100 * F.least("n_x", "n_y") >= 85 * F.greatest("n_x", "n_y")
    met = x.join(y, "key").where((F.col("node_x") < F.col("node_y")) & (F.col("component_x") != F.col("component_y")) & fits)
    short = confirmed(met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct(), texts)

    # by component first, so that chunks of one component need not meet
    by = Window.partitionBy("key").orderBy("component", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    longer = open_rows.where(F.col("m") > REGION).groupBy("key", "node").agg(F.max("n").alias("n"), F.min("component").alias("component"))
    chunk = F.floor(F.sum(F.col("n") + CHUNK_ROW).over(by) / CHUNK)
    placed = materialize(longer.select("key", "node", "component", chunk.alias("chunk")), "chunks")
    if placed.isEmpty():
        return short
    ends = placed.groupBy("key", "chunk").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    p, q = (ends.select("key", F.col("chunk").alias(c), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}")) for c in ("i", "j"))
    meetings = p.join(q, "key").where((F.col("i") <= F.col("j")) & (F.least("lo_i", "lo_j") < F.greatest("hi_i", "hi_j")))
    sent = meetings.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk")).join(placed, ["key", "chunk"])
    full = sent.join(keyed.select("node", "keys"), "node").join(texts.withColumnRenamed("id", "node"), "node")
    return short.unionByName(full.groupBy("key", "i", "j").applyInArrow(meeting_links, "a long, b long"))


def meeting_links(table: pa.Table) -> pa.Table:
    """Links between two chunks of a run, or within one; each joins two components.

    A pair that shares several runs is left to that of the smallest key.
    """
    table = table.sort_by("chunk").combine_chunks()
    number = lambda c: table.column(c).to_numpy()
    key, chunk, node = number("key")[0], number("chunk"), number("node")
    _, label = np.unique(number("component"), return_inverse=True)
    keys = np.array(table.column("keys").to_pylist(), np.int64)
    d = zstandard.ZstdDecompressor()
    raws = [d.decompress(t) for t in table.column("packed").to_pylist()]
    hashes, offsets = shingle_sets(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64))
    values, ids = np.unique(hashes, return_inverse=True)
    sizes, marked = np.diff(offsets), np.zeros(len(values), bool)
    n, second = len(node), int(np.searchsorted(chunk, chunk[-1]))
    within = second == 0
    left, right = [], []
    for a in range(n if within else second):
        low = a + 1 if within else second
        b = low + np.flatnonzero((label[low:] != label[a]) & (100 * np.minimum(sizes[low:], sizes[a]) >= 85 * np.maximum(sizes[low:], sizes[a])))
        b = b[(np.where(keys[b] == keys[a], keys[b], np.iinfo(np.int64).max).min(1) == key) & (sizes[b] > 0)]
        if not len(b) or not sizes[a]:
            continue
        marked[ids[offsets[a] : offsets[a + 1]]] = True
        at, ends = gather(ids, offsets[b], offsets[b + 1])
        shared = np.add.reduceat(marked[at], ends[:-1], dtype=np.int64)
        marked[ids[offsets[a] : offsets[a + 1]]] = False
        b = b[100 * shared >= 85 * (sizes[a] + sizes[b] - shared)]
        joined, one = np.unique(label[b], return_index=True)
        left += [node[a]] * len(one)
        right += node[b[one]].tolist()
        label[np.isin(label, joined)] = label[a]
    del raws, hashes, values, ids, marked
    trim()
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    with scratch(docs.sparkSession) as own:
        return _near_duplicates(docs, own)


def _near_duplicates(docs: DataFrame, own: Scratch) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = own.keep(materialize(map_text(plain, ["doc_id"], SET_FIELDS, _sets), "sets"))
    linkable = sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    owners = materialize(linkable.groupBy("set_key").agg(F.min("doc_id").alias("node")), "owners")
    named = linkable.withColumn("node", F.col("doc_id")).join(owners, ["set_key", "node"]).select("node", F.col("n_shingles").alias("n"), "signature")
    classes = materialize(named.dropDuplicates(["node", "signature"]), "classes")

    near = materialize(neighboured(classes), "near")
    texts = materialize(packed_texts(plain, near), "texts")
    active = classes.join(near.withColumnRenamed("id", "node"), "node", "left_semi")
    links = materialize(confirmed(candidate_pairs(active, FIRST_TREES), texts), "links")
    found = materialize(connected_components(links), "components")
    labelled = active.join(found, "node", "left").select("node", "n", "signature", F.coalesce("component", "node").alias("component"))
    more = materialize(run_links(labelled, texts), "links")
    final = materialize(connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)), "components")

    # written, so that a join with many copies of one set may split them over tasks
    grouped = own.keep(materialize(owners.join(final, "node", "left").select("set_key", F.coalesce("component", "node").alias("component")), "grouped"))
    return (
        sets.select("doc_id", "n_shingles", "set_key")
        .join(grouped, "set_key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def brute_force(documents: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    """The contract pair by pair, for tests on small tables."""
    sets = {}
    for d, text in documents:
        words = (text or "").encode().lower().split()
        sets[d] = {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()
    parent = {d: d for d in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by: dict[tuple, list[int]] = {}
    for d, own in sets.items():
        for s in own:
            by.setdefault(s, []).append(d)
    pairs = {(a, b) for ids in by.values() if len(ids) > 1 for i, a in enumerate(ids) for b in ids[i + 1 :]}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    least: dict[int, int] = {}
    for d in sets:
        least[root(d)] = min(least.get(root(d), d), d)
    return {d: (len(s), least[root(d)], least[root(d)] == d) for d, s in sets.items()}
