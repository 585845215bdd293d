"""Connected components: local forests, pointer jumping, and few shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.session import materialize, ship, shuffle_partitions

#: Links, of two keys each, that one task may hold at a time.
TASK_LINKS = 1_000_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b", task_links: int = TASK_LINKS) -> DataFrame:
    """``(node, component)`` for every endpoint of the undirected ``links``.

    ``component`` is the smallest node reachable. Links are dealt by their larger node;
    each task replaces its links by a forest of stars around smallest nodes, and a join
    then points nodes at their parents' parents. A star's centre has no parent, so a
    finished star, however large, gathers nowhere. The rounds end when nothing changes;
    what remains of at most ``task_links`` links is finished by one task. Null endpoints,
    self links and repeated links have no effect; no links give an empty result.
    """
    ship(links.sparkSession)
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    parts, before = shuffle_partitions(links.sparkSession), None
    while True:
        sums = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        now = edges.agg(F.count("*"), sums).first()
        if now[0] <= task_links:
            edges = materialize(_forest(edges.coalesce(1)), "edges")
            break
        if now == before:
            break
        before = now
        stars = materialize(_forest(edges.repartition(parts, "u")), "stars")
        parents = stars.select(F.col("u").alias("v"), F.col("v").alias("w"))
        edges = materialize(stars.join(parents, "v", "left").select("u", F.coalesce("w", "v").alias("v")).distinct(), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _forest(edges: DataFrame) -> DataFrame:
    """The links of each partition as stars (node, smallest node of its tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in batches if x.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        kind = table.schema.field("u").type
        names = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks]).combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        order = np.argsort(np.argsort(np.array(names.dictionary.to_pylist(), dtype=object), kind="stable"), kind="stable") if not pa.types.is_integer(kind) else np.argsort(np.argsort(names.dictionary.to_numpy()))
        rank = order[names.indices.to_numpy()]
        sorted_names = names.dictionary.take(pa.array(np.argsort(order)))
        n = len(rank) // 2
        parent = list(range(len(order)))
        for x, y in zip(rank[:n].tolist(), rank[n:].tolist(), strict=True):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
        for x in range(len(parent)):  # a parent is never larger, so it is final already
            parent[x] = parent[parent[x]]
        own = np.array(parent)
        moved = np.flatnonzero(own != np.arange(len(own)))
        for at in range(0, len(moved), 100_000):
            part = moved[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([sorted_names.take(pa.array(part)).cast(kind), sorted_names.take(pa.array(own[part])).cast(kind)], names=["u", "v"])

    return edges.mapInArrow(run, edges.schema)
