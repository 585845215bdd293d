"""Breadth-first queries over edges, for many start addresses at once.

Each level is a join of the frontier with the edges, and each level is written to
shared storage, so neither lineage nor a lost executor makes work repeat.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.session import materialize, ship


def directed(edges: DataFrame, reverse: bool) -> DataFrame:
    """(here, there, relation, authority, origin, reason)."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.select(F.col(a).alias("here"), F.col(b).alias("there"), "relation", "authority", "origin", "reason").where("here <> there")


def traverse(edges: DataFrame, starts: DataFrame, reverse: bool = False, transitive: bool = True, most: int | None = None) -> DataFrame:
    """One row for every address reached from each ``start``: its minimal proving path.

    Of several ways to an address the least (relation, authority, rank of the step
    before, path) wins. The start itself is never a result. ``most`` bounds the depth.
    """
    moves = materialize(directed(edges, reverse).distinct(), "moves")
    frontier = starts.select("start", F.col("start").alias("here"), F.array("start").alias("path"), F.lit(1).cast("long").alias("place")).distinct()
    seen = frontier.select("start", F.col("here").alias("address"))
    levels: list[DataFrame] = []
    level = 1
    limit = 1 if not transitive else most
    while limit is None or level <= limit:
        ways = frontier.join(moves, "here").withColumn("way", F.concat("path", F.array("there")))
        ways = ways.join(seen.withColumnRenamed("address", "there"), ["start", "there"], "left_anti")
        best = ways.groupBy("start", "there").agg(F.min(F.struct("relation", "authority", "place", "way", "origin", F.coalesce("reason", F.lit("")).alias("reason"))).alias("b"))
        by = Window.partitionBy("start").orderBy("b.relation", "b.authority", "there")
        found = materialize(
            best.select("start", F.col("there").alias("address"), "b.relation", "b.authority", "b.origin", F.col("b.reason").alias("reason"), F.col("b.way").alias("path"), F.row_number().over(by).cast("long").alias("place"), F.lit(level).alias("distance")),
            "level",
        )
        if found.isEmpty():
            break
        levels.append(found)
        seen = seen.unionByName(found.select("start", "address"))
        frontier = found.select("start", F.col("address").alias("here"), "path", "place")
        level += 1
    empty = starts.sparkSession.createDataFrame([], "start string, address string, relation string, authority string, origin string, reason string, path array<string>, place bigint, distance int")
    out = empty
    for found in levels:
        out = out.unionByName(found)
    return out.withColumn("direct", F.col("distance") == 1).drop("place")


def traverse_reasons(edges: DataFrame, starts: DataFrame, reverse: bool = False, transitive: bool = True) -> DataFrame:
    """Every distinct (relation, authority, origin, reason, path) at minimal distance.

    Later levels go on from the lexicographically least path of an address.
    """
    moves = materialize(directed(edges, reverse).distinct(), "moves")
    frontier = starts.select("start", F.col("start").alias("here"), F.array("start").alias("path")).distinct()
    seen = frontier.select("start", F.col("here").alias("address"))
    out: DataFrame | None = None
    level = 1
    while True:
        ways = frontier.join(moves, "here").join(seen.select("start", F.col("address").alias("there")), ["start", "there"], "left_anti")
        rows = ways.select("start", F.col("there").alias("address"), "relation", "authority", "origin", "reason", F.concat("path", F.array("there")).alias("path"), F.lit(level).alias("distance"))
        found = materialize(rows.distinct(), "level")
        out = found if out is None else out.unionByName(found)
        if not transitive or found.isEmpty():
            break
        seen = seen.unionByName(found.select("start", "address").distinct())
        frontier = found.groupBy("start", F.col("address").alias("here")).agg(F.min("path").alias("path"))
        level += 1
    return out.withColumn("direct", F.col("distance") == 1)


def reachable_pairs(edges: DataFrame) -> DataFrame:
    """Transitive closure (a, b), by doubling: the paths' length doubles each round."""
    pairs = materialize(edges.select("a", "b").distinct(), "pairs")
    count = pairs.count()
    while True:
        step = pairs.alias("x").join(pairs.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        pairs = materialize(pairs.unionByName(step).distinct(), "pairs")
        now = pairs.count()
        if now == count:
            return pairs
        count = now


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b) without nodes that have no way in or out, taken off while that takes a tenth.

    All cycles stay; of long ways without cycles some edges may stay, too.
    """
    core, count = edges, edges.count()
    while count:
        ends = core.select(F.col("b").alias("a")).distinct()
        begins = core.select(F.col("a").alias("b")).distinct()
        core = materialize(core.join(ends, "a", "left_semi").join(begins, "b", "left_semi").select("a", "b"), "core")
        now = core.count()
        if 10 * now > 9 * count:
            break
        count = now
    return core


#: Edges of a cyclic core that the driver may take; a larger one stays distributed.
CORE_EDGES = 200_000
#: Edges, of two numbers each, that one task may take at the end.
TASK_EDGES = 20_000_000
#: Edges of a range of nodes, and ranges that become one in the next round.
RANGE_EDGES, RANGES = 200_000, 8


def cycles(edges: DataFrame, by: str = "relation", most: int = CORE_EDGES, range_edges: int = RANGE_EDGES) -> DataFrame:
    """(relation, members): strongly connected sets of several nodes, and self loops.

    ``edges`` has src, dst and ``by``. A graph of at most ``most`` edges, at once or when
    nodes without way in or out are off, is solved on the driver. In a larger one nodes get
    numbers, and ranges of them leave out what they can decide alone (``_reduced``), range by
    larger range; what is left is solved, and the ranges then find their nodes' sets again.
    """
    keyed = edges.select(F.struct(F.col(by).alias("k"), F.col("src").alias("n")).alias("a"), F.struct(F.col(by).alias("k"), F.col("dst").alias("n")).alias("b"))
    core = materialize(keyed.distinct(), "core")
    count = core.count()
    if count > most:
        core = cyclic_core(core)
        count = core.count()
    if count <= most:
        graph: dict[tuple, list[tuple]] = {}
        for r in core.collect():
            graph.setdefault((r.a.k, r.a.n), []).append((r.b.k, r.b.n))
        rows = [(own[0][0], sorted(n for _, n in own)) for own in strong_components(graph)]
        return edges.sparkSession.createDataFrame(rows, f"{by} string, members array<string>")
    ship(edges.sparkSession)
    parts = -(-count // range_edges)
    ends = core.select(F.col("a").alias("x")).unionByName(core.select(F.col("b").alias("x"))).distinct()
    names = materialize(ends.repartitionByRange(parts, "x").sortWithinPartitions("x").withColumn("i", F.monotonically_increasing_id()), "names")
    for end in ("a", "b"):
        core = core.join(names.select(F.col("x").alias(end), F.col("i").alias(f"i{end}")), end).drop(end)
    numbers = materialize(core.select(F.col("ia").alias("a"), F.col("ib").alias("b")), "core")
    labels = materialize(_labels(numbers.where("a <> b"), parts, most), "labels")
    loops = numbers.where("a = b").select("a", F.col("a").alias("m")).join(labels, "a", "left_anti")
    found = labels.unionByName(loops).join(names.withColumnRenamed("i", "a"), "a")
    return found.groupBy("m").agg(F.first("x.k").alias(by), F.sort_array(F.collect_list("x.n")).alias("members")).select(by, "members")


def _range(node: Column, span: int) -> Column:
    """The range of a node's number: the partition that gave it, or ``span`` of them."""
    return F.floor(F.shiftright(node, 33) / span)


def _labels(graph: DataFrame, parts: int, most: int) -> DataFrame:
    """(a, m): nodes on cycles of several nodes, and one node of their strongly connected set."""
    levels: list[tuple[DataFrame, int]] = []
    span, count = 1, graph.count()
    while span < parts and count > most:
        levels.append((graph, span))
        own, other = _range(F.col("a"), span), _range(F.col("b"), span)
        sent = graph.withColumn("part", F.explode(F.array_distinct(F.array(own, other))))
        within = sent.groupBy("part").applyInArrow(_reduction(span), "a long, b long")
        graph = materialize(graph.where(own != other).unionByName(within), "core")
        count, span = graph.count(), span * RANGES
    if count > TASK_EDGES:
        pairs = reachable_pairs(graph)
        mutual = pairs.alias("x").join(pairs.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).where("x.a <> x.b").select(F.col("x.a").alias("a"), F.col("x.b").alias("b"))
        labels = mutual.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    else:
        labels = graph.withColumns({"part": F.lit(0), "known": F.lit(False)}).groupBy("part").applyInArrow(_solved, "a long, m long")
    for graph, span in levels[::-1]:
        part = _range(F.col("a"), span)
        within = graph.where(part == _range(F.col("b"), span)).select(part.alias("part"), "a", "b", F.lit(False).alias("known"))
        known = materialize(labels, "labels").select(part.alias("part"), "a", F.col("m").alias("b"), F.lit(True).alias("known"))
        labels = within.unionByName(known).groupBy("part").applyInArrow(_solved, "a long, m long")
    return labels


def _reduction(span: int) -> Callable[[tuple, pa.Table], pa.Table]:
    return lambda key, rows: _reduced(rows, key[0].as_py(), span)


def _reduced(rows: pa.Table, part: int, span: int) -> pa.Table:
    """Edges between nodes of one range that keep who reaches whom among nodes with edges outside.

    Sets that the range connects strongly become a ring of those of their nodes that have
    edges outside, or one node. Other nodes are passed over where that adds no edges.
    """
    a, b = (rows.column(c).to_numpy() for c in ("a", "b"))
    here, there = (a >> 33) // span == part, (b >> 33) // span == part
    outer = set(a[here & ~there].tolist()) | set(b[there & ~here].tolist())
    nodes, ends = np.unique(np.concatenate([a[here & there], b[here & there]]), return_inverse=True)
    n = len(ends) // 2
    own = strong_labels(len(nodes), ends[:n], ends[n:])
    shown: dict[int, list[int]] = {}
    least: dict[int, int] = {}
    for label, node in zip(own, nodes.tolist(), strict=True):
        least.setdefault(label, node)
        if node in outer:
            shown.setdefault(label, []).append(node)
    rings = [(x, y) for ring in shown.values() if len(ring) > 1 for x, y in zip(ring, ring[1:] + ring[:1], strict=True)]
    ways: dict[int, set[int]] = {label: set() for label in least}
    back: dict[int, set[int]] = {label: set() for label in least}
    for x, y in zip(ends[:n].tolist(), ends[n:].tolist(), strict=True):
        if (x := own[x]) != (y := own[y]):
            ways[x].add(y)
            back[y].add(x)
    waiting = [label for label in least if label not in shown]
    while waiting:
        x = waiting.pop()
        if x not in ways or len(ways[x]) * len(back[x]) > len(ways[x]) + len(back[x]) or (ways[x] and back[x] and len(ways[x]) + len(back[x]) > RANGES):
            continue
        after, before = ways.pop(x), back.pop(x)
        for y in before:
            ways[y].remove(x)
            ways[y] |= after
        for y in after:
            back[y].remove(x)
            back[y] |= before
        waiting += [y for y in (*before, *after) if y not in shown]
    name = {label: shown[label][0] if label in shown else least[label] for label in ways}
    left = rings + [(name[x], name[y]) for x, to in ways.items() for y in to]
    return pa.table({"a": pa.array([x for x, _ in left], pa.int64()), "b": pa.array([y for _, y in left], pa.int64())})


def _solved(rows: pa.Table) -> pa.Table:
    """(a, m): nodes on cycles of edges (a, b), where nodes of one known label b count as connected."""
    a, b, known = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "known"))
    nodes, ends = np.unique(np.concatenate([a, b[~known]]), return_inverse=True)
    names, sets = np.unique(b[known], return_inverse=True)
    x, y, s = ends[: len(a)][~known], ends[len(a) :], sets + len(nodes)
    member = ends[: len(a)][known]
    total = len(nodes) + len(names)
    own = np.array(strong_labels(total, np.concatenate([x, member, s]), np.concatenate([y, s, member])), dtype=np.int64)
    size = np.bincount(own, minlength=total)
    label = np.full(total, -1)
    first, at = np.unique(own[: len(nodes)], return_index=True)
    label[first] = nodes[at]
    label[own[len(nodes) :]] = names
    found = size[own[: len(nodes)]] > 1
    return pa.table({"a": nodes[found], "m": label[own[: len(nodes)][found]]})


def strong_labels(n: int, src: np.ndarray, dst: np.ndarray) -> list[int]:
    """A label below ``n`` for each of ``n`` nodes, equal where edges connect them strongly (Tarjan)."""
    order = np.argsort(src, kind="stable")
    to = memoryview(np.ascontiguousarray(dst[order], dtype=np.int64))
    begin = memoryview(np.searchsorted(src[order], np.arange(n + 1)).astype(np.int64))
    at, low, own = array("q", begin[:n]), array("q", bytes(8 * n)), array("q", [-1]) * n
    came, path, open_ = array("q", bytes(8 * n)), array("q"), array("q")
    clock = labels = 0
    for root in range(n):
        if low[root]:
            continue
        clock += 1
        low[root] = came[root] = clock
        path.append(root)
        open_.append(root)
        while path:
            node = path[-1]
            k, end = at[node], begin[node + 1]
            least = low[node]
            while k < end:
                child = to[k]
                k += 1
                if not low[child]:
                    clock += 1
                    low[child] = came[child] = clock
                    open_.append(child)
                    path.append(child)
                    break
                if own[child] < 0 and low[child] < least:
                    least = low[child]
            else:
                path.pop()
                low[node] = least
                if least == came[node]:
                    while True:
                        last = open_.pop()
                        own[last] = labels
                        if last == node:
                            break
                    labels += 1
                elif path and least < low[path[-1]]:
                    low[path[-1]] = least
                continue
            at[node], low[node] = k, least
    return own.tolist()


def strong_components(graph: dict) -> list[list]:
    """Sets of several nodes that reach each other, and nodes with an edge to themselves.

    Two depth-first passes: the second goes backwards, from the last node finished.
    """
    back: dict = {}
    for a, to in graph.items():
        for b in to:
            back.setdefault(b, []).append(a)

    def finish(order: list, ways: dict) -> list[list]:
        seen, out = set(), []
        for root in order:
            if root in seen:
                continue
            seen.add(root)
            done, stack = [], [(root, iter(ways.get(root, ())))]
            while stack:
                node, rest = stack[-1]
                step = next((n for n in rest if n not in seen), None)
                if step is None:
                    done.append(node)
                    stack.pop()
                else:
                    seen.add(step)
                    stack.append((step, iter(ways.get(step, ()))))
            out.append(done)
        return out

    ended = [n for tree in finish(sorted(graph), graph) for n in tree]
    return [own for own in finish(ended[::-1], back) if len(own) > 1 or own[0] in graph.get(own[0], ())]


def context_selection(edges: DataFrame, starts: DataFrame, depth: int, relations: tuple[str, ...], direction: str = "forward") -> DataFrame:
    """(start, document_id, distance, relations): documents within ``depth`` steps.

    Edges have src, dst, relation between documents; ``relations`` of a document are
    those that led to it, ``reverse:`` before those followed backwards. The start is a
    row of distance 0.
    """
    wanted = edges.where(F.col("relation").isin(*relations)) if relations else edges.limit(0)
    ways = []
    if direction in ("forward", "both"):
        ways.append(wanted.select(F.col("src").alias("here"), F.col("dst").alias("there"), "relation"))
    if direction in ("reverse", "both"):
        ways.append(wanted.select(F.col("dst").alias("here"), F.col("src").alias("there"), F.concat(F.lit("reverse:"), "relation").alias("relation")))
    moves = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    frontier = starts.select("start", F.col("start").alias("here")).distinct()
    seen = frontier.select("start", F.col("here").alias("document_id"), F.lit(0).alias("distance"), F.array().cast("array<string>").alias("relations"))
    for level in range(1, depth + 1):
        ways_ = frontier.join(moves, "here").join(seen.select("start", F.col("document_id").alias("there")), ["start", "there"], "left_anti")
        found = materialize(ways_.groupBy("start", F.col("there").alias("document_id")).agg(F.sort_array(F.collect_set("relation")).alias("relations")).withColumn("distance", F.lit(level)), "context")
        seen = seen.unionByName(found.select("start", "document_id", "distance", "relations"))
        frontier = found.select("start", F.col("document_id").alias("here"))
    return seen


def context_omissions(edges: DataFrame, selected: DataFrame, depth: int, relations: tuple[str, ...], direction: str = "forward") -> DataFrame:
    """(start, source_id, relation, target_id, reason) of edges that the view left out."""
    inside = selected.select("start", F.col("document_id").alias("here"), "distance")
    parts = []
    for reverse in (False, True):
        if direction in ("both", "reverse" if reverse else "forward"):
            a, b = ("dst", "src") if reverse else ("src", "dst")
            parts.append(edges.select(F.col(a).alias("here"), F.col(b).alias("there"), F.concat(F.lit("reverse:" if reverse else ""), "relation").alias("label"), "relation"))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    wanted: Column = F.col("relation").isin(*relations) if relations else F.lit(False)
    out = inside.join(every, "here").join(selected.select("start", F.col("document_id").alias("there")), ["start", "there"], "left_anti")
    return out.select("start", F.col("here").alias("source_id"), F.col("label").alias("relation"), F.col("there").alias("target_id"), F.when(~wanted, "relation-filter").otherwise("depth-limit").alias("reason")).distinct()
