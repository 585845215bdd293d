"""Cycles of a core that is larger than the driver may take."""

from __future__ import annotations

from corpusloom.operators import traverse


def test_chain_of_rings(spark, monkeypatch):
    """Fifty bridged rings and a self loop need no closure; with no driver they are the same."""
    n = 150
    rings = [(f"N-{k}", f"N-{k // 3 * 3 + (k + 1) % 3}", "step") for k in range(n)]
    rows = [*rings, *((f"N-{k}", f"N-{k - 3}", "step") for k in range(3, n)), ("L", "L", "step"), ("N-5", "L", "step"), ("L", "N-1", "other")]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string")
    want = sorted([("step", tuple(sorted(f"N-{3 * g + i}" for i in range(3)))) for g in range(n // 3)] + [("step", ("L",))])
    found = lambda most: sorted((r.relation, tuple(r.members)) for r in traverse.cycles(edges, most=most).collect())
    assert found(0) == want

    def closure(_):
        raise AssertionError("closure of a core that contracts")

    monkeypatch.setattr(traverse, "reachable_pairs", closure)
    assert found(120) == want


def test_long_ways_between_rings(spark, monkeypatch):
    """A core that is still large when its rings are contracted needs no closure; ranges find the same."""
    n = 150
    rings = [(f"N-{k}", f"N-{k // 3 * 3 + (k + 1) % 3}", "step") for k in range(n)]
    rows = [*rings, *((f"N-{k}", f"N-{k - 3}", "step") for k in range(3, n)), ("N-9", "N-9", "step"), ("N-9", "N-140", "more"), ("N-140", "N-77", "more"), ("N-77", "N-9", "more"), ("L", "L", "more")]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string")
    want = sorted([("step", tuple(sorted(f"N-{3 * g + i}" for i in range(3)))) for g in range(n // 3)] + [("more", ("L",)), ("more", ("N-140", "N-77", "N-9"))])

    def closure(_):
        raise AssertionError("closure of a core of long ways")

    monkeypatch.setattr(traverse, "reachable_pairs", closure)
    for range_edges in (200_000, 25):
        found = traverse.cycles(edges, most=20, range_edges=range_edges)
        assert sorted((r.relation, tuple(r.members)) for r in found.collect()) == want
