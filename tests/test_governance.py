"""Rules that compare sets and histories, as relations."""

from __future__ import annotations

from corpusloom.operators import federation, governance, ranges


def test_scope_result(spark):
    table = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    found = governance.scope_result(table([("a", "1"), ("b", "1"), ("c", None), ("d", "1"), ("e", "1")]), table([("a", "2"), ("b", "2"), ("c", "9"), ("d", "1"), ("e", "3")]), table([("a", "2"), ("d", "1"), ("e", "4"), ("z", "1")]))
    assert sorted((r.path, r.outcome) for r in found.collect()) == [("b", "missing"), ("c", "missing"), ("d", "unchanged"), ("e", "mismatched"), ("z", "outside")]


def test_transitions(spark):
    rows = [("w", 1, "mandated", 1), ("w", 2, "planned", 1), ("w", 3, "accepted", 1), ("v", 1, "planned", 1), ("u", 1, "mandated", 1), ("u", 2, "planned", 2)]
    found = governance.transition_violations(spark.createDataFrame(rows, "workstream string, ordinal int, state string, attempt int"))
    assert sorted((r.workstream, r.ordinal, r.code) for r in found.collect()) == [("u", 2, "invalid-attempt"), ("v", 1, "invalid-start"), ("w", 3, "invalid-transition")]


def test_finish_and_ranges(spark):
    assert federation.finish_status(spark.createDataFrame([("applied",), ("skipped",)], "status string")).first().status == "partial"
    rows = spark.createDataFrame([("d", "a", 1, 3), ("d", "b", 4, 6), ("d", "c", 9, 9), ("d", "e", 2, 2)], "document_id string, address string, start_line int, end_line int")
    assert sorted((r.start_line, r.end_line) for r in ranges.range_union(rows).collect()) == [(1, 6), (9, 9)]
    assert {r.address: r.start_line for r in ranges.fragments(rows).collect()} == {"a": 1, "b": 1, "c": 9, "e": 1}


def test_intake():
    """Every branch of the decision, in the order in which it is taken."""
    from itertools import product

    from corpusloom.operators.governance import intake_decision

    owner, other = {"authority": "owner"}, {"authority": "reference"}
    names = ("authority_conflict", "incompatible_outcomes", "existing_owner_sufficient", "independent_lifecycle")
    allowed = ("update-existing", "create-workstream", "create-draft")
    for flags in product((False, True), repeat=4):
        for candidates in ([], [owner], [owner, other], [owner, owner]):
            clash, incompatible, sufficient, alone = flags
            got = intake_decision({"signals": dict(zip(names, flags, strict=True)), "candidates": candidates}, allowed)
            conflicts = ["authority-conflict"] * clash + ["incompatible-outcomes"] * incompatible + ["contradictory-owner-and-lifecycle"] * (sufficient and alone)
            if conflicts:
                assert got == {"decision": "blocked", "reasons": conflicts, "requested": None}
            elif sufficient and candidates.count(owner) != 1:
                assert got == {"decision": "blocked", "reasons": ["owner-evidence-ambiguous"], "requested": "update-existing"}
            else:
                want = ("update-existing", "existing-owner-sufficient") if sufficient else ("create-workstream", "independent-lifecycle") if alone else ("create-draft", "no-sufficient-owner")
                assert got == {"decision": want[0], "reasons": [want[1]], "requested": want[0]}
                assert intake_decision({"signals": dict(zip(names, flags, strict=True)), "candidates": candidates}, ())["reasons"] == ["decision-not-authorized"]


def test_plan_shapes():
    from corpusloom.operators.program import shape_codes

    codes = lambda plan, kind="roadmap": sorted(shape_codes(plan, kind), key=str)
    assert codes({"version": 1, "milestones": [{"id": "a", "prerequisites": ["b"], "waiting_for": None}]}) == []
    assert codes("x", "note") == [(None, "invalid-milestones"), (None, "invalid-program-plan"), (None, "invalid-program-type"), (None, "unsupported-program-version")]
    assert codes({"version": True, "milestones": ["x", {"id": "b", "prerequisites": "a", "source_contracts": [""], "waiting_for": " ", "reopen_when": 3, "z": 1}]}) == [
        ("0", "invalid-milestone"), ("b", "invalid-prerequisites"), ("b", "invalid-reopen-condition"), ("b", "invalid-source-contracts"), ("b", "invalid-waiting-condition"), ("b", "unknown-milestone-field"), (None, "unsupported-program-version"),
    ]
