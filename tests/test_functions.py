"""The parser, managed blocks and rule tables, without Spark."""

from __future__ import annotations

import pytest
import yaml
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions import markdown
from corpusloom.functions.blocks import block_diff, block_text, changed_spans, outside_ranges, replace_block, resolve_marker, rewrite_relations, scan_markers
from corpusloom.functions.markdown import fenced, front_matter, heading_anchor, parse_document, raw_links, value_json, value_type
from corpusloom.operators import governance
from corpusloom.operators.traverse import strong_components
from corpusloom.sources.policy import PolicyError

PREFIXES = frozenset({"DOC"})


def anchors(text):
    return [(s["anchor"], s["level"], s["start_line"], s["end_line"]) for s in parse_document(text, PREFIXES)["sections"]]


def issues(text):
    return parse_document(text, PREFIXES)["section_issues"]


def test_headings():
    assert anchors("# Обзор\n## Работа ИИ\n### Детали\n## Работа ИИ\n") == [("обзор", 1, 1, 4), ("работа-ии", 2, 2, 3), ("детали", 3, 3, 3), ("работа-ии-1", 2, 4, 4)]
    assert heading_anchor("Straße & Co_1") == "strasse-co_1" and heading_anchor("!!!") == ""
    assert anchors("---\n# x\n---\n# y ##\n") == [("x", 1, 2, 3), ("y", 1, 4, 4)]


def test_fences():
    assert anchors("````\n```\n# a\n````\n# b\n```x\n# c\n```y\n# d\n```\n# e\n") == [("b", 1, 5, 10), ("e", 1, 11, 11)]
    assert fenced(["``` a`b", "# x"]) == [False, False]


def test_anchors():
    assert anchors('<a id="Stable.ID"></a>\n# One\n<a name=\'second:anchor\'></a>\n## Two\n') == [("Stable.ID", 1, 2, 4), ("second:anchor", 2, 4, 4)]
    text = '<a id="-x"></a>\n# A\n<a id="lost"></a>\ntext\n<a id="p"></a>\n<a id="q"></a>\n# B\n<a id="r"></a>\n# C\n<a id="r"></a>\n# D\n<a id="a"></a>\n# E\n<a data-x id=y>\n'
    kinds = [i.split(" ")[0] for i in issues(text)]
    assert sorted(kinds) == ["anchor", "duplicate", "malformed", "malformed", "multiple", "orphaned"]
    assert issues("<a title=\"id=x\">\n# A\n```\n<a id='n'></a>\n```\n") == []


def test_links():
    assert raw_links("[a](b.md) ![i](c.png)\n[d][r] [r][]\n[r]: <e f.md>\n") == [("b.md", 1), ("e f.md", 2), ("e f.md", 2)]


def test_front_matter():
    found = front_matter("---\nid: DOC-1\nrevision: 2\nrelated: [DOC-2, DOC-2, x.md, 'a::DOC-3', OTHER-1]\nvalidated_against: [DOC-2@1, DOC-2@2, DOC-3@0, b]\nn: {b: [1.5, null], a: 2024-01-02}\n---".split("\n"), PREFIXES)
    assert [(r["kind"], r["target"]) for r in found["relations"]] == [("canonical", "DOC-2"), ("legacy", "x.md"), ("federated", "a::DOC-3")]
    assert len(found["issues"]) == 5 and found["end_line"] == 7
    assert found["additional"] == [{"name": "n", "value_type": "mapping", "value_json": '{"a":"2024-01-02","b":[1.5,null]}'}]
    for bad in ("", "---\nid: DOC-1\n", "---\n- a\n---", "---\na: {b: 1, b: 2}\n---", "---\nid: DOC-1\nrevision: true\n---"):
        assert front_matter(bad.split("\n"), PREFIXES)["document_id"] is None
    assert [value_type(v) for v in (None, True, 1, 1.0, "", b"")] == ["null", "boolean", "integer", "number", "string", "other"]
    assert value_json(b"\x01") == '"01"'


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B", "## B", "```", "~~~~", "text", '<a id="k"></a>', "[x](y.md)", "---", ""]), max_size=25))
def test_sections_are_well_formed(lines):
    found = parse_document("\n".join(lines), PREFIXES)
    n = len("\n".join(lines).splitlines())
    for s in found["sections"]:
        assert 1 <= s["start_line"] <= s["end_line"] <= n
        inner = [t for t in found["sections"] if s["start_line"] < t["start_line"] <= s["end_line"]]
        assert all(t["level"] > s["level"] for t in inner)
    assert all(1 <= link["line"] <= n for link in found["links"])


def test_blocks():
    text = "# A\n<!-- loom:source target=x -->\none\n<!-- /loom:source target=x -->\n```\n<!-- loom:source target=x -->\n```\n<!-- loom:managed target=x -->\nold\n<!-- /loom:managed target=x -->\n"
    source, managed = resolve_marker(text, "x", "source"), resolve_marker(text, "x", "managed", (5, 10))
    assert block_text(text, source) == "one\n" and block_text(replace_block(text, managed, "one\n"), managed) == "one\n"
    assert "-old\n+one" in block_diff(block_text(text, managed), block_text(text, source))
    assert scan_markers("<!-- t:source target=x -->\n<!-- t:managed target=x -->\n<!-- /t:source target=x -->\n", "x")[1]
    with pytest.raises(ValueError):
        resolve_marker(text, "y", "source")
    assert changed_spans("a\nb\nc\n", "a\nx\nc\n") == [(2, 2)] and outside_ranges("a\nb\n", "a\nx\n", [(1, 1)]) == [(2, 2)]


def test_rewrite():
    text = "---\nid: DOC-1 # keep\nrelated:\n  - 'a.md'\n  - b.md # c\nowner: a.md\n---\na.md\n"
    assert rewrite_relations(text, {"a.md": "DOC-2"}) == text.replace("  - 'a.md'", "  - DOC-2", 1)


def test_strong_components():
    assert sorted(map(sorted, strong_components({1: [2], 2: [3], 3: [1, 4], 4: [4], 5: [1]}))) == [[1, 2, 3], [4]]


REQUEST = {"actions": ["inspect", "edit-local"], "risk": "medium", "verification": "focused", "boundaries": dict.fromkeys(governance.BOUNDARIES, False), "authorizations": [], "source_scope": []}
CRITERION = {"allowed_actions": ["inspect", "edit-local"], "max_autonomy": "A2", "max_risk": "medium", "allowed_verification": ["focused"], "required_authorizations": ["edit-local"], "require_source_scope_for": ["edit-local"]}


def test_admission_and_intake():
    assert governance.admission(REQUEST, CRITERION)["reasons"] == ["authorization-missing:edit-local", "source-scope-required:edit-local"]
    good = {**REQUEST, "authorizations": [{"action": "edit-local"}], "source_scope": [{"path": "a"}]}
    assert governance.admission(good, CRITERION) == {"decision": "admitted", "reasons": ["policy-satisfied"], "required_autonomy": "A2", "missing_authorizations": []}
    bad = {**good, "risk": "high", "boundaries": {**REQUEST["boundaries"], "privacy_boundary": True}}
    assert governance.admission(bad, {**CRITERION, "max_autonomy": "A0"})["reasons"] == ["boundary:privacy-boundary", "autonomy-exceeds-policy", "risk-exceeds-policy"]
    signals = dict.fromkeys(governance.SIGNALS, False)
    decide = lambda allowed=("update-existing", "create-draft", "create-workstream"), owners=1, **s: governance.intake_decision({"signals": {**signals, **s}, "candidates": [{"authority": "owner"}] * owners}, allowed)["decision"]
    assert [decide(), decide(existing_owner_sufficient=True), decide(independent_lifecycle=True), decide(authority_conflict=True), decide(existing_owner_sufficient=True, owners=2), decide(allowed=())] == ["create-draft", "update-existing", "create-workstream", "blocked", "blocked", "blocked"]


def test_requests(tmp_path):
    (tmp_path / "r.json").write_text('{"a": 1, "a": 2}')
    with pytest.raises(PolicyError):
        governance.load_request(tmp_path / "r.json", {"a"})
    assert governance.load_request(tmp_path / "r.json", {"a"}, strict=False) == {"a": 2}
    assert governance.request_hash({"x": [2, 1], "y": 1}) == governance.request_hash({"y": 1, "x": [1, 2]})
    packet = governance.sealed({"workstream_id": "WS-1"})
    assert governance.is_sealed(packet) and not governance.is_sealed({**packet, "workstream_id": "WS-2"})
    assert governance.recovery("a", "b", "b") == "restore" and governance.recovery("a", "b", "c") == "refused" and governance.recovery("a", "b", "a") == "already-recovered"
    assert governance.lifecycle({"intake": {"request_sha256": "x"}, "admission": {"intake_request_sha256": "y", "workstream_id": "W", "targets": ["T"]}}, set()) == ["intake-request-mismatch", "missing:packet", "missing:result", "missing:workstream", "uncovered-target:T"]


def test_workstream_record():
    record = {"history": [{"state": "mandated", "attempt": 1}, {"state": "correcting", "attempt": 1}, {"state": "completed", "attempt": 2}], "findings": [{"id": "F", "attempt": 1, "resolved_in_attempt": 2}], "evidence": {"checks": [{"name": "c", "status": "passed"}], "review": {"status": "accepted", "independent": True}}}
    criterion = {"max_attempts": 2, "required_evidence": ["checks", "review"]}
    assert governance.workstream_status(record, criterion, set())["ready"]
    assert governance.workstream_status({**record, "findings": []}, criterion, set())["problems"] == ["no-finding:1"]


def test_plain_front_matter(monkeypatch):
    """Plain blocks are read without YAML, as YAML reads them; all others are left to it."""
    plain = [["id: ORD-7", "revision: 1", "status: F", "derived_from: [CUST-1, CUST-2]", "validated_against: [CUST-1@2]", "related: []"], ["weight: 0", "owner: team-3"]]
    for lines in plain:
        assert markdown._simple(lines) == yaml.load("\n".join(lines), Loader=markdown.UniqueKeys)
    odd = ["a: yes", "a: Off", "on: x", "a: 007", "a: 1e5", "a: 1_000", "a: 2020-01-01", "a: [b,c]", "a: [null]", "a: x y", "a: b #c", "a: 'b'", "a:", "  a: b", "a: b\nc", "a: -1", "A: b"]
    assert [markdown._simple(["id: ORD-7", line]) for line in odd] == [None] * len(odd)
    assert markdown._simple(["a: b", "a: b"]) is None and markdown._simple([]) is None
    monkeypatch.setattr(markdown.yaml, "load", None)
    found = markdown.parse_document("\n".join(["---", *plain[0], "---", "# T", "## Line 1"]), frozenset({"ORD", "CUST"}))
    assert found["document_id"] == "ORD-7" and [r["target"] for r in found["relations"]] == ["CUST-1", "CUST-2", "CUST-1"] and not found["issues"]
