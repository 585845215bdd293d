"""The engine over small corpora of files, rows compared exactly."""

from __future__ import annotations

import pytest

from corpusloom.operators import analytics, federation, maintenance, resolve, snapshots, transactions, validate
from corpusloom.plans import commands
from corpusloom.sources.corpus import build_corpus, glob_pattern, list_files, scan_files
from corpusloom.sources.policy import Policy, PolicyError, Profile, View, described, initialize, load_policy, load_workspace, parse_policy, resolve_source, source_status

FILES = {
    "README.md": "---\nid: DOC-001\nrevision: 3\ntype: guide\n---\n# Index\n## Intro\n[b](area/b.md#setup) [c](area/c.md) [gone](area/b.md#missing)\n",
    "area/b.md": "---\nid: DOC-002\nrevision: 1\nstatus: draft\ndepends_on: [DOC-001]\nvalidated_against: [DOC-001@2]\nowner: me\n---\n# B\n\ntext\n\n## Setup\n[site](https://x.org) [pic](a.png) [out](../../../e.md) [none](zz.md) [](#)\n### Deep\n[self](#setup)\n",
    "area/c.md": "---\nid: DOC-003\nrevision: 1\nderived_from: [DOC-002, ../README.md, beta::DOC-001]\n---\n# C\n## Setup\n[dir](..)\n```\n[no](zz.md)\n```\n",
}


def corpus_of(spark, files, **policy):
    rows = spark.createDataFrame(sorted(files.items()), "path string, content string")
    return build_corpus(rows, Policy(prefixes=frozenset({"DOC", "RM"}), **policy))


@pytest.fixture(scope="module")
def corpus(spark):
    return corpus_of(spark, FILES, legacy_paths="resolve", views=(("map", View("both", ("depends_on",), 1)),), required_metadata=("owner",))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_dependencies_and_legacy(corpus):
    found = rows(resolve.dependency_edges(corpus), "relation", "source_id", "target_id")
    assert found == [("depends_on", "DOC-002", "DOC-001"), ("derived_from", "DOC-003", "DOC-001"), ("derived_from", "DOC-003", "DOC-002"), ("validated_against", "DOC-002", "DOC-001")]
    assert rows(resolve.pin_states(corpus), "source_id", "pin", "state") == [("DOC-002", 2, "stale")]
    assert rows(commands.migration_report(corpus)["migrations"], "document_id", "value", "target_id") == [("DOC-003", "../README.md", "DOC-001")]


def test_links_and_boundaries(corpus):
    edges, boundaries = resolve.resolve_links(corpus)
    assert rows(edges.na.fill(""), "src_doc", "src_anchor", "dst_doc", "dst_anchor", "reason") == [
        ("DOC-001", "intro", "DOC-002", "setup", "line 8"),
        ("DOC-001", "intro", "DOC-003", "", "line 8"),
        ("DOC-002", "deep", "DOC-002", "setup", "line 16"),
        ("DOC-003", "setup", "DOC-001", "", "line 8"),
    ]
    assert rows(boundaries, "src_doc", "raw_target", "category") == [
        ("DOC-001", "area/b.md#missing", "missing-anchor"),
        ("DOC-002", "#", "malformed"),
        ("DOC-002", "../../../e.md", "outside-root"),
        ("DOC-002", "a.png", "resource"),
        ("DOC-002", "https://x.org", "external"),
        ("DOC-002", "zz.md", "unknown-document"),
    ]


def test_references_and_paths(corpus):
    found = commands.references(corpus, "DOC-003", transitive=True)
    assert found.blockers.count() == 0
    got = {r.address: (r.distance, tuple(r.path)) for r in found.rows.collect()}
    assert got["DOC-002"] == (1, ("DOC-003", "DOC-002")) and got["DOC-001"] == (1, ("DOC-003", "DOC-001"))
    assert got["DOC-003#setup"][0] == 1 and "DOC-003" not in got
    assert {r.authority: r.state for r in found.completeness.collect()}["authored"] == "complete"
    plan = {r.address: r.disposition for r in commands.change_plan(corpus, "DOC-002").rows.collect()}
    assert plan["DOC-001"] == "read" and plan["DOC-003"] == "review"


def test_context_and_omissions(corpus):
    packet = commands.context(corpus, "DOC-002", 1, anchors=("setup",))
    assert rows(packet["documents"], "document_id", "distance") == [("DOC-001", 1), ("DOC-002", 0)]
    assert rows(packet["sections"], "document_id", "anchor") == [("DOC-002", "setup")]
    assert rows(packet["omitted"], "document_id", "anchor") == [("DOC-001", "intro")]
    both = commands.context(corpus, "DOC-002", view="map")
    assert rows(both["documents"], "document_id") == [("DOC-001",), ("DOC-002",)]
    assert ("DOC-003", "relation-filter") in rows(both["omissions"], "target_id", "reason")
    assert 0 < commands.packet_stats(packet, corpus).first().share < 1


def test_read(corpus):
    assert commands.read(corpus, "DOC-002", anchor="deep").rows.first().content == "### Deep\n[self](#setup)\n"
    assert commands.read(corpus, "DOC-001", navigation=True).rows.first().content.endswith("# Index\n")
    with pytest.raises(LookupError):
        commands.read(corpus, "DOC-999")


def test_validation(spark, corpus):
    issues = validate.catalog_issues(corpus, graph=True)
    assert issues.where("severity = 'error'").count() == 0
    assert {"stale-pin", "federated", "legacy-migration", "dead-reference"} <= {r.category for r in issues.collect()}
    bad = corpus_of(spark, {"README.md": FILES["README.md"], "x/a.md": FILES["README.md"], "x/b.md": "---\nid: DOC-002\nrevision: 1\ndepends_on: [DOC-003]\n---\n", "x/c.md": "---\nid: DOC-003\nrevision: 1\ndepends_on: [DOC-002, DOC-9]\n---\n", "d.md": "no front matter\n"})
    messages = [r.message for r in validate.catalog_issues(bad, graph=True).where("severity = 'error'").collect()]
    for part in ("duplicate document ID DOC-001", "names unknown document DOC-9", "cycle of depends_on: DOC-002, DOC-003", "front matter is missing", "not linked from README.md"):
        assert any(part in m for m in messages), part
    assert commands.impact(bad, "DOC-003").rows.count() == 0  # fails closed


def test_health_inventory_profiles(spark, corpus):
    health = commands.graph_health(corpus)
    assert rows(health["pins"], "state", "n") == [("stale", 1)]
    assert health["components"].first().n == 3
    fields = {r.name: (r.present, r.missing) for r in commands.metadata_inventory(corpus).rows.collect()}
    assert fields["owner"] == (1, 2) and fields["id"] == (3, 0) and fields["derived_from"] == (1, 2)
    with_profile = corpus_of(spark, FILES, legacy_paths="resolve", profiles=(Profile("guide", "guide", ("owner",), (("scope", ("scope",)),), ("related",), ("done",)),))
    assert rows(analytics.profile_violations(with_profile), "document_id", "code") == [("DOC-001", "missing-metadata"), ("DOC-001", "missing-role")]
    assert rows(analytics.profile_counts(with_profile), "profile", "documents", "violations") == [("guide", 1, 2)]


def test_generations(spark, corpus, tmp_path):
    root = str(tmp_path)
    assert snapshots.generation_status(corpus, root) == "missing"
    name = snapshots.write_generation(corpus, root)
    assert snapshots.generation_status(corpus, root) == "current"
    assert snapshots.resolve_generation(spark, root, name[:12]) == name
    with pytest.raises(LookupError):
        snapshots.resolve_generation(spark, root, name[:5])
    changed = corpus_of(spark, {**{k: v for k, v in FILES.items() if k != "area/c.md"}, "README.md": FILES["README.md"].replace("## Intro", "## Intro\nnew"), "n.md": "---\nid: DOC-004\nrevision: 1\n---\n# N\n"}, legacy_paths="resolve")
    assert snapshots.generation_status(changed, root) == "stale"
    found = commands.changes(changed, root, name)
    assert rows(found["documents"], "document_id", "change") == [("DOC-001", "changed"), ("DOC-003", "removed"), ("DOC-004", "added")]
    assert ("DOC-001", "intro", "changed") in rows(found["sections"], "document_id", "anchor", "change")
    direct = commands.references(corpus, "DOC-003", transitive=True).rows.drop("reason")
    stored = commands.references(corpus, "DOC-003", transitive=True, root=root).rows.drop("reason")
    assert direct.exceptAll(stored).count() == 0 and stored.exceptAll(direct).count() == 0
    one = snapshots.read_generation(spark, root, name, "edges", "DOC-001")
    assert {r.src_doc for r in one.collect()} == {"DOC-001"}


def test_federation(spark, corpus):
    beta = corpus_of(spark, {"README.md": "---\nid: DOC-001\nrevision: 1\nrelated: [alpha::DOC-002, gamma::DOC-1, alpha::DOC-77, beta::DOC-001]\n---\n# B\n"})
    edges, problems = federation.federated_edges({"alpha": corpus, "beta": beta})
    assert ("related", "beta::DOC-001", "alpha::DOC-002") in rows(edges, "relation", "source_id", "target_id")
    assert rows(problems, "source_id", "code") == [("beta::DOC-001", "self-source"), ("beta::DOC-001", "unknown-document"), ("beta::DOC-001", "unknown-source")]
    assert rows(commands.federation_context({"alpha": corpus, "beta": beta}, "alpha::DOC-003"), "document_id")[0] == ("alpha::DOC-001",)
    assert ("alpha::DOC-003", "semantic") in rows(commands.federation_impact({"alpha": corpus, "beta": beta}, "beta::DOC-001"), "source_id", "impact")


def test_program(spark):
    plan = "---\nid: RM-001\nrevision: 1\ntype: program\nprogram_plan:\n  milestones:\n" + "".join(
        f"  - {{id: {i}, title: T, order: {n}, {more}}}\n"
        for i, n, more in (("base", 1, "roadmap: RM-010"), ("left", 2, "prerequisites: [base], priority: 1"), ("right", 3, "prerequisites: [base], priority: 1"), ("last", 4, "prerequisites: [left, lost]"), ("ring", 5, "prerequisites: [ring]"))
    )
    found = commands.roadmap(corpus_of(spark, {"a.md": plan + "---\n", "b.md": "---\nid: RM-010\nrevision: 1\ntype: roadmap\nstatus: completed\n---\n"}))
    assert rows(found["milestones"], "milestone", "state") == [("base", "delivered"), ("last", "waiting"), ("left", "ready"), ("right", "ready"), ("ring", "waiting")]
    assert rows(found["next"], "action", "milestone") == [("start", "left"), ("start", "right")]
    assert {("last", "unknown-prerequisite"), ("ring", "self-prerequisite"), ("ring", "prerequisite-cycle")} <= set(rows(found["violations"], "milestone", "code"))


def test_delivery(spark):
    owner = "---\nid: RM-00{0}\nrevision: 1\ntype: roadmap\nstatus: active\ndelivers: {1}\n---\n# R\n## Proof\n"
    files = {"a.md": "---\nid: DOC-001\nrevision: 1\n---\n# A\n## Contract\n", "b.md": owner.format(1, "[DOC-001#contract, DOC-001, DOC-9#x]"), "c.md": owner.format(2, "[DOC-001#contract, DOC-001#no]"), "d.md": owner.format(3, "[]")}
    c = corpus_of(spark, files, delivery_types=("roadmap",), evidence_roles=(("evidence", ("proof",)), ("tests", ("test",))))
    found = commands.delivery_map(c, ("DOC-001#contract", "DOC-001#other"))
    assert rows(found["mappings"], "source", "owner") == [("DOC-001#contract", "RM-001"), ("DOC-001#contract", "RM-002")]
    assert rows(found["states"], "source", "state") == [("DOC-001#contract", "overlap"), ("DOC-001#other", "unowned")]
    assert {"document-only-source", "unknown-source-document", "unknown-source-anchor", "empty-delivery-field", "missing-evidence-role"} == {r.code for r in found["violations"].collect()}


def test_scan_and_membership(spark, tmp_path):
    for name in ("a.md", "b.MD", "_x.md", ".y.md", "sub/c.md", "sub/t.txt", "skip/d.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("---\nid: DOC-1\nrevision: 1\n---\n")
    assert len(list_files(tmp_path)) == 6
    c = build_corpus(scan_files(spark, tmp_path), Policy(areas=(("docs", "sub"), ("top", ".")), exclude=("skip/*.md",)))
    found = {r.path: (r.state, r.role) for r in c.memberships.collect()}
    assert found["sub/c.md"] == ("included", "docs") and found[".y.md"] == ("included", "top") and found["skip/d.md"] == ("excluded", None)
    assert c.documents.count() == 5


def test_globs():
    import re

    for glob, yes, no in (("*.md", "a.md", "b/a.md"), ("**/*.md", "x/y/a.md", "a.txt"), ("a/**/t.md", "a/t.md", "b/t.md"), ("d?.md", "d1.md", "d12.md"), ("[ab].md", "a.md", "c.md")):
        assert re.search(glob_pattern(glob), yes) and not re.search(glob_pattern(glob), no), glob


def test_policy_and_workspace(tmp_path):
    assert parse_policy({"version": 1}).legacy_paths == "strict"
    for bad in ({}, {"version": 1, "x": 1}, {"version": 1, "relations": {"legacy_paths": "no"}}, {"version": 1, "areas": {"a": "../b"}}):
        with pytest.raises(PolicyError):
            parse_policy(bad)
    (tmp_path / "corpusloom-workspace.toml").write_text('[sources]\nalpha = "a"\nbeta = "b"\n')
    (tmp_path / "a").mkdir()
    (tmp_path / "a/corpusloom.toml").write_text("version = 1\n")
    alpha, beta = load_workspace(tmp_path)
    assert source_status(alpha) == ("available", None) and source_status(beta) == ("unavailable", "missing-root")


def test_corrupt_generation(spark, corpus, tmp_path):
    """A generation whose table lost rows is corrupt, and reading it verified is refused."""
    root = str(tmp_path)
    name = snapshots.write_generation(corpus, root)
    assert snapshots.load_verified(corpus, root, "edges").count() == snapshots.read_generation(spark, root, name, "edges").count()
    lost = next(p for p in (tmp_path / f"generation={name}" / "sections").rglob("part-*.parquet"))
    lost.unlink()
    assert snapshots.generation_status(corpus, root, verify=True) == "corrupt"
    with pytest.raises(LookupError):
        snapshots.load_verified(corpus, root, "sections")
    assert snapshots.load_verified(corpus, root, "documents").count() == 3


def test_include_and_known(corpus):
    packet = commands.context(corpus, "DOC-002", 0, anchors=("setup",), include=("DOC-001#intro", "DOC-003"), assume_known=("DOC-002",))
    assert rows(packet["documents"], "document_id") == [("DOC-001",), ("DOC-002",), ("DOC-003",)]
    assert rows(packet["sections"], "document_id", "anchor") == [("DOC-001", "intro")]
    assert {r.navigation for r in packet["documents"].where("document_id = 'DOC-002'").collect()} == {None}
    for wrong in ("DOC-001#", "#x", "doc-1"):
        with pytest.raises(ValueError):
            commands.context(corpus, "DOC-002", include=(wrong,))


def test_scratch(spark):
    """Tables of a block go at its end, but for what is kept."""
    from pathlib import Path

    from corpusloom.plans.session import materialize, scratch

    with scratch(spark) as own:
        gone, kept = materialize(spark.range(5), "gone"), own.keep(materialize(spark.range(3), "kept"))
        paths = list(own.paths)
    assert kept.count() == 3 and [Path(p.removeprefix("file:")).exists() for p in paths] == [False, True] and gone.columns == ["id"]


def test_finish_and_reports(corpus):
    found = commands.finish(corpus, "DOC-003", depth=2)
    assert rows(found["included"], "document_id", "distance", "omitted_h2") == [("DOC-001", 1, ["intro"]), ("DOC-002", 1, ["setup"]), ("DOC-003", 0, ["setup"])]
    assert rows(found["freshness"], "source_id", "pin", "state") == [("DOC-002", 2, "stale")]
    assert rows(found["migrations"], "value", "target_id") == [("../README.md", "DOC-001")]
    gap = commands.context_gap(corpus, "stale_relation", ("DOC-002",), ("DOC-001#intro", "DOC-002#deep"), ("scope",))
    assert rows(gap, "kind", "address", "revision", "start_line", "end_line")[:2] == [("expanded", "DOC-001#intro", 3, 7, 8), ("expanded", "DOC-002#deep", 1, 15, 16)]
    for bad in (("agent_uncertainty", ("DOC-001",), ("DOC-002",), ("plan",)), ("missing_section", (), ("DOC-002",), ("plan",)), ("missing_section", ("DOC-001",), ("DOC-002",), ("plan", "plan")), ("missing_section", ("DOC-001", "DOC-001"), ("DOC-002",), ("plan",)), ("missing_section", ("DOC-001",), ("DOC-001#nowhere",), ("plan",)), ("missing_section", ("DOC-009",), ("DOC-001",), ("plan",))):
        with pytest.raises((ValueError, LookupError)):
            commands.context_gap(corpus, *bad)
    assert dict(rows(commands.report(corpus), "name", "value"))["documents"] == "3"


def test_maintenance_write(spark, tmp_path):
    block = lambda kind, body: f"<!-- t:{kind} target=terms -->\n{body}<!-- /t:{kind} target=terms -->\n"
    head = lambda i: f"---\nid: DOC-{i:03}\nrevision: 1\n---\n# D\n## S\n"
    files = {"a.md": head(1) + block("source", "said\nso\n"), "b.md": head(2) + block("managed", "old\n") + "x\n" + block("managed", ""), "c.md": head(3) + block("managed", "said\nso\n")}
    (tmp_path / "src").mkdir()
    for name, text in files.items():
        (tmp_path / "src" / name).write_text(text)
    found = corpus_of(spark, files)
    edits, guards = maintenance.write_plan(found, "terms")
    assert [e.path for e in edits] == ["b.md"] and list(guards) == ["a.md"]
    where = (str(tmp_path / "src"), str(tmp_path / "journal"), "WS-1", "2026-01-02T03:04:05Z")
    with pytest.raises(transactions.TransactionError, match="another state"):
        commands.maintenance_write(found, "terms", *where, "0" * 64)
    done = commands.maintenance_write(found, "terms", *where, transactions.preview_hash(edits, guards))
    assert done.status == "applied" and (tmp_path / "src" / "b.md").read_text() == head(2) + block("managed", "said\nso\n") + "x\n" + block("managed", "said\nso\n")
    again = corpus_of(spark, {n: (tmp_path / "src" / n).read_text() for n in files})
    assert {r.state for r in maintenance.occurrences(again, "terms").collect()} == {"current"} and maintenance.write_plan(again, "terms")[0] == []
    assert transactions.recover(*where[:2], done.generation, "2026-01-02T03:04:06Z").status == "recovered" and (tmp_path / "src" / "b.md").read_text() == files["b.md"]


def test_resolve_source(tmp_path, monkeypatch):
    (tmp_path / "p").mkdir()
    from corpusloom.sources import policy

    (tmp_path / policy.WORKSPACE_NAME).write_text('[sources]\nalpha = "p"\n')
    with pytest.raises(PolicyError, match="unavailable: missing-configuration"):
        resolve_source("alpha", str(tmp_path))
    at = initialize(tmp_path / "p", "ru")
    assert dict(described(load_policy(at.parent)))["language"] == "ru"
    with pytest.raises(FileExistsError):
        initialize(tmp_path / "p")
    assert resolve_source("alpha", str(tmp_path)).root == tmp_path / "p"
    with pytest.raises(PolicyError, match="no source beta"):
        resolve_source("beta", str(tmp_path))
    monkeypatch.setenv("CORPUSLOOM_WORKSPACE", " ")
    with pytest.raises(PolicyError, match="empty"):
        resolve_source("alpha")
    monkeypatch.setenv("CORPUSLOOM_WORKSPACE", str(tmp_path))
    assert resolve_source("alpha").name == "alpha"
