"""The engine's queries as users ask them. Each one fails closed.

A query first evaluates the issues that would make its answer wrong; if there are any,
``rows`` is empty and ``blockers`` says why. What no edge stands for is in ``boundaries``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.blocks import scan_markers
from corpusloom.functions.markdown import ID, valid_anchor
from corpusloom.operators import analytics, federation, maintenance, program, ranges, resolve, snapshots, transactions, traverse, validate
from corpusloom.plans.session import materialize
from corpusloom.sources.corpus import Corpus, section_text
from corpusloom.sources.policy import View

DEFAULT_RELATIONS = ("depends_on", "derived_from", "validated_against")
RELATED_RELATIONS = (*DEFAULT_RELATIONS, "related", "supersedes")


@dataclass(frozen=True)
class Result:
    rows: DataFrame
    blockers: DataFrame
    boundaries: DataFrame | None = None
    completeness: DataFrame | None = None


def _gated(rows: DataFrame, blockers: DataFrame, **more: DataFrame) -> Result:
    found = blockers.limit(1).count()
    return Result(rows.limit(0) if found else rows, blockers, **more)


def _starts(corpus: Corpus, *addresses: str) -> DataFrame:
    return corpus.parsed.sparkSession.createDataFrame([(a,) for a in addresses], "start string")


def find_document(corpus: Corpus, document_id: str) -> DataFrame:
    """The one document of an ID; none or several raise ``LookupError``."""
    found = corpus.parsed.where(F.col("document_id") == document_id)
    if (n := found.limit(2).count()) != 1:
        raise LookupError(f"{document_id} names {'no document' if n == 0 else 'several documents'}")
    return found


def catalog(corpus: Corpus, explain: bool = False) -> DataFrame:
    found = corpus.memberships.orderBy("path")
    return found if explain else found.where("state = 'included'").select("role", "path")


def read(corpus: Corpus, document_id: str, anchor: str | None = None, navigation: bool = False) -> Result:
    """A document, one of its sections, or what comes before its first H2."""
    own = find_document(corpus, document_id)
    gate = validate.blockers(corpus, "read", own)
    lines = F.col("lines")
    if anchor is not None:
        s = F.try_element_at(F.filter("sections", lambda s: s["anchor"] == anchor), F.lit(1))
        rows = own.where(s.isNotNull()).select("document_id", section_text(lines, s["start_line"], s["end_line"]).alias("content"))
    elif navigation:
        rows = own.select("document_id", navigation_text(corpus).alias("content"))
    else:
        rows = own.select("document_id", "content")
    return _gated(rows, gate)


def navigation_text(corpus: Corpus) -> Column:
    """The lines before the first H2, or through the furthest H2 that the policy names."""
    named = F.filter("sections", lambda s: (s["level"] == 2) & s["anchor"].isin(*corpus.policy.extend_through)) if corpus.policy.extend_through else F.filter("sections", lambda s: F.lit(False))
    first = F.array_min(F.transform(F.filter("sections", lambda s: s["level"] == 2), lambda s: s["start_line"]))
    last = F.array_max(F.transform(named, lambda s: s["end_line"]))
    whole = F.when(F.col("content").endswith("\n"), F.col("content")).otherwise(F.concat("content", F.lit("\n")))
    return F.when(last.isNotNull(), F.concat(F.array_join(F.slice("lines", F.lit(1), last), "\n"), F.lit("\n"))).when(first.isNull(), whole).otherwise(section_text(F.col("lines"), F.lit(1), first - 1))


def dependencies(corpus: Corpus, document_id: str, reverse: bool = False) -> Result:
    own = find_document(corpus, document_id)
    gate = validate.blockers(corpus, "dependencies-reverse" if reverse else "dependencies", None if reverse else own)
    edges = resolve.dependency_edges(corpus)
    rows = edges.where(F.col("target_id" if reverse else "source_id") == document_id).orderBy("relation", "source_id", "target_id", F.coalesce("pin", F.lit(0)))
    return _gated(rows, gate)


def references(corpus: Corpus, address: str, reverse: bool = False, transitive: bool = False, root: str | None = None) -> Result:
    """Breadth-first references with proving paths, and the boundaries they meet."""
    own = find_document(corpus, address.split("#")[0])
    gate = validate.blockers(corpus, "references", None if reverse or transitive else own)
    found = traverse.traverse(snapshots.load_edges(corpus, root), _starts(corpus, address), reverse, transitive)
    visited = found.select("address").unionByName(_starts(corpus, address).withColumnRenamed("start", "address"))
    met = resolve.reference_graph(corpus)[1].withColumn("address", resolve.address("src_doc", "src_anchor")).join(visited.distinct(), "address", "left_semi")
    rows = found.orderBy("distance", "relation", "authority", "address")
    return _gated(rows, gate, boundaries=met.orderBy("address", "raw_target"), completeness=completeness(met, reverse))


def completeness(boundaries: DataFrame, reverse: bool) -> DataFrame:
    """(authority, state): authored is complete; observed only forwards and unbounded."""
    observed = F.lit("unknown") if reverse else F.when(F.count("*") > 0, "bounded").otherwise("complete")
    return boundaries.agg(observed.alias("o")).select(F.explode(F.create_map(F.lit("authored"), F.lit("complete"), F.lit("observed"), F.col("o"), F.lit("generated"), F.lit("not-enumerated"))).alias("authority", "state"))


def dispositions(found: DataFrame) -> DataFrame:
    """(start, address, disposition, n_reasons): read what is depended on, review the rest.

    ``found`` has the reasons of both directions, with ``is_reverse``.
    """
    own = found.where("authority <> 'generated'")
    must = F.bool_or(~F.col("is_reverse") & (F.col("authority") == "authored") & (F.col("relation") == "depends_on"))
    return own.groupBy("start", "address").agg(F.when(must, "read").otherwise("review").alias("disposition"), F.countDistinct("distance", "is_reverse", "relation", "authority", "origin", "reason", "path").alias("n_reasons"))


def change_plan(corpus: Corpus, address: str, reverse: bool = False, transitive: bool = False) -> Result:
    """What to read and what to review before a change, with every reason."""
    find_document(corpus, address.split("#")[0])
    edges = snapshots.load_edges(corpus, None)
    parts = [traverse.traverse_reasons(edges, _starts(corpus, address), back, transitive).withColumn("is_reverse", F.lit(back)) for back in ((True,) if reverse else (False, True))]
    found = reduce(DataFrame.unionByName, parts).where("authority <> 'generated'")
    must = F.bool_or(~F.col("is_reverse") & (F.col("authority") == "authored") & (F.col("relation") == "depends_on"))
    reasons = F.sort_array(F.collect_set(F.struct("distance", "is_reverse", "relation", "authority", "origin", "reason", "path")))
    rows = found.groupBy("address").agg(F.when(must, "read").otherwise("review").alias("disposition"), reasons.alias("reasons"))
    met = resolve.reference_graph(corpus)[1].where(F.col("src_doc") == address.split("#")[0])
    return _gated(rows.orderBy("address"), validate.blockers(corpus, "change-plan"), boundaries=met, completeness=completeness(met, reverse))


def delivery_review(corpus: Corpus, contract: str) -> DataFrame:
    """(kind, address, state) of a contract: its state, its owners and their evidence sections."""
    rows = materialize(analytics.delivery_rows(corpus).where("code IS NULL"), "delivery")
    asked = corpus.parsed.sparkSession.createDataFrame([(contract,)], "source string")
    if not corpus.policy.delivery_types:
        return asked.select(F.lit("contract").alias("kind"), F.col("source").alias("address"), F.lit("unconfigured").alias("state"))
    state = analytics.delivery_state(asked, rows).select(F.lit("contract").alias("kind"), F.col("source").alias("address"), "state")
    owners = rows.where(F.col("source") == contract).select("owner", "status").distinct()
    evidence = analytics.evidence_rows(corpus).where("anchor IS NOT NULL").join(owners.select("owner"), "owner", "left_semi")
    return state.unionByName(owners.select(F.lit("owner").alias("kind"), F.col("owner").alias("address"), F.col("status").alias("state"))).unionByName(
        evidence.select(F.lit("evidence").alias("kind"), F.concat_ws("#", "owner", "anchor").alias("address"), F.col("role").alias("state"))
    )


def execution_plan(corpus: Corpus, targets: tuple[str, ...]) -> DataFrame:
    """(start, address, disposition, n_reasons) of a handoff's targets, transitively, both ways."""
    edges = materialize(snapshots.load_edges(corpus, None), "edges")
    both = [traverse.traverse_reasons(edges, _starts(corpus, *targets), back).withColumn("is_reverse", F.lit(back)) for back in (False, True)]
    return dispositions(both[0].unionByName(both[1]))


def selection(items: tuple[str, ...]) -> list[tuple[str, str | None]]:
    """(ID, anchor or None) of ``ID`` or ``ID#anchor``; an empty part is an error, repeats go."""
    out = []
    for item in dict.fromkeys(items):
        document_id, sign, anchor = item.partition("#")
        if not ID.fullmatch(document_id) or (sign and not valid_anchor(anchor)):
            raise ValueError(f"{item!r} is neither an ID nor ID#anchor")
        out.append((document_id, anchor or None))
    return out


def outline(included: DataFrame) -> DataFrame:
    """(document_id, ordinal, level, anchor, n_bytes): headings in place of texts."""
    rows = included.select("document_id", "lines", F.explode("sections").alias("s"))
    return rows.select("document_id", "s.ordinal", "s.level", "s.anchor", F.octet_length(section_text(F.col("lines"), F.col("s.start_line"), F.col("s.end_line"))).alias("n_bytes"))


def context(corpus: Corpus, document_id: str, depth: int = 1, include_related: bool = False, view: str | None = None, anchors: tuple[str, ...] = (), since: str | None = None, root: str | None = None, include: tuple[str, ...] = (), assume_known: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """A task-sized packet: documents with reasons, their sections, and what is left out.

    ``sections`` holds navigation, requested sections and, against the generation
    ``since``, changed ones; ``omitted`` lists the other H2 sections; ``state`` says of
    each document whether it is new, changed or unchanged. ``include`` adds documents
    (ID) or sections (ID#anchor) whatever leads to them; documents ``assume_known`` keep
    their row but bring no text; ``outline`` has all headings with their sizes, and
    ``manifest`` which line range of ``fragments`` answers each address.
    """
    find_document(corpus, document_id)
    extra = selection(include)
    named = dict(corpus.policy.views)
    chosen = named[view] if view else View("forward", RELATED_RELATIONS if include_related else DEFAULT_RELATIONS, depth)
    edges = resolve.dependency_edges(corpus).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "relation")
    selected = traverse.context_selection(edges, _starts(corpus, document_id), chosen.depth, chosen.relations, chosen.direction)
    if extra:
        asked = corpus.parsed.sparkSession.createDataFrame([(document_id, i) for i in dict.fromkeys(d for d, _ in extra)], "start string, document_id string")
        fresh = asked.join(selected.select("document_id"), "document_id", "left_anti").select("start", "document_id", F.lit(None).cast("int").alias("distance"), F.array(F.lit("include")).alias("relations"))
        selected = selected.unionByName(fresh)
    included = corpus.parsed.drop("relations").join(selected.select("document_id", "distance", "relations"), "document_id")
    scope = None if view and chosen.direction != "forward" else included
    gate = validate.blockers(corpus, "context", scope)
    h2 = included.select("document_id", "distance", "lines", F.explode("sections").alias("s"))
    wanted = (F.col("distance") == 0) & F.col("s.anchor").isin(*anchors) if anchors else F.lit(False)
    for own_id, anchor in extra:
        wanted = wanted | ((F.col("document_id") == own_id) & (F.col("s.anchor") == anchor)) if anchor else wanted
    known = F.col("document_id").isin(*assume_known) if assume_known else F.lit(False)
    wanted = F.coalesce(wanted, F.lit(False)) & ~known
    now = materialize(included.select("document_id", F.sha2("content", 256).alias("source_sha256")), "now")
    state, changed = now.select("document_id", F.lit("unknown").alias("state")), None
    if since and root:
        spark, name = corpus.parsed.sparkSession, snapshots.resolve_generation(corpus.parsed.sparkSession, root, since)
        before = snapshots.read_generation(spark, root, name, "documents").join(now.select("document_id"), "document_id", "left_semi")
        moved = snapshots.document_changes(before, now)
        state = now.join(moved, "document_id", "left").select("document_id", F.when(F.col("change") == "added", "new").when(F.col("change") == "changed", "changed").otherwise("unchanged").alias("state"))
        old = snapshots.read_generation(spark, root, name, "sections")
        current = corpus.sections.where("document_id IS NOT NULL").join(now.select("document_id"), "document_id", "left_semi")
        changed = snapshots.section_changes(old.join(now.select("document_id"), "document_id", "left_semi"), current)
        keys = changed.where("change <> 'removed'").select(F.col("document_id").alias("c_id"), F.col("anchor").alias("c_anchor"), F.lit(True).alias("is_changed"))
        h2 = h2.join(keys, (F.col("document_id") == F.col("c_id")) & (F.col("s.anchor") == F.col("c_anchor")), "left")
        wanted = wanted | (F.coalesce("is_changed", F.lit(False)) & (F.col("s.level") == 2) & ~known)
    sections = h2.where(wanted).select("document_id", "s.anchor", "s.start_line", "s.end_line", section_text(F.col("lines"), F.col("s.start_line"), F.col("s.end_line")).alias("content"))
    omitted = h2.where((F.col("s.level") == 2) & ~wanted).select("document_id", "s.anchor", F.octet_length(section_text(F.col("lines"), F.col("s.start_line"), F.col("s.end_line"))).alias("n_bytes"))
    pins = resolve.pin_states(corpus).where("state <> 'current'").join(now.select(F.col("document_id").alias("source_id")), "source_id", "left_semi")
    packet = {
        "documents": included.select("document_id", "path", "distance", "relations", "revision", F.when(~known, navigation_text(corpus)).alias("navigation")).orderBy("distance", "document_id"),
        "sections": sections,
        "outline": outline(included),
        "manifest": ranges.fragments(sections.withColumn("address", F.concat_ws("#", "document_id", "anchor"))),
        "omitted": omitted,
        "omissions": traverse.context_omissions(edges, selected, chosen.depth, chosen.relations, chosen.direction),
        "pins": pins,
        "state": state,
        "fragments": ranges.range_union(sections),
    }
    if gate.limit(1).count():
        packet = {k: v.limit(0) for k, v in packet.items()}
    return {**packet, "blockers": gate}


def packet_stats(packet: dict[str, DataFrame], corpus: Corpus) -> DataFrame:
    """Bytes of a packet's texts, of the corpus, and their ratio."""
    size = packet["documents"].select(F.octet_length("navigation").alias("b")).unionAll(packet["sections"].select(F.octet_length("content").alias("b")))
    whole = corpus.parsed.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    own = size.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("packet_bytes"), F.lit(whole).cast("long").alias("corpus_bytes"))
    return own.withColumn("share", F.try_divide("packet_bytes", "corpus_bytes"))


def impact(corpus: Corpus, document_id: str) -> Result:
    find_document(corpus, document_id)
    rows = analytics.impact(corpus, resolve.dependency_edges(corpus)).where(F.col("target_id") == document_id)
    return _gated(rows.orderBy("source_id", "relation"), validate.blockers(corpus, "impact"))


def graph_health(corpus: Corpus) -> dict[str, DataFrame]:
    edges, boundaries = resolve.reference_graph(corpus)
    docs, flat = corpus.documents.where("document_id IS NOT NULL"), analytics.document_edges(edges)
    components = analytics.weak_components(docs, flat)
    pins = resolve.pin_states(corpus).groupBy("state").agg(F.count("*").alias("n"))
    found = {
        "edges": analytics.edge_counts(edges),
        "boundaries": analytics.boundary_counts(boundaries),
        "degrees": analytics.degrees(docs, flat),
        "orphans": analytics.orphans(docs, flat),
        "components": components.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component"),
        "missing_metadata": analytics.missing_metadata(docs, corpus.policy.required_metadata),
        "pins": pins,
        "signals": analytics.health_signals(corpus, edges, boundaries).orderBy("code", "document_id", "value"),
    }
    gate = validate.blockers(corpus, "health")
    return {**({k: v.limit(0) for k, v in found.items()} if gate.limit(1).count() else found), "blockers": gate}


def metadata_inventory(corpus: Corpus, field: str | None = None) -> Result:
    fields = analytics.field_rows(corpus.documents, corpus.relations)
    n = corpus.documents.where("document_id IS NOT NULL").count()
    rows = analytics.field_occurrences(fields, field).orderBy("document_id") if field else analytics.metadata_inventory(fields, n).orderBy("name")
    return _gated(rows, validate.blockers(corpus, "inventory"))


def profile_check(corpus: Corpus) -> Result:
    rows = analytics.profile_violations(corpus).orderBy("document_id", "code", "subject", "profile")
    return _gated(rows, validate.blockers(corpus, "index"))


def delivery_map(corpus: Corpus, contracts: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    rows = materialize(analytics.delivery_rows(corpus), "delivery")
    good = rows.where("code IS NULL").select("source", "owner", "status")
    asked = corpus.parsed.sparkSession.createDataFrame([(c,) for c in contracts], "source string")
    return {
        "mappings": good.orderBy("source", "owner"),
        "violations": rows.where("code IS NOT NULL").select("owner", "source", "code").unionByName(analytics.evidence_rows(corpus).where("code IS NOT NULL").select("owner", F.col("role").alias("source"), "code")),
        "overlaps": analytics.overlaps(good),
        "unowned": analytics.unowned(asked, good),
        "states": analytics.delivery_state(asked, good),
        "blockers": validate.blockers(corpus, "delivery"),
    }


def milestones(corpus: Corpus, program_type: str = "program", field: str = "program_plan") -> DataFrame:
    """The milestones of program documents, from their front matter."""
    kind = "struct<milestones:array<struct<id:string,title:string,order:bigint,priority:bigint,state:string,roadmap:string,prerequisites:array<string>,source_contracts:array<string>,waiting_for:string,reopen_when:string>>>"
    value = F.try_element_at(F.filter("additional", lambda a: a["name"] == field), F.lit(1))["value_json"]
    rows = corpus.documents.where(F.col("doc_type") == program_type).select(F.col("document_id").alias("program_id"), F.explode(F.from_json(value, kind)["milestones"]).alias("m"))
    empty = F.array().cast("array<string>")
    own = rows.select("program_id", F.col("m.id").alias("milestone"), "m.title", F.col("m.order").alias("ord"), F.coalesce("m.priority", "m.order").alias("priority"), F.col("m.state").alias("authored_state"), F.col("m.roadmap").alias("roadmap_id"), F.coalesce("m.prerequisites", empty).alias("prerequisites"), F.coalesce("m.source_contracts", empty).alias("source_contracts"), "m.waiting_for", "m.reopen_when")
    status = corpus.unique.select(F.col("document_id").alias("roadmap_id"), F.col("status").alias("roadmap_status"))
    found = own.join(status, "roadmap_id", "left")
    return found.withColumn("base_state", F.coalesce("authored_state", program.base_state("roadmap_status"), F.lit("planned"))).drop("roadmap_status")


def roadmap(corpus: Corpus) -> dict[str, DataFrame]:
    """States, next work, what each milestone unlocks, and what breaks the plans' rules."""
    own = materialize(milestones(corpus), "milestones")
    states = program.milestone_states(own)
    return {
        "milestones": states.orderBy("program_id", "ord", "milestone"),
        "next": program.next_work(states),
        "unlocks": program.unlocks(own),
        "violations": program.plan_violations(own, corpus.documents, corpus.headings),
    }


def migration_report(corpus: Corpus) -> dict[str, DataFrame]:
    found = resolve.legacy_relations(corpus)
    return {"migrations": found.where("target_id IS NOT NULL"), "boundaries": found.where("category IS NOT NULL")}


def changes(corpus: Corpus, root: str, selector: str) -> dict[str, DataFrame]:
    """What differs between a generation and the corpus as it is."""
    spark, name = corpus.parsed.sparkSession, snapshots.resolve_generation(corpus.parsed.sparkSession, root, selector)
    return {
        "documents": snapshots.document_changes(snapshots.read_generation(spark, root, name, "documents"), snapshots.document_table(corpus)).orderBy("document_id"),
        "sections": snapshots.section_changes(snapshots.read_generation(spark, root, name, "sections"), snapshots.section_table(corpus)).orderBy("document_id", "anchor"),
    }


# Why a reading went beyond its packet, which of these are no fault of it, and what that changed.
GAP_REASONS = ("task_requires_full_review", "missing_dependency", "missing_section", "poor_section_granularity", "unresolved_authority", "stale_relation", "missing_reverse_reference", "navigation_insufficient", "profile_gap", "external_boundary", "agent_uncertainty", "manual_inspection")
GAP_LOCAL = ("task_requires_full_review", "agent_uncertainty", "manual_inspection")
GAP_IMPACTS = ("plan", "scope", "decision", "verification", "result")


def finish(corpus: Corpus, document_id: str, depth: int = 1, include_related: bool = False) -> dict[str, DataFrame]:
    """What is left to look at before a task ends.

    ``included`` is what the task's packet held, with the H2 sections it left out;
    ``freshness``, ``migrations`` and ``boundaries`` are of these documents;
    ``dependents``, ``pins`` and ``issues`` are what the task may have touched.
    """
    find_document(corpus, document_id)
    edges = resolve.dependency_edges(corpus).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "relation")
    chosen = materialize(traverse.context_selection(edges, _starts(corpus, document_id), depth, RELATED_RELATIONS if include_related else DEFAULT_RELATIONS), "finish")
    h2 = F.filter("sections", lambda s: (s["level"] == 2) & ~s["anchor"].isin(*corpus.policy.extend_through)) if corpus.policy.extend_through else F.filter("sections", lambda s: s["level"] == 2)
    included = chosen.select("document_id", "distance", F.col("relations").alias("by")).join(corpus.parsed.select("document_id", "path", "sections"), "document_id")
    own = chosen.select(F.col("document_id").alias("source_id"))
    legacy = resolve.legacy_relations(corpus).withColumnRenamed("document_id", "source_id").join(own, "source_id", "left_semi")
    near = traverse.context_selection(edges, _starts(corpus, document_id), 1, RELATED_RELATIONS, "reverse")
    pins = resolve.pin_states(corpus)
    return {
        "included": included.select("document_id", "path", "distance", F.col("by").alias("relations"), F.transform(h2, lambda s: s["anchor"]).alias("omitted_h2")).orderBy("distance", "document_id"),
        "freshness": pins.join(own, "source_id", "left_semi"),
        "migrations": legacy.where("target_id IS NOT NULL"),
        "boundaries": legacy.where("category IS NOT NULL"),
        "dependents": near.where("distance > 0"),
        "pins": pins.where(F.col("target_id") == document_id),
        "issues": validate.catalog_issues(corpus, graph=True),
    }


def address_evidence(corpus: Corpus, addresses: tuple[str, ...]) -> DataFrame:
    """(address, revision, start_line, end_line) of addresses, without any text.

    A repeated address is an error, as is one that names nothing.
    """
    if len(set(addresses)) < len(addresses):
        raise ValueError("an address occurs twice")
    asked = corpus.parsed.sparkSession.createDataFrame([(i, a, *p) for i, (a, p) in enumerate(zip(addresses, selection(addresses), strict=True))], "at int, address string, document_id string, anchor string")
    known = corpus.unique.select("document_id", "revision").join(F.broadcast(asked), "document_id")  # as many rows as the call names
    spans = corpus.headings.where("anchor IS NOT NULL").select("path", F.col("anchor").alias("h"), "start_line", "end_line")
    at = known.join(corpus.unique.select("document_id", "path"), "document_id").join(spans, ["path"], "left")
    here = F.col("h") == F.col("anchor")
    found = at.groupBy("at", "address", "anchor", "revision").agg(F.min(F.when(here, F.col("start_line"))).alias("start_line"), F.min(F.when(here, F.col("end_line"))).alias("end_line"))
    found = found.where("anchor IS NULL OR start_line IS NOT NULL")
    if missing := sorted(set(addresses) - {r.address for r in found.select("address").collect()}):
        raise LookupError(f"not found: {', '.join(missing)}")
    return found.orderBy("at").select("address", "revision", "start_line", "end_line")


def context_gap(corpus: Corpus, reason: str, initial: tuple[str, ...], expanded: tuple[str, ...], impacts: tuple[str, ...]) -> DataFrame:
    """(kind, address, revision, start_line, end_line): evidence that a packet lacked what mattered."""
    if reason not in GAP_REASONS or reason in GAP_LOCAL:
        raise ValueError(f"{reason} is no reason for a report")
    if not initial or not expanded or not impacts or set(impacts) - set(GAP_IMPACTS) or len(set(impacts)) < len(impacts):
        raise ValueError(f"a report needs both kinds of addresses, and each impact once out of {', '.join(GAP_IMPACTS)}")
    kinds = {"initial": address_evidence(corpus, initial), "expanded": address_evidence(corpus, expanded)}
    return reduce(DataFrame.unionByName, (found.select(F.lit(kind).alias("kind"), "*") for kind, found in kinds.items()))


def report(corpus: Corpus, root: str | None = None) -> DataFrame:
    """(name, value): the state of a corpus in numbers, as a fault report states it."""
    spark = corpus.parsed.sparkSession
    summary = validate.validation_summary(validate.catalog_issues(corpus)).first().asDict()
    pins = {r.state: r.n for r in resolve.pin_states(corpus).groupBy("state").agg(F.count("*").alias("n")).collect()}
    rows = [*summary.items(), *((f"pins.{s}", n) for s, n in pins.items()), ("documents", corpus.documents.count())]
    state = [("projection", snapshots.generation_status(corpus, root))] if root else []
    return spark.createDataFrame([(k, str(v)) for k, v in [*rows, *state]], "name string, value string")


def maintenance_write(corpus: Corpus, target: str, folder: str, journal: str, workstream: str, moment: str, shown: str) -> transactions.Outcome:
    """Writes what a preview of hash ``shown`` showed, in one transaction; another state is an error.

    Afterwards no marker of the written files may be broken and each block says what the source says.
    """
    edits, guards = maintenance.write_plan(corpus, target)
    if transactions.preview_hash(edits, guards) != shown:
        raise transactions.TransactionError("the preview is of another state")
    spans = {e.path: e.semantic for e in edits}

    def sound(root: Path) -> bool:
        return all((root / p).read_text("utf-8") == text and not scan_markers(text, target)[1] for p, text in spans.items())

    return transactions.transact(folder, journal, workstream, moment, edits, sound, guards)


def doctor(corpus: Corpus) -> DataFrame:
    """Issues of the first rule family that has errors: catalog, profiles, delivery, plans."""
    issues = validate.catalog_issues(corpus, graph=True)
    if issues.where("severity <> 'warning'").limit(1).count():
        return issues.orderBy("path", "severity", "message").select("path", "severity", "message")
    families = [analytics.profile_violations(corpus).select("document_id", "code")]
    families.append(analytics.delivery_rows(corpus).where("code IS NOT NULL").select(F.col("owner").alias("document_id"), "code"))
    families.append(program.plan_shapes(corpus.documents).select(F.col("program_id").alias("document_id"), "code"))
    families.append(program.plan_violations(milestones(corpus), corpus.documents, corpus.headings).select(F.col("program_id").alias("document_id"), "code"))
    for family in families:
        if family.limit(1).count():
            return family.select(F.col("document_id").alias("path"), F.lit("error").alias("severity"), F.col("code").alias("message")).orderBy("path", "message")
    return issues.orderBy("path", "severity", "message").select("path", "severity", "message")


def federation_context(corpora: dict[str, Corpus], address: str, depth: int = 1, include_related: bool = False) -> DataFrame:
    edges, _ = federation.federated_edges(corpora)
    flat = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "relation")
    first = next(iter(corpora.values()))
    return traverse.context_selection(flat, _starts(first, address), depth, RELATED_RELATIONS if include_related else DEFAULT_RELATIONS)


def federation_impact(corpora: dict[str, Corpus], address: str) -> DataFrame:
    """Incoming edges of a qualified document, classified as in one corpus."""
    edges, _ = federation.federated_edges(corpora)
    now = federation.qualified({s: c.unique.select("document_id", "revision") for s, c in corpora.items()})
    now = now.select(federation.qualify("source", "document_id").alias("target_id"), "revision")
    found = edges.where(F.col("target_id") == address).join(now, "target_id", "left")
    state = F.when(F.col("relation") == "validated_against", F.when(F.col("pin") == F.col("revision"), "current").otherwise("stale"))
    rows = found.withColumn("state", state).select("source_id", "relation", "pin", analytics.impact_class().alias("impact"))
    return rows.withColumn("impact", F.replace("impact", F.lit("already stale"), F.lit("stale")))
