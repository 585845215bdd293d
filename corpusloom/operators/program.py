"""Program plans: milestone states, next work, and what breaks a plan's rules."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.traverse import cycles
from corpusloom.plans.session import ship

#: A roadmap document's status gives its milestone's base state.
STATE_OF_STATUS = {
    "proposed": "planned",
    "planned": "planned",
    "waiting": "waiting",
    "ready": "ready",
    "active": "active",
    "blocked": "blocked",
    "completed": "delivered",
    "delivered": "delivered",
    "deferred": "deferred",
    "cancelled": "cancelled",
    "failed": "failed",
}
#: The keys of a milestone, and its states that need a condition.
MILESTONE_KEYS = ("id", "title", "order", "priority", "state", "roadmap", "prerequisites", "source_contracts", "waiting_for", "reopen_when")


def base_state(status: str | Column) -> Column:
    pairs = [F.lit(x) for kv in STATE_OF_STATUS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(status) if isinstance(status, str) else status)


def milestone_states(milestones: DataFrame) -> DataFrame:
    """Adds state: what is planned or ready waits while a prerequisite is not delivered.

    ``milestones`` has program_id, milestone, priority, base_state and prerequisites;
    keys of milestones are unique over all programs that depend on each other.
    """
    needs = milestones.select("milestone", F.explode("prerequisites").alias("needed"))
    done = milestones.where("base_state = 'delivered'").select(F.col("milestone").alias("needed"))
    waiting = needs.join(done, "needed", "left_anti").groupBy("milestone").agg(F.sort_array(F.collect_set("needed")).alias("undelivered"))
    found = milestones.join(waiting, "milestone", "left")
    state = F.when(F.col("base_state").isin("planned", "ready"), F.when(F.col("undelivered").isNull(), "ready").otherwise("waiting")).otherwise(F.col("base_state"))
    return found.withColumns({"state": state, "undelivered": F.coalesce("undelivered", F.array().cast("array<string>"))})


def unlocks(milestones: DataFrame) -> DataFrame:
    """(milestone, unlocks): which milestones need each one."""
    needs = milestones.select(F.col("milestone").alias("by"), F.explode("prerequisites").alias("milestone"))
    known = needs.join(milestones.select("milestone"), "milestone", "left_semi")
    return known.groupBy("milestone").agg(F.sort_array(F.collect_set("by")).alias("unlocks"))


def next_work(states: DataFrame) -> DataFrame:
    """(program_id, action, milestone): active work goes on; else the ready of least priority.

    All that tie are listed. Without either a program is complete (all delivered),
    deferred (all that is left is) or blocked.
    """
    order = Window.partitionBy("program_id").orderBy("priority")
    active = states.where("state = 'active'").select("program_id", F.lit("continue").alias("action"), "milestone")
    busy = active.select("program_id").distinct()
    ready = states.where("state = 'ready'").join(busy, "program_id", "left_anti").withColumn("r", F.rank().over(order)).where("r = 1")
    started = ready.select("program_id", F.lit("start").alias("action"), "milestone")
    left = states.join(active.unionByName(started).select("program_id").distinct(), "program_id", "left_anti").groupBy("program_id")
    open_ = F.bool_and(F.col("state").isin("delivered", "cancelled", "deferred"))
    ended = left.agg(F.when(F.bool_and(F.col("state") == "delivered"), "complete").when(open_ & F.bool_or(F.col("state") == "deferred"), "deferred").otherwise("blocked").alias("action"))
    return reduce(DataFrame.unionByName, [active, started, ended.withColumn("milestone", F.lit(None).cast("string"))])


def owner_collisions(milestones: DataFrame) -> DataFrame:
    """Roadmap documents that milestones of several programs own."""
    return milestones.groupBy("roadmap_id").agg(F.countDistinct("program_id").alias("programs")).where("programs > 1")


def plan_violations(milestones: DataFrame, documents: DataFrame, anchors: DataFrame, roadmap_type: str = "roadmap") -> DataFrame:
    """(program_id, milestone, code) of what a milestone's fields and references break.

    ``milestones`` has program_id, milestone, title, ord, priority, authored_state,
    roadmap_id, prerequisites, source_contracts, waiting_for, reopen_when;
    ``documents`` document_id, doc_type, status; ``anchors`` document_id, anchor.
    """
    m = milestones
    roadmap = documents.select(F.col("document_id").alias("roadmap_id"), F.col("doc_type").alias("roadmap_type"), F.col("status").alias("roadmap_status"), F.lit(True).alias("roadmap_known"))
    m = m.join(roadmap, "roadmap_id", "left")
    state = F.coalesce("authored_state", base_state("roadmap_status"))
    for name in ("milestone", "ord", "roadmap_id"):
        m = m.withColumn(f"n_{name}", F.count("*").over(Window.partitionBy("program_id", name)))
    rules = [
        (~F.coalesce(F.col("milestone").rlike("^[a-z][a-z0-9-]*$"), F.lit(False)), "invalid-milestone-id"),
        (F.trim(F.coalesce("title", F.lit(""))) == "", "invalid-title"),
        (F.coalesce("ord", F.lit(0)) < 1, "invalid-order"),
        (F.coalesce("priority", F.col("ord"), F.lit(0)) < 1, "invalid-priority"),
        (F.col("authored_state").isNotNull() & F.col("roadmap_id").isNotNull(), "duplicated-state-authority"),
        (F.col("authored_state").isNotNull() & ~F.col("authored_state").isin(*sorted(set(STATE_OF_STATUS.values()))), "invalid-state"),
        (F.col("roadmap_id").isNotNull() & F.col("roadmap_known").isNull(), "unknown-roadmap"),
        (F.col("roadmap_id") == F.col("program_id"), "self-roadmap-owner"),
        (F.col("roadmap_known").isNotNull() & ~F.col("roadmap_type").eqNullSafe(roadmap_type), "invalid-roadmap-type"),
        (F.col("roadmap_known").isNotNull() & base_state("roadmap_status").isNull(), "unsupported-roadmap-state"),
        (F.size(F.array_distinct("prerequisites")) < F.size("prerequisites"), "duplicate-prerequisites"),
        (F.size(F.array_distinct("source_contracts")) < F.size("source_contracts"), "duplicate-source-contracts"),
        (F.array_contains("prerequisites", F.col("milestone")), "self-prerequisite"),
        ((state == "waiting") & F.col("waiting_for").isNull(), "missing-waiting-condition"),
        ((state != "waiting") & F.col("waiting_for").isNotNull(), "unexpected-waiting-condition"),
        ((state == "deferred") & F.col("reopen_when").isNull(), "missing-reopen-condition"),
        ((state != "deferred") & F.col("reopen_when").isNotNull(), "unexpected-reopen-condition"),
        (F.col("n_milestone") > 1, "duplicate-milestone-id"),
        (F.col("n_ord") > 1, "duplicate-order"),
        (F.col("roadmap_id").isNotNull() & (F.col("n_roadmap_id") > 1), "duplicate-roadmap-owner"),
    ]
    codes = F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, code in rules)))
    own = m.select("program_id", "milestone", F.explode(codes).alias("code"))
    needs = milestones.select("program_id", "milestone", F.explode("prerequisites").alias("needed"))
    keys = milestones.select("program_id", F.col("milestone").alias("needed"))
    unknown = needs.join(keys, ["program_id", "needed"], "left_anti").select("program_id", "milestone", F.lit("unknown-prerequisite").alias("code"))
    flat = needs.select(F.concat_ws("/", "program_id", "needed").alias("src"), F.concat_ws("/", "program_id", "milestone").alias("dst"), F.lit("needs").alias("relation"))
    member = cycles(flat).select(F.explode("members").alias("m"))
    ring = member.select(F.regexp_extract("m", "^(.*)/[^/]*$", 1).alias("program_id"), F.regexp_extract("m", "/([^/]*)$", 1).alias("milestone"), F.lit("prerequisite-cycle").alias("code"))
    late = needs.join(milestones.select("program_id", F.col("milestone").alias("needed"), F.col("authored_state").alias("needed_state")), ["program_id", "needed"])
    now = milestones.where("authored_state IN ('active', 'delivered')").select("program_id", "milestone")
    clash = late.where("needed_state IS NOT NULL AND needed_state <> 'delivered'").join(now, ["program_id", "milestone"], "left_semi").select("program_id", "milestone", F.lit("prerequisite-state-conflict").alias("code")).distinct()
    cross = milestones.join(owner_collisions(milestones).select("roadmap_id"), "roadmap_id", "left_semi").select("program_id", "milestone", F.lit("cross-program-roadmap-owner").alias("code"))
    return reduce(DataFrame.unionByName, [own, unknown, ring, clash, cross, contract_violations(milestones, documents, anchors)])


def plan_shapes(documents: DataFrame, field: str = "program_plan", owner_type: str = "roadmap") -> DataFrame:
    """(program_id, milestone, code) of plans and milestones that have not the right form.

    ``milestone`` is the one's ID, or its number where it has none; null for the plan.
    What is no mapping or list is reported here and not seen by the other rules.
    """
    ship(documents.sparkSession)
    value = F.try_element_at(F.filter("additional", lambda a: a["name"] == field), F.lit(1))
    owners = documents.select(F.col("document_id").alias("program_id"), "doc_type", value["value_json"].alias("plan")).where("program_id IS NOT NULL AND plan IS NOT NULL")
    schema = pa.schema([(n, pa.string()) for n in ("program_id", "milestone", "code")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"program_id": r["program_id"], "milestone": m, "code": c} for r in batch.to_pylist() for m, c in shape_codes(json.loads(r["plan"]), r["doc_type"], owner_type)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return owners.mapInArrow(run, "program_id string, milestone string, code string")


def shape_codes(plan: object, doc_type: str | None, owner_type: str = "roadmap") -> Iterator[tuple[str | None, str]]:
    """(milestone or None, code): each rule is a test of one part of the plan."""
    texts = lambda x: isinstance(x, list) and all(isinstance(v, str) and v for v in x)
    said = lambda x: x is None or (isinstance(x, str) and bool(x.strip()))
    whole = plan if isinstance(plan, dict) else {}
    listed = whole.get("milestones")
    listed = listed if isinstance(listed, list) else []
    version = whole.get("version")
    for holds, code in (
        (doc_type == owner_type, "invalid-program-type"),
        (isinstance(plan, dict), "invalid-program-plan"),
        (set(whole) <= {"version", "milestones"}, "unknown-program-field"),
        (type(version) is int and version == 1, "unsupported-program-version"),
        (bool(listed), "invalid-milestones"),
    ):
        if not holds:
            yield None, code
    for place, item in enumerate(listed):
        own = item if isinstance(item, dict) else {}
        name = own.get("id") if isinstance(own.get("id"), str) else str(place)
        for holds, code in (
            (isinstance(item, dict), "invalid-milestone"),
            (set(own) <= set(MILESTONE_KEYS), "unknown-milestone-field"),
            (texts(own.get("prerequisites", [])), "invalid-prerequisites"),
            (texts(own.get("source_contracts", [])), "invalid-source-contracts"),
            (said(own.get("waiting_for")), "invalid-waiting-condition"),
            (said(own.get("reopen_when")), "invalid-reopen-condition"),
        ):
            if not holds:
                yield name, code


def explained(states: DataFrame, milestone: str) -> DataFrame:
    """One milestone: its state, why, what it waits for and whether it is next."""
    first = next_work(states).select("program_id", "milestone", F.col("action").alias("next_action"))
    reason = (
        F.when(F.col("state") == "waiting", F.when(F.size("undelivered") > 0, "undelivered-prerequisites").otherwise("waiting-condition"))
        .when(F.col("state") == "ready", "prerequisites-delivered")
        .otherwise("authored-state")
    )
    own = states.where(F.col("milestone") == milestone)
    return own.join(first, ["program_id", "milestone"], "left").select("program_id", "milestone", "state", reason.alias("reason"), "undelivered", "next_action")


def contract_violations(milestones: DataFrame, documents: DataFrame, anchors: DataFrame) -> DataFrame:
    """Source contracts that are no section address, or lead to nothing."""
    rows = milestones.select("program_id", "milestone", F.explode("source_contracts").alias("c"))
    rows = rows.withColumns({"document_id": F.split_part("c", F.lit("#"), F.lit(1)), "anchor": F.when(F.col("c").contains("#"), F.regexp_extract("c", "#(.*)$", 1))})
    found = rows.join(documents.select("document_id", F.lit(True).alias("known")).distinct(), "document_id", "left")
    found = found.join(anchors.select("document_id", "anchor", F.lit(True).alias("has_anchor")).distinct(), ["document_id", "anchor"], "left")
    code = (
        F.when(~F.col("document_id").rlike("^[A-Z][A-Z0-9]{1,15}-[0-9]+$") | (F.col("anchor") == ""), "invalid-source-contract")
        .when(F.col("anchor").isNull(), "document-only-source-contract")
        .when(F.col("known").isNull(), "unknown-source-document")
        .when(F.col("has_anchor").isNull(), "unknown-source-anchor")
    )
    return found.select("program_id", "milestone", code.alias("code")).where("code IS NOT NULL")
