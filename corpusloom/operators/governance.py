"""Rules over one request or record: intake, admission, promotion, execution, lifecycle.

Small rule tables evaluated on the driver over plain mappings; what compares sets of
files or histories is relational.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.analytics import impact
from corpusloom.operators.resolve import dependency_edges
from corpusloom.operators.snapshots import generation_status
from corpusloom.operators.validate import catalog_issues
from corpusloom.sources.corpus import Corpus
from corpusloom.sources.policy import PolicyError

# The vocabularies of requests and records.
MAX_REQUEST_BYTES = 128 * 1024
MAX_ITEMS = 100
MAX_TEXT = 4096
ACTION_LEVEL = {"inspect": 0, "plan": 1, "edit-local": 2, "run-checks": 2}
AUTONOMY_LEVEL = {"A0": 0, "A1": 1, "A2": 2}
RISK_LEVEL = {"low": 0, "medium": 1, "high": 2}
VERIFICATIONS = ("structural", "focused", "full")
BOUNDARIES = ("authored_deletion", "privacy_boundary", "permission_expansion", "external_commitment")
SIGNALS = ("authority_conflict", "incompatible_outcomes", "independent_lifecycle", "existing_owner_sufficient")
TRANSITIONS = {
    "mandated": ("planned", "blocked", "cancelled", "failed"),
    "planned": ("implementing", "blocked", "cancelled", "failed"),
    "implementing": ("validating", "blocked", "cancelled", "failed"),
    "validating": ("reviewing", "correcting", "blocked", "failed"),
    "reviewing": ("correcting", "accepted", "blocked", "failed"),
    "correcting": ("validating", "blocked", "failed"),
    "accepted": ("finishing", "correcting", "blocked", "failed"),
    "finishing": ("completed", "correcting", "blocked", "failed"),
}
INTAKE_KEYS = {"schema_version", "idea_id", "criterion", "outcome", "source", "candidates", "signals", "assumptions"}
ADMISSION_KEYS = {"schema_version", "workstream_id", "criterion", "intake_request_sha256", "outcome", "targets", "actions", "risk", "verification", "boundaries", "authorizations", "assumptions", "source_scope"}
RESULT_KEYS = {"schema_version", "workstream_id", "packet_sha256", "changed_files"}
PROMOTION_KEYS = {"schema_version", "source", "destination", "authority_key", "knowledge_state", "disposition", "evidence"}


# Requests ------------------------------------------------------------------------
def load_request(path: str | Path, keys: set[str], optional: frozenset[str] = frozenset(), strict: bool = True) -> dict[str, Any]:
    """A JSON request of bounded size with exactly the given keys, none repeated."""
    raw = Path(path).read_bytes()
    if len(raw) > MAX_REQUEST_BYTES:
        raise PolicyError(f"{path} is larger than {MAX_REQUEST_BYTES} bytes")

    def once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        if strict and len({k for k, _ in pairs}) < len(pairs):
            raise PolicyError(f"{path} repeats a key")
        return dict(pairs)

    try:
        found = json.loads(raw, object_pairs_hook=once)
    except ValueError as error:
        raise PolicyError(f"{path} is no JSON: {error}") from error
    return checked_request(found, keys, optional)


def checked_request(found: Any, keys: set[str], optional: frozenset[str] = frozenset()) -> dict[str, Any]:
    if not isinstance(found, dict) or set(found) - keys or keys - set(found) - optional:
        raise PolicyError(f"a request needs the keys {', '.join(sorted(keys))}")
    if found.get("schema_version", 1) != 1:
        raise PolicyError("schema_version must be 1")
    for key, value in found.items():
        if isinstance(value, str) and not 0 < len(value) <= MAX_TEXT:
            raise PolicyError(f"{key} must be a text of at most {MAX_TEXT} characters")
        if isinstance(value, list) and len(value) > MAX_ITEMS:
            raise PolicyError(f"{key} has more than {MAX_ITEMS} entries")
    return found


def request_hash(request: Mapping[str, Any]) -> str:
    """One identity for requests that differ in the order of keys and lists only."""

    def plain(value: Any) -> Any:
        if isinstance(value, Mapping):
            return {k: plain(v) for k, v in sorted(value.items())}
        if isinstance(value, list):
            return sorted((plain(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True))
        return value

    own = {k: v for k, v in request.items() if k != "source_scope" or v}
    return hashlib.sha256(json.dumps(plain(own), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


# Intake ---------------------------------------------------------------------------
# Conflicts by the signals that make them, and decisions by the first signal that holds.
CONFLICTS = (
    ("authority-conflict", ("authority_conflict",)),
    ("incompatible-outcomes", ("incompatible_outcomes",)),
    ("contradictory-owner-and-lifecycle", ("existing_owner_sufficient", "independent_lifecycle")),
)
DECISIONS = (
    ("existing_owner_sufficient", "update-existing", "existing-owner-sufficient"),
    ("independent_lifecycle", "create-workstream", "independent-lifecycle"),
    (None, "create-draft", "no-sufficient-owner"),
)


def intake_decision(request: Mapping[str, Any], allowed: tuple[str, ...]) -> dict[str, Any]:
    """Where an idea belongs, by the two tables; an update needs one owner candidate."""
    holds = request["signals"].get
    blocked = lambda reasons, wanted: {"decision": "blocked", "reasons": reasons, "requested": wanted}
    if conflicts := [name for name, needed in CONFLICTS if all(map(holds, needed))]:
        return blocked(conflicts, None)
    wanted, why = next((decision, reason) for signal, decision, reason in DECISIONS if signal is None or holds(signal))
    if wanted == "update-existing" and sum(c["authority"] == "owner" for c in request["candidates"]) != 1:
        return blocked(["owner-evidence-ambiguous"], wanted)
    if wanted not in allowed:
        return blocked(["decision-not-authorized"], wanted)
    return {"decision": wanted, "reasons": [why], "requested": wanted}


def next_id(corpus: Corpus, prefix: str, folder: str) -> tuple[str, str]:
    """(ID, path) one above the largest number of a prefix, past paths in use."""
    number = F.regexp_extract("document_id", f"^{prefix}-([0-9]+)$", 1)
    top = corpus.documents.where(number != "").agg(F.max(number.cast("decimal(38,0)")), F.max(F.length(number))).first()
    at, width = int(top[0] or 0) + 1, int(top[1] or 3)
    used = corpus.memberships.select(F.col("path"))
    while True:
        name = f"{prefix}-{at:0{width}d}"
        path = f"{folder}/{name}.md" if folder not in ("", ".") else f"{name}.md"
        if used.where(F.col("path") == path).isEmpty():
            return name, path
        at += 1


def allocation_guard(corpus: Corpus) -> str:
    """sha256 over the sorted lines ``id@revision:path`` of all documents with an ID.

    The lines come sorted from the executors, one partition at a time, into the hash.
    """
    row = F.concat("document_id", F.lit("@"), F.col("revision").cast("string"), F.lit(":"), "path")
    digest = hashlib.sha256()
    for i, found in enumerate(corpus.documents.where("document_id IS NOT NULL").select(row.alias("line")).orderBy("line").toLocalIterator()):
        digest.update(("\n" * (i > 0) + found.line).encode())
    return digest.hexdigest()


# Admission --------------------------------------------------------------------------
def admission(request: Mapping[str, Any], criterion: Mapping[str, Any]) -> dict[str, Any]:
    """Every reason against a request, in a fixed order; none admits it."""
    actions = list(request["actions"])
    level = max(ACTION_LEVEL[a] for a in actions)
    granted = {a["action"] for a in request["authorizations"]}
    missing = sorted(a for a in criterion.get("required_authorizations", ()) if a in actions and a not in granted)
    reasons = [f"boundary:{b.replace('_', '-')}" for b in BOUNDARIES if request["boundaries"][b]]
    reasons += [f"action-not-allowed:{a}" for a in actions if a not in criterion["allowed_actions"]]
    reasons += ["autonomy-exceeds-policy"] * (level > AUTONOMY_LEVEL[criterion["max_autonomy"]])
    reasons += ["risk-exceeds-policy"] * (RISK_LEVEL[request["risk"]] > RISK_LEVEL[criterion["max_risk"]])
    reasons += ["verification-not-allowed"] * (request["verification"] not in criterion["allowed_verification"])
    reasons += [f"authorization-missing:{a}" for a in missing]
    reasons += [f"source-scope-required:{a}" for a in criterion.get("require_source_scope_for", ()) if a in actions and not request.get("source_scope")]
    return {"decision": "blocked" if reasons else "admitted", "reasons": reasons or ["policy-satisfied"], "required_autonomy": f"A{level}", "missing_authorizations": missing}


# Execution --------------------------------------------------------------------------
def sealed(packet: Mapping[str, Any]) -> dict[str, Any]:
    """The packet with a hash of all its other content."""
    own = {k: v for k, v in packet.items() if k != "packet_sha256"}
    return {**own, "packet_sha256": hashlib.sha256(json.dumps(own, sort_keys=True, ensure_ascii=False).encode()).hexdigest()}


def is_sealed(packet: Mapping[str, Any]) -> bool:
    return sealed(packet) == dict(packet)


def scope_result(baseline: DataFrame, current: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, outcome) where a declared change, the scope and the files disagree.

    All have path and sha256; outcomes are outside, missing, unchanged and mismatched.
    """
    b = baseline.select("path", F.col("sha256").alias("b"), F.lit(True).alias("scoped"))
    c = current.select("path", F.col("sha256").alias("c"))
    d = declared.select("path", F.col("sha256").alias("d"), F.lit(True).alias("declared"))
    both = b.join(c, "path", "left").join(d, "path", "full_outer")
    moved = ~F.col("b").eqNullSafe(F.col("c"))
    outcome = (
        F.when(F.col("scoped").isNull(), "outside")
        .when(moved & F.col("declared").isNull(), "missing")
        .when(~moved & F.col("declared").isNotNull(), "unchanged")
        .when(F.col("declared").isNotNull() & ~F.col("c").eqNullSafe(F.col("d")), "mismatched")
    )
    return both.select("path", outcome.alias("outcome")).where("outcome IS NOT NULL")


# Workstreams ---------------------------------------------------------------------------
def transition_violations(history: DataFrame) -> DataFrame:
    """(workstream, ordinal, code) of steps that a history may not take.

    A history begins as mandated in attempt 1; the attempt grows by one exactly when
    the step before was correcting.
    """
    pairs = [(a, b) for a, to in TRANSITIONS.items() for b in to]
    allowed = history.sparkSession.createDataFrame(pairs, "before string, state string").withColumn("allowed", F.lit(True))
    w = Window.partitionBy("workstream").orderBy("ordinal")
    steps = history.withColumns({"before": F.lag("state").over(w), "was": F.lag("attempt").over(w)})
    steps = steps.join(F.broadcast(allowed), ["before", "state"], "left")  # a fixed table of about 30 rows
    grown = F.col("was") + F.when(F.col("before") == "correcting", 1).otherwise(0)
    code = (
        F.when(F.col("before").isNull() & ((F.col("state") != "mandated") | (F.col("attempt") != 1)), "invalid-start")
        .when(F.col("before").isNotNull() & F.col("allowed").isNull(), "invalid-transition")
        .when(F.col("before").isNotNull() & (F.col("attempt") != grown), "invalid-attempt")
    )
    return steps.select("workstream", "ordinal", code.alias("code")).where("code IS NOT NULL")


def workstream_status(record: Mapping[str, Any], criterion: Mapping[str, Any], anchors: set[str]) -> dict[str, Any]:
    """Attempts, findings and readiness of a record, with every problem found."""
    history, findings, evidence = record["history"], record["findings"], record["evidence"]
    attempts, final = history[-1]["attempt"], history[-1]["state"]
    need = set(criterion.get("required_evidence", ()))
    problems = [f"missing-section:{a}" for a in sorted(set(criterion.get("required_sections", ())) - anchors)]
    if attempts > criterion["max_attempts"]:
        problems.append("too-many-attempts")
    corrected = {h["attempt"] for h in history if h["state"] == "correcting"}
    problems += [f"no-finding:{a}" for a in sorted(corrected - {f["attempt"] for f in findings})]
    problems += [f"unavailable-attempt:{f['id']}" for f in findings if f["attempt"] > attempts or (f.get("resolved_in_attempt") or 0) > attempts]
    if final == "completed":
        problems += [f"unresolved:{f['id']}" for f in findings if f.get("resolved_in_attempt") is None]
        problems += [f"missing-evidence:{k}" for k in sorted(need & {"changes", "checks", "returns"}) if not evidence.get(k)]
        problems += [f"failed-check:{c['name']}" for c in evidence.get("checks", []) if "checks" in need and c["status"] != "passed"]
        review = evidence.get("review") or {}
        if "review" in need and not (review.get("status") == "accepted" and review.get("independent")):
            problems.append("no-accepted-review")
    resolved = sum(f.get("resolved_in_attempt") is not None for f in findings)
    return {"final_state": final, "attempts": attempts, "findings": len(findings), "resolved_findings": resolved, "problems": problems, "ready": final == "completed" and not problems}


# Promotion -----------------------------------------------------------------------------
def promotion(corpus: Corpus, request: Mapping[str, Any], history_mode: str = "living") -> dict[str, Any]:
    """Whether knowledge may move to its owner, what that does, and whom it touches."""
    source, destination = (request[k].split("#")[0] for k in ("source", "destination"))
    promotable = request["disposition"] in ("accepted", "partial") and request["knowledge_state"] in ("fact", "inference", "decision")
    if promotable and not request["evidence"]:
        raise PolicyError("promotable knowledge needs evidence")
    slugs = F.from_json(F.try_element_at(F.filter("additional", lambda a: a["name"] == "authority_for"), F.lit(1))["value_json"], "array<string>")
    owners = [r.document_id for r in corpus.documents.where(F.array_contains(slugs, request["authority_key"])).select("document_id").limit(MAX_ITEMS).collect()]
    conflicts = sorted(set(owners) - {destination})
    touched = impact(corpus, dependency_edges(corpus)).where(F.col("target_id") == destination)
    if conflicts:
        state, action = "blocked", "resolve-authority-conflict"
    elif not promotable:
        state, action = "blocked", "retain-candidate"
    else:
        state, action = "ready", {"living": "revise-owner", "append-only": "append-record"}.get(history_mode, "create-superseding-document")
    return {"state": state, "action": action, "source": source, "owners": owners, "conflicts": conflicts, "impacted": touched}


# Lifecycle ------------------------------------------------------------------------------
def lifecycle(artifacts: Mapping[str, Mapping[str, Any]], covered: set[str]) -> list[str]:
    """Broken links between intake, admission, packet, result and workstream of one task."""
    get = lambda a, k: artifacts.get(a, {}).get(k)
    equal = [
        ("workstream-id", [("admission", "workstream_id"), ("packet", "workstream_id"), ("result", "workstream_id"), ("workstream", "workstream_id")]),
        ("intake-request", [("intake", "request_sha256"), ("admission", "intake_request_sha256")]),
        ("packet", [("packet", "packet_sha256"), ("result", "packet_sha256")]),
    ]
    broken = []
    for name, places in equal:
        values = {get(a, k) for a, k in places if a in artifacts}
        if len(values) > 1:
            broken.append(f"{name}-mismatch")
    broken += [f"missing:{a}" for a in ("intake", "admission", "packet", "result", "workstream") if a not in artifacts]
    broken += [f"uncovered-target:{t}" for t in sorted(set(get("admission", "targets") or ()) - covered)]
    return broken


def recovery(before: str | None, after: str | None, current: str | None) -> str:
    """What recovering one file of a journal does, from three hashes."""
    if current == before:
        return "already-recovered"
    return "restore" if current == after else "refused"


# Readiness ------------------------------------------------------------------------------
def readiness(corpus: Corpus, root: str) -> dict[str, Any]:
    """Counts of what stands in the way, and the one next step."""
    issues = catalog_issues(corpus)
    kinds = issues.groupBy(F.coalesce("category", F.lit("")).alias("category"), "severity").agg(F.count("*").alias("n")).collect()
    count = lambda test: sum(r.n for r in kinds if test(r))
    found = {
        "blocking": count(lambda r: r.severity != "warning" and not r.category.startswith("legacy-")),
        "migrations": count(lambda r: r.category == "legacy-migration"),
        "boundaries": count(lambda r: r.category == "legacy-boundary"),
        "stale_pins": count(lambda r: r.category == "stale-pin"),
        "projection": generation_status(corpus, root),
    }
    step = "doctor" if found["blocking"] else "migrate" if found["migrations"] else "index" if found["projection"] != "current" else "context"
    return {**found, "next": step}


def action_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(ACTION_LEVEL.items()), "action string, level int")


def is_slug(value: str) -> bool:
    return re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", value) is not None
