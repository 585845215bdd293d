"""Queries by name over a corpus of broken rules: validation, adoption, delivery, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import analytics, maintenance, program, resolve, validate
from corpusloom.plans import commands
from corpusloom.plans.catalogue import query
from corpusloom.plans.session import materialize
from corpusloom.plans.synth import flawed, flawed_corpus, linked_corpus
from corpusloom.sources.corpus import memberships

PARTS = """parts AS (SELECT p_partkey AS k, 'PART-' || p_partkey AS id, 'specs/f' || (p_partkey // 20) || '/PART-' || p_partkey || '.md' AS path, p_partkey // 20 AS f,
 CASE p_partkey % 4 WHEN 0 THEN '../../suppliers/SUP-' || (p_partkey % 10) || '.md' WHEN 1 THEN 'missing-' || p_partkey || '.txt' WHEN 2 THEN 'https://example.com/' || p_partkey ELSE 'PART-' || p_partkey || '.md' END AS goal FROM part)"""
FOLDERS = "folders AS (SELECT DISTINCT p_partkey // 20 AS f FROM part WHERE p_partkey % 3 <> 0)"
LEGACY = f"""{PARTS}, legacy AS (SELECT id AS document_id, path, goal AS value, CASE WHEN k % 4 = 0 THEN 'SUP-' || (k % 10) END AS target_id, CASE k % 4 WHEN 1 THEN 'resource' WHEN 2 THEN 'external' WHEN 3 THEN 'self' END AS category FROM parts)"""
REACH = f"""{FOLDERS}, reach AS (SELECT 'specs/f' || f || '/' || n AS path, 'several index documents in folder specs/f' || f AS message FROM folders, (VALUES ('README.md'), ('index.md')) AS v(n) WHERE f % 10 = 0
 UNION ALL SELECT 'specs/f' || f || '/' || n, 'no index document above' FROM folders, (VALUES ('README.md'), ('index.md')) AS v(n) WHERE f % 10 = 0 OR n = 'README.md'
 UNION ALL SELECT path, CASE WHEN f % 10 = 0 THEN 'no index document above' ELSE 'not linked from specs/f' || f || '/README.md' END FROM parts WHERE f % 10 = 0 OR k % 3 = 0
 UNION ALL SELECT 'suppliers/SUP-' || s_suppkey || '.md', 'no index document above' FROM supplier UNION ALL SELECT 'programs/PRG-' || n_nationkey || '.md', 'no index document above' FROM nation)"""
SECTION = """section_ AS (SELECT path, 'orphaned explicit anchor ''lost'' at line 9' AS message FROM parts WHERE k % 5 = 0 UNION ALL SELECT path, 'navigation anchor contract is a heading of level 3' FROM parts WHERE k % 7 = 0)"""
DELIVERY = """delivery AS (SELECT 'SUP-' || s_suppkey AS owner, 'PART-' || s_suppkey AS a, s_suppkey % 9 AS c FROM supplier)"""
MILESTONE = """plans AS (SELECT n_nationkey AS k, n_nationkey % 10 % 3 AS s FROM nation WHERE n_nationkey % 7 > 1 AND n_nationkey % 8 <> 0),
 milestones AS (SELECT 'PRG-' || k AS program_id, 'base-' || k AS milestone, CASE s WHEN 0 THEN 'delivered' WHEN 1 THEN 'active' ELSE 'planned' END AS base_state, CASE s WHEN 0 THEN 'delivered' WHEN 1 THEN 'active' ELSE 'ready' END AS state FROM plans
 UNION ALL SELECT 'PRG-' || k, 'next-' || k, 'planned', CASE WHEN s = 0 THEN 'ready' ELSE 'waiting' END FROM plans
 UNION ALL SELECT 'PRG-' || k, CASE WHEN k % 5 = 0 THEN 'last-' ELSE 'later-' END || k, 'deferred', 'deferred' FROM plans)"""


# Sources and validation -------------------------------------------------------------
@query("s2_paths", f"WITH {PARTS}, {FOLDERS} SELECT path FROM parts UNION ALL SELECT 'specs/f' || f || '/README.md' FROM folders UNION ALL SELECT 'specs/f' || f || '/index.md' FROM folders WHERE f % 10 = 0 UNION ALL SELECT 'suppliers/SUP-' || s_suppkey || '.md' FROM supplier UNION ALL SELECT 'programs/PRG-' || n_nationkey || '.md' FROM nation")
def s2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the files that belong to the corpus; nothing is parsed."""
    c = flawed_corpus(spark, sf_dir)
    return memberships(flawed(spark, sf_dir).select("path"), c.policy).where("state = 'included'").select("path")


@query("v1_membership", "SELECT 'loose/NAT-' || n_nationkey || '.md' AS path, 'error' AS severity, true AS affects_graph FROM nation")
def v1_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.membership_issues(flawed_corpus(spark, sf_dir)).select("path", "severity", "affects_graph")


@query("j3_legacy_paths", f"WITH {LEGACY} SELECT document_id, value, target_id, category FROM legacy")
def j3_legacy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.legacy_relations(flawed_corpus(spark, sf_dir)).select("document_id", "value", "target_id", "category")


@query("v3_adoption", f"WITH {LEGACY} SELECT path, CASE WHEN category = 'self' THEN 'error' ELSE 'warning' END AS severity, coalesce(category, '') = 'self' AS affects_graph, target_id, CASE WHEN target_id IS NULL THEN 'legacy-boundary' ELSE 'legacy-migration' END AS category FROM legacy")
def v3_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.adoption_issues(flawed_corpus(spark, sf_dir)).select("path", "severity", "affects_graph", "target_id", "category")


@query("q14_migration_report", f"WITH {LEGACY} SELECT document_id, value, coalesce(target_id, category) AS outcome FROM legacy")
def q14_migration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = commands.migration_report(flawed_corpus(spark, sf_dir))
    return report["migrations"].unionByName(report["boundaries"]).select("document_id", "value", F.coalesce("target_id", "category").alias("outcome"))


@query("v4_sections", f"WITH {PARTS}, {SECTION} SELECT path, message FROM section_")
def v4_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that no heading follows, and navigation anchors of a wrong level (P10)."""
    return validate.section_rules(flawed_corpus(spark, sf_dir)).select("path", "message")


@query("j7_nearest_index", f"WITH {PARTS}, {REACH} SELECT path, message FROM reach")
def j7_nearest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that their nearest index does not link, folders of two indexes."""
    return validate.reachability_issues(flawed_corpus(spark, sf_dir)).select("path", "message")


ISSUES = f"""{LEGACY}, {REACH}, {SECTION}, issue AS (SELECT 'loose/NAT-' || n_nationkey || '.md' AS path, 'error' AS severity, '' AS category FROM nation UNION ALL SELECT path, CASE WHEN category = 'self' THEN 'error' ELSE 'warning' END, CASE WHEN target_id IS NULL THEN 'legacy-boundary' ELSE 'legacy-migration' END FROM legacy
 UNION ALL SELECT path, 'error', '' FROM reach UNION ALL SELECT path, 'error', '' FROM section_)"""


@query("v7_catalog_issues", f"WITH {ISSUES} SELECT path, severity, CAST(count(*) AS BIGINT) AS n FROM issue GROUP BY ALL")
def v7_catalog_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all rules of the catalog, by path."""
    return validate.catalog_issues(flawed_corpus(spark, sf_dir), graph=True).groupBy("path", "severity").agg(F.count("*").alias("n"))


@query("v11_doctor", f"WITH {ISSUES} SELECT path, severity, CAST(count(*) AS BIGINT) AS n FROM issue GROUP BY ALL")
def v11_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog has errors, so the doctor reports them and stops."""
    return commands.doctor(flawed_corpus(spark, sf_dir)).groupBy("path", "severity").agg(F.count("*").alias("n"))


@query("f14_validation_summary", f"WITH {ISSUES} SELECT CAST(count(*) FILTER (severity = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (severity = 'warning') AS BIGINT) AS warnings, CAST(count(*) FILTER (category = 'legacy-migration') AS BIGINT) AS adoption_resolved, CAST(count(*) FILTER (category = 'legacy-boundary') AS BIGINT) AS adoption_boundaries, CAST(0 AS BIGINT) AS stale_pins FROM issue")
def f14_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validation_summary(validate.catalog_issues(flawed_corpus(spark, sf_dir), graph=True))


@query("f15_compacted", f"WITH {ISSUES} SELECT CASE WHEN severity = 'error' THEN path END AS path, severity, CAST(count(*) AS BIGINT) AS n FROM issue GROUP BY ALL, CASE WHEN severity = 'warning' THEN category END".replace("GROUP BY ALL, CASE", "GROUP BY 1, 2, CASE"))
def f15_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of legacy paths as two counted rows; errors by path."""
    found = validate.compacted(validate.catalog_issues(flawed_corpus(spark, sf_dir), graph=True))
    return found.groupBy("path", "severity", F.when(F.col("severity") == "warning", F.col("message")).alias("m")).agg(F.sum("n").alias("n")).drop("m")


@query("f6_snapshots", "SELECT 'SUP-' || s_suppkey AS document_id FROM supplier WHERE s_suppkey % 3 = 0")
def f6_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the policy's rules call historical snapshots."""
    c = flawed_corpus(spark, sf_dir)
    return c.unique.where(resolve.is_historical(c)).select("document_id")


# Delivery ------------------------------------------------------------------------------
@query(
    "v9_delivery",
    f"""WITH {DELIVERY} SELECT owner, CASE c WHEN 1 THEN a || '#contract' WHEN 2 THEN a WHEN 3 THEN 'NONE-9#x' WHEN 4 THEN owner || '#proof' WHEN 5 THEN a || '#nowhere' WHEN 8 THEN 'lower' END AS source,
 CASE c WHEN 1 THEN 'duplicate-source-address' WHEN 2 THEN 'document-only-source' WHEN 3 THEN 'unknown-source-document' WHEN 4 THEN 'self-delivery' WHEN 5 THEN 'unknown-source-anchor' WHEN 6 THEN 'empty-delivery-field' WHEN 7 THEN 'invalid-delivery-field' WHEN 8 THEN 'invalid-source-address' END AS code FROM delivery WHERE c > 0""",
)
def v9_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.delivery_rows(flawed_corpus(spark, sf_dir)).where("code IS NOT NULL").select("owner", "source", "code")


@query("j11_evidence", "SELECT 'SUP-' || s_suppkey AS owner, CASE WHEN s_suppkey % 4 >= 2 THEN 'proof' END AS anchor, CASE s_suppkey % 4 WHEN 0 THEN 'missing-evidence-role' WHEN 1 THEN 'ambiguous-evidence-role' END AS code FROM supplier")
def j11_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.evidence_rows(flawed_corpus(spark, sf_dir)).select("owner", "anchor", "code")


@query("q11_delivery_map", f"WITH {DELIVERY} SELECT a || '#contract' AS source, owner, CASE CAST(substr(owner, 5) AS BIGINT) % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'active' ELSE 'planned' END AS status FROM delivery WHERE c IN (0, 1)")
def q11_delivery_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.delivery_map(flawed_corpus(spark, sf_dir))["mappings"]


@query("q5_delivery_review", "SELECT 'contract' AS kind, 'PART-9#contract' AS address, 'owned' AS state UNION ALL SELECT 'owner', 'SUP-9', 'completed' FROM supplier WHERE s_suppkey = 9")
def q5_delivery_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners and evidence of one contract; its owner has evidence that is ambiguous."""
    return commands.delivery_review(flawed_corpus(spark, sf_dir), "PART-9#contract")


# Plans -----------------------------------------------------------------------------------
@query("j13_milestones", f"WITH {MILESTONE} SELECT program_id, milestone, base_state FROM milestones")
def j13_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milestones of front matter, with base states from their roadmaps' status."""
    return commands.milestones(flawed_corpus(spark, sf_dir), "roadmap").select("program_id", "milestone", "base_state")


@query("a16_milestone_states", f"WITH {MILESTONE} SELECT program_id, milestone, state, CASE WHEN state = 'waiting' THEN 'base-' || substr(program_id, 5) ELSE '' END AS undelivered FROM milestones")
def a16_milestone_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = program.milestone_states(commands.milestones(flawed_corpus(spark, sf_dir), "roadmap"))
    return states.select("program_id", "milestone", "state", F.array_join("undelivered", ",").alias("undelivered"))


@query("q12_explain", f"WITH {MILESTONE} SELECT program_id, milestone, state, CASE state WHEN 'waiting' THEN 'undelivered-prerequisites' ELSE 'prerequisites-delivered' END AS reason, CASE WHEN state = 'ready' THEN 'start' END AS next_action FROM milestones WHERE milestone = 'next-3'")
def q12_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = materialize(program.milestone_states(commands.milestones(flawed_corpus(spark, sf_dir), "roadmap")), "states")
    return program.explained(states, "next-3").select("program_id", "milestone", "state", "reason", "next_action")


@query(
    "v10_plan_shapes",
    """WITH p AS (SELECT 'PRG-' || n_nationkey AS program_id, n_nationkey AS k FROM nation)
SELECT program_id, CAST(NULL AS VARCHAR) AS milestone, 'invalid-program-type' AS code FROM p WHERE k % 8 = 0
UNION ALL SELECT program_id, NULL, c FROM p, (VALUES ('invalid-program-plan'), ('unsupported-program-version'), ('invalid-milestones')) AS v(c) WHERE k % 7 = 0
UNION ALL SELECT program_id, NULL, c FROM p, (VALUES ('unknown-program-field'), ('invalid-milestones')) AS v(c) WHERE k % 7 = 1
UNION ALL SELECT program_id, NULL, 'unsupported-program-version' FROM p WHERE k % 7 > 1 AND k % 6 = 0
UNION ALL SELECT program_id, CASE WHEN k % 5 = 0 THEN 'last-' ELSE 'later-' END || k, c FROM p, (VALUES ('unknown-milestone-field'), ('invalid-reopen-condition')) AS v(c) WHERE k % 7 > 1 AND ((c LIKE 'unknown%' AND k % 3 = 0) OR (c LIKE 'invalid%' AND k % 4 = 0))""",
)
def v10_plan_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.plan_shapes(flawed_corpus(spark, sf_dir).documents)


# Blocks and migrations ---------------------------------------------------------------------
@query("j23_occurrences", "SELECT 'PART-' || p_partkey AS document_id, 'contract' AS anchor, CASE WHEN p_partkey % 12 = 0 THEN 'current' ELSE 'drifted' END AS state FROM part WHERE p_partkey % 6 = 0")
def j23_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Managed blocks, their sections, and whether they say what the source says."""
    source = spark.createDataFrame([("body 0\n",)], "body string")
    return maintenance.occurrences(flawed_corpus(spark, sf_dir), "terms", source)


DRIFTED = f"""{PARTS}, drifted AS (SELECT id AS document_id, path, '---' || chr(10) || 'id: ' || id || chr(10) || 'revision: 1' || chr(10) || 'type: spec' || chr(10) || 'related: [' || goal || ']' || chr(10) || '---' || chr(10) || '# Part ' || k || chr(10) || chr(10)
 || CASE WHEN k % 5 = 0 THEN '<a id="lost"></a>' || chr(10) || 'text' || chr(10) ELSE '' END || CASE WHEN k % 7 = 0 THEN '#' ELSE '' END || '## Contract' || chr(10) || 'x' || chr(10) || '<!-- tool:managed target=terms -->' || chr(10) AS top, chr(10) || '<!-- /tool:managed target=terms -->' || chr(10) AS rest FROM parts WHERE k % 12 = 6)"""


@query("q27_preview", f"WITH {DRIFTED} SELECT document_id, sha256(top || 'body 6' || rest) AS before, sha256(top || 'body 0' || rest) AS after FROM drifted")
def q27_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with drifted blocks as they are and as writing would leave them (M8)."""
    source = spark.createDataFrame([("body 0\n",)], "body string")
    return maintenance.preview(flawed_corpus(spark, sf_dir), "terms", source).select("document_id", "before", F.sha2("content", 256).alias("after"))


@query("p17_markers", "SELECT 'PART-' || p_partkey AS document_id, 'managed' AS kind, 'body ' || (p_partkey % 12) || chr(10) AS body, CAST(11 + CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END AS INTEGER) AS start FROM part WHERE p_partkey % 6 = 0")
def p17_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a target's blocks and the exact text in them."""
    return maintenance.marker_table(flawed_corpus(spark, sf_dir), "terms").where("issue IS NULL").select("document_id", "kind", "body", "start")


PLAN = f"""{PARTS}, plan AS (SELECT k, id AS document_id, '---' || chr(10) || 'id: ' || id || chr(10) || 'revision: 1' || chr(10) || 'type: spec' || chr(10) || 'related: [SUP-' || (k % 10) || ']' || chr(10) || '---' || chr(10) || '# Part ' || k || chr(10) || chr(10)
 || CASE WHEN k % 5 = 0 THEN '<a id="lost"></a>' || chr(10) || 'text' || chr(10) ELSE '' END || CASE WHEN k % 7 = 0 THEN '#' ELSE '' END || '## Contract' || chr(10) || 'x' || chr(10)
 || CASE WHEN k % 6 = 0 THEN '<!-- tool:managed target=terms -->' || chr(10) || 'body ' || (k % 12) || chr(10) || '<!-- /tool:managed target=terms -->' || chr(10) ELSE '' END AS content FROM parts WHERE k % 4 = 0)"""


@query("m1_migration_plan", f"WITH {PLAN} SELECT document_id, sha256(content) AS sha256 FROM plan")
def m1_migration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter rewritten where a legacy path has become a stable ID."""
    return maintenance.migration_plan(flawed_corpus(spark, sf_dir)).select("document_id", F.sha2("content", 256).alias("sha256"))


@query("v12_migrated", f"WITH {LEGACY} SELECT document_id, value, category FROM legacy WHERE target_id IS NULL")
def v12_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy relations left in the corpus that a migration would make; none can move again."""
    c = flawed_corpus(spark, sf_dir)
    after = maintenance.migrated(c, maintenance.migration_plan(c))
    return resolve.legacy_relations(after).select("document_id", "value", F.coalesce("category", "target_id").alias("category"))


@query("v11_doctor_profiles", "SELECT 'CUST-' || c_custkey AS path, 'missing-role' AS message FROM customer UNION ALL SELECT 'CUST-' || c_custkey, 'missing-metadata' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'CUST-' || c_custkey, 'status-not-allowed' FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'machinery')")
def v11_doctor_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without errors in the catalog the doctor goes on to the profiles, and stops there."""
    return commands.doctor(linked_corpus(spark, sf_dir)).select("path", "message")


