"""Queries by name that ask a corpus without errors, as users do: commands, packets, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import analytics, federation, resolve, snapshots
from corpusloom.plans import commands
from corpusloom.plans.catalogue import query
from corpusloom.plans.session import read_table, shared_dir
from corpusloom.plans.synth import linked_corpus
from corpusloom.sources.corpus import Corpus

CUST = """cust AS (SELECT c_custkey AS k, 'CUST-' || c_custkey AS id, c_nationkey AS n, 'NAT-' || c_nationkey AS nat, c_custkey // 20 AS g, lower(c_mktsegment) AS status FROM customer)"""
GROUPS = "groups AS (SELECT DISTINCT c_custkey // 20 AS g FROM customer)"


def _lines(*parts: str) -> str:
    return " || chr(10) || ".join(parts) + " || chr(10)"


PAGES = f"""{CUST}, {GROUPS}, pages AS (
 SELECT 'REG-' || r_regionkey AS id, {_lines("'---'", "'id: REG-' || r_regionkey", "'revision: 1'", "'type: region'", "'---'", "'# ' || r_name")} AS top, {_lines("''", "'## Nations'", "'listed'")} AS rest FROM region
 UNION ALL SELECT 'NAT-' || n_nationkey, {_lines("'---'", "'id: NAT-' || n_nationkey", "'revision: 1'", "'type: nation'", "'depends_on: [REG-' || n_regionkey || ']'", "'---'", "'# ' || n_name")}, {_lines("''", "'## Profile'", "'[region](REG-' || n_regionkey || '.md#nations)'")} FROM nation
 UNION ALL SELECT id, {_lines("'---'", "'id: ' || id", "'revision: 1'", "'type: customer'", "'status: ' || status", "'depends_on: [' || nat || ']'")} || CASE WHEN k % 2 = 1 THEN 'related: [CUST-' || (k - 1) || ']' || chr(10) ELSE '' END || 'validated_against: [' || nat || '@' || (k % 2 + 1) || ']' || chr(10) || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'weight: 7' || chr(10) ELSE 'weight: heavy' || chr(10) END || {_lines("'---'", "'# Customer ' || k")},
   {_lines("''", "'## Contact'", "'[nation](../../geo/' || nat || '.md#profile)'", "''", "'## History'", "'since ' || k", "''", "'### Early'", "'none'")} FROM cust
 UNION ALL SELECT 'IDX-1', {_lines("'---'", "'id: IDX-1'", "'revision: 1'", "'type: index'", "'---'", "'# Index'")}, (SELECT string_agg('- [r](REG-' || r_regionkey || '.md)' || chr(10), '' ORDER BY r_regionkey) FROM region) || (SELECT string_agg('- [n](NAT-' || n_nationkey || '.md)' || chr(10), '' ORDER BY n_nationkey) FROM nation)
 UNION ALL SELECT 'IDX-2', {_lines("'---'", "'id: IDX-2'", "'revision: 1'", "'type: index'", "'---'", "'# Index'")}, string_agg('- [g](g' || g || '/README.md)' || chr(10), '' ORDER BY g) FROM groups
 UNION ALL SELECT 'IDX-' || (g + 10), {_lines("'---'", "'id: IDX-' || (g + 10)", "'revision: 1'", "'type: index'", "'---'", "'# Index'")}, string_agg('- [c](CUST-' || k || '.md)' || chr(10), '' ORDER BY k) FROM cust GROUP BY g)"""


def _generation(spark: SparkSession, c: Corpus) -> tuple[str, str]:
    root = f"{shared_dir(spark).rstrip('/')}/generations-{uuid.uuid4().hex}"
    return root, snapshots.write_generation(c, root)


# Reading ---------------------------------------------------------------------------------
@query("q1_catalog", f"WITH {CUST}, {GROUPS} SELECT 'geo' AS role, 'geo/REG-' || r_regionkey || '.md' AS path FROM region UNION ALL SELECT 'geo', 'geo/NAT-' || n_nationkey || '.md' FROM nation UNION ALL SELECT 'customers', 'customers/g' || g || '/' || id || '.md' FROM cust UNION ALL SELECT 'customers', 'customers/g' || g || '/README.md' FROM groups UNION ALL SELECT 'customers', 'customers/README.md' UNION ALL SELECT 'geo', 'geo/README.md'")
def q1_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.catalog(linked_corpus(spark, sf_dir))


@query("q2_read_section", "SELECT 'CUST-7' AS document_id, '## History' || chr(10) || 'since 7' || chr(10) || chr(10) || '### Early' || chr(10) || 'none' || chr(10) AS content")
def q2_read_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.read(linked_corpus(spark, sf_dir), "CUST-7", anchor="history").rows


@query("f13_read_document", f"WITH {PAGES} SELECT id AS document_id, top || rest AS content FROM pages WHERE id = 'CUST-8'")
def f13_read_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.read(linked_corpus(spark, sf_dir), "CUST-8").rows


@query("f1_find_document", "SELECT 'CUST-41' AS document_id, 'customers/g2/CUST-41.md' AS path")
def f1_find_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.find_document(linked_corpus(spark, sf_dir), "CUST-41").select("document_id", "path")


# Graph -------------------------------------------------------------------------------------
@query("q3_dependencies", f"WITH {CUST} SELECT 'depends_on' AS relation, id AS source_id, nat AS target_id, CAST(0 AS BIGINT) AS pin FROM cust WHERE n = 7 UNION ALL SELECT 'validated_against', id, nat, k % 2 + 1 FROM cust WHERE n = 7")
def q3_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming edges of one nation."""
    return commands.dependencies(linked_corpus(spark, sf_dir), "NAT-7", reverse=True).rows.na.fill(0, ["pin"])


@query("g1_dependency_graph", f"WITH {CUST} SELECT 'depends_on' AS relation, id AS source_id, nat AS target_id FROM cust UNION ALL SELECT 'validated_against', id, nat FROM cust UNION ALL SELECT 'related', id, 'CUST-' || (k - 1) FROM cust WHERE k % 2 = 1 UNION ALL SELECT 'depends_on', 'NAT-' || n_nationkey, 'REG-' || n_regionkey FROM nation")
def g1_dependency_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.dependency_edges(linked_corpus(spark, sf_dir)).drop("pin")


@query("q4_references", f"WITH {CUST} SELECT id AS address, 'depends_on' AS relation, 1 AS distance, true AS direct FROM cust WHERE n = 7 UNION ALL SELECT a.id, 'related', 2, false FROM cust a JOIN cust b ON b.k = a.k - 1 WHERE a.k % 2 = 1 AND b.n = 7 AND a.n <> 7")
def q4_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever leads to a nation by authored relations; links of indexes lead on to more."""
    found = commands.references(linked_corpus(spark, sf_dir), "NAT-7", reverse=True, transitive=True).rows
    return found.where("authority = 'authored'").select("address", "relation", "distance", "direct")


@query("g19_completeness", "SELECT * FROM (VALUES ('authored', 'complete'), ('observed', 'unknown'), ('generated', 'not-enumerated')) AS v(authority, state)")
def g19_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.references(linked_corpus(spark, sf_dir), "NAT-7", reverse=True).completeness


@query("f3_section_edges", f"WITH {CUST} SELECT id || '#contact' AS src, nat || '#profile' AS dst FROM cust UNION ALL SELECT 'NAT-' || n_nationkey || '#profile', 'REG-' || n_regionkey || '#nations' FROM nation")
def f3_section_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from one section to another."""
    edges = resolve.addressed(resolve.reference_graph(linked_corpus(spark, sf_dir))[0])
    return edges.where("contains(src, '#') AND contains(dst, '#')").select("src", "dst")


@query("f5_known_addresses", f"WITH {CUST}, {GROUPS} SELECT id AS address FROM cust UNION ALL SELECT id || '#' || a FROM cust, (VALUES ('contact'), ('history'), ('early')) AS v(a) UNION ALL SELECT id || '#customer-' || k FROM cust UNION ALL SELECT 'NAT-' || n_nationkey || a FROM nation, (VALUES (''), ('#profile')) AS v(a) UNION ALL SELECT 'NAT-' || n_nationkey || '#' || lower(n_name) FROM nation UNION ALL SELECT 'REG-' || r_regionkey || a FROM region, (VALUES (''), ('#nations')) AS v(a) UNION ALL SELECT 'REG-' || r_regionkey || '#' || replace(lower(r_name), ' ', '-') FROM region UNION ALL SELECT 'IDX-' || i || a FROM (SELECT g + 10 AS i FROM groups UNION ALL SELECT 1 UNION ALL SELECT 2), (VALUES (''), ('#index')) AS v(a)")
def f5_known_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.known_addresses(resolve.addressed(resolve.reference_graph(linked_corpus(spark, sf_dir))[0]))


@query("f4_boundaries_from", "SELECT 'CUST-4#contact' AS address, 'none-4.md' AS raw_target, 'unknown-document' AS category")
def f4_boundaries_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.plans.synth import corpus

    found = resolve.boundaries_from(resolve.reference_graph(corpus(spark, sf_dir))[1], "CUST-4#contact")
    return found.select(resolve.address("src_doc", "src_anchor").alias("address"), "raw_target", "category")


@query("g9_cyclic_members", "SELECT 'alpha::ORD-' || o_orderkey AS member FROM orders WHERE o_orderkey // 4 * 4 + 3 <= (SELECT max(o_orderkey) FROM orders)")
def g9_cyclic_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of rings of four orders each, in qualified edges; a last part of a ring is none."""
    k = F.col("o_orderkey")
    name = lambda c: F.concat(F.lit("alpha::ORD-"), c.cast("string"))
    first = F.floor(k / 4) * 4
    rings = read_table(spark, sf_dir, "orders").select("o_orderkey").withColumn("top", F.lit(read_table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0])).where(first + 3 <= F.col("top"))
    edges = rings.select(name(k).alias("source_id"), name(first + (k + 1) % 4).alias("target_id"), F.lit("depends_on").alias("relation"), F.lit(None).cast("long").alias("pin"))
    return federation.federated_cycles(edges).select(F.col("source_id").alias("member")).distinct()


@query("q5_change_plan", f"WITH {CUST} SELECT 'REG-' || n_regionkey AS address, 'read' AS disposition, 1 AS n FROM nation WHERE n_nationkey = 7 UNION ALL SELECT id, 'review', 2 FROM cust WHERE n = 7 UNION ALL SELECT 'IDX-1#index', 'review', 1")
def q5_change_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = commands.change_plan(linked_corpus(spark, sf_dir), "NAT-7").rows
    return found.select("address", "disposition", F.size("reasons").alias("n"))


@query("g22_execution_plan", "SELECT 'REG-' || n_regionkey AS address, 'read' AS disposition FROM nation WHERE n_nationkey = 7")
def g22_execution_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a handoff of one nation's document has to read."""
    return commands.execution_plan(linked_corpus(spark, sf_dir), ("NAT-7",)).where("disposition = 'read'").select("address", "disposition")


@query("q7_impact", f"WITH {CUST} SELECT id AS source_id, 'depends_on' AS relation, 'semantic' AS impact FROM cust WHERE n = 7 UNION ALL SELECT id, 'validated_against', CASE WHEN k % 2 = 0 THEN 'freshness pin (current)' ELSE 'freshness pin (already stale)' END FROM cust WHERE n = 7")
def q7_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.impact(linked_corpus(spark, sf_dir), "NAT-7").rows.select("source_id", "relation", "impact")


# Packets -----------------------------------------------------------------------------------
@query("q6_context", f"WITH {CUST} SELECT 'CUST-7' AS document_id, 0 AS distance UNION SELECT nat, 1 FROM cust WHERE k = 7 UNION SELECT 'CUST-6', 1 UNION SELECT 'REG-' || n_regionkey, 2 FROM nation JOIN cust ON n = n_nationkey WHERE k = 7 UNION SELECT b.nat, 2 FROM cust a JOIN cust b ON a.k = 7 AND b.k = 6 AND a.n <> b.n")
def q6_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    packet = commands.context(linked_corpus(spark, sf_dir), "CUST-7", depth=2, include_related=True)
    return packet["documents"].select("document_id", "distance")


@query("q6_include", "SELECT 'CUST-7' AS document_id, 'contact' AS anchor UNION ALL SELECT 'CUST-9', 'history'")
def q6_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a packet: one asked for, one of a document that only ``include`` brings."""
    packet = commands.context(linked_corpus(spark, sf_dir), "CUST-7", anchors=("contact",), include=("CUST-9#history", "CUST-11"), assume_known=("CUST-11",))
    return packet["sections"].select("document_id", "anchor")


@query("q6_outline", f"WITH {CUST} SELECT 'CUST-7' AS document_id, * FROM (VALUES (1, 'customer-7'), (2, 'contact'), (2, 'history'), (3, 'early')) AS v(level, anchor) UNION ALL SELECT nat, 1, lower(n_name) FROM cust JOIN nation ON n_nationkey = n WHERE k = 7 UNION ALL SELECT nat, 2, 'profile' FROM cust WHERE k = 7")
def q6_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.context(linked_corpus(spark, sf_dir), "CUST-7")["outline"].select("document_id", "level", "anchor")


@query("q6_manifest", "SELECT 'CUST-7#history' AS address, false AS merged UNION ALL SELECT 'CUST-7#early', false")
def q6_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two addresses that one fragment answers, as the inner section lies in the outer."""
    packet = commands.context(linked_corpus(spark, sf_dir), "CUST-7", anchors=("history", "early"))
    one = packet["fragments"].count()
    return packet["manifest"].select("address", F.lit(one != 1).alias("merged"))


@query(
    "a19_packet_stats",
    f"WITH {PAGES} SELECT CAST(sum(octet_length(encode(top))) FILTER (id IN (SELECT 'CUST-7' UNION ALL SELECT nat FROM cust WHERE k = 7)) AS BIGINT) AS packet_bytes, CAST(sum(octet_length(encode(top || rest))) AS BIGINT) AS corpus_bytes FROM pages",
)
def a19_packet_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a packet of depth 1, and of the corpus: the share is what a task has to read."""
    c = linked_corpus(spark, sf_dir)
    return commands.packet_stats(commands.context(c, "CUST-7"), c).select("packet_bytes", "corpus_bytes")


@query("g12_view", f"WITH {CUST} SELECT 'NAT-7' AS document_id, 0 AS distance UNION ALL SELECT id, 1 FROM cust WHERE n = 7 UNION ALL SELECT 'REG-' || n_regionkey, 1 FROM nation WHERE n_nationkey = 7")
def g12_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view in both directions over one relation."""
    return commands.context(linked_corpus(spark, sf_dir), "NAT-7", view="around")["documents"].select("document_id", "distance")


@query("g12_depth_omissions", f"WITH {CUST}, i AS (SELECT id FROM cust WHERE n = 7) SELECT 'REG-' || a.n_regionkey AS source_id, 'reverse:depends_on' AS relation, 'NAT-' || b.n_nationkey AS target_id, 'depth-limit' AS reason FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 7 AND b.n_nationkey <> 7 UNION ALL SELECT a.id, 'related', 'CUST-' || (a.k - 1), 'relation-filter' FROM cust a WHERE a.n = 7 AND a.k % 2 = 1 AND 'CUST-' || (a.k - 1) NOT IN (FROM i) UNION ALL SELECT 'CUST-' || (a.k - 1), 'reverse:related', a.id, 'relation-filter' FROM cust a WHERE a.k % 2 = 1 AND a.n <> 7 AND 'CUST-' || (a.k - 1) IN (FROM i)")
def g12_depth_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = commands.context(linked_corpus(spark, sf_dir), "NAT-7", view="around")["omissions"]
    return found.select("source_id", "relation", "target_id", "reason")


@query("q17_finish", f"WITH {CUST} SELECT id AS document_id, 'reverse:depends_on,reverse:validated_against' AS relations FROM cust WHERE n = 7")
def q17_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.finish(linked_corpus(spark, sf_dir), "NAT-7")["dependents"].select("document_id", F.array_join("relations", ",").alias("relations"))


@query("q17_included", f"WITH {CUST} SELECT 'CUST-7' AS document_id, 'contact,history' AS omitted_h2 UNION ALL SELECT nat, 'profile' FROM cust WHERE k = 7")
def q17_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a finished task's packet held, and the H2 sections it left out."""
    return commands.finish(linked_corpus(spark, sf_dir), "CUST-7")["included"].select("document_id", F.array_join("omitted_h2", ",").alias("omitted_h2"))


@query("q17_freshness", f"WITH {CUST} SELECT id AS source_id, nat AS target_id, CAST(k % 2 + 1 AS BIGINT) AS pin, CASE WHEN k % 2 = 0 THEN 'current' ELSE 'stale' END AS state FROM cust WHERE k = 7")
def q17_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.finish(linked_corpus(spark, sf_dir), "CUST-7")["freshness"].select("source_id", "target_id", "pin", "state")


@query("q28_report", f"WITH {CUST}, {GROUPS}, stale AS (SELECT count(*) AS n FROM cust WHERE k % 2 = 1) SELECT name, CAST(value AS VARCHAR) AS value FROM (SELECT 'errors' AS name, 0 AS value UNION ALL SELECT 'warnings', n FROM stale UNION ALL SELECT 'adoption_resolved', 0 UNION ALL SELECT 'adoption_boundaries', 0 UNION ALL SELECT 'stale_pins', n FROM stale UNION ALL SELECT 'pins.stale', n FROM stale UNION ALL SELECT 'pins.current', (SELECT count(*) FROM cust) - n FROM stale UNION ALL SELECT 'documents', (SELECT count(*) FROM cust) + (SELECT count(*) FROM groups) + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + 2)")
def q28_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.report(linked_corpus(spark, sf_dir))


@query("q28_context_gap", "SELECT 'initial' AS kind, 'CUST-7' AS address, CAST(1 AS BIGINT) AS revision, CAST(NULL AS INTEGER) AS start_line, CAST(NULL AS INTEGER) AS end_line UNION ALL SELECT 'expanded', 'CUST-9#history', 1, 15, 19")
def q28_context_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of a report on a packet that lacked a section: revisions and lines, no text."""
    return commands.context_gap(linked_corpus(spark, sf_dir), "missing_section", ("CUST-7",), ("CUST-9#history",), ("plan",))


# Health and inventory ----------------------------------------------------------------------
@query("q8_graph_health", f"WITH {CUST}, {GROUPS} SELECT 'pin' AS kind, CASE WHEN k % 2 = 0 THEN 'current' ELSE 'stale' END AS name, CAST(count(*) AS BIGINT) AS n FROM cust GROUP BY ALL UNION ALL SELECT 'missing', 'weight', (SELECT count(*) FROM cust WHERE k % 3 = 0) + (SELECT count(*) FROM groups) + 2 + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) UNION ALL SELECT 'components', '', 1")
def q8_graph_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = commands.graph_health(linked_corpus(spark, sf_dir))
    pins = health["pins"].select(F.lit("pin").alias("kind"), F.col("state").alias("name"), "n")
    missing = health["missing_metadata"].groupBy(F.lit("missing").alias("kind"), F.col("field").alias("name")).agg(F.count("*").alias("n"))
    return pins.unionByName(missing).unionByName(health["components"].agg(F.lit("components").alias("kind"), F.lit("").alias("name"), F.count("*").alias("n")))


@query("a8_weak_component_signal", "WITH d AS (SELECT r_regionkey AS r, 'REG-' || r_regionkey AS id FROM region UNION ALL SELECT n_regionkey, 'NAT-' || n_nationkey FROM nation UNION ALL SELECT n_regionkey, 'CUST-' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey), s AS (SELECT r, count(*) AS n, min(id) AS least FROM d GROUP BY r) SELECT id AS document_id, (SELECT count(*) FROM s) AS value FROM d WHERE r <> (SELECT r FROM s ORDER BY n DESC, least LIMIT 1)")
def a8_weak_component_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents outside the largest of the parts into which authored relations divide them."""
    c = linked_corpus(spark, sf_dir)
    own = resolve.dependency_edges(c).where("relation = 'depends_on'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "relation", F.lit("authored").alias("authority"))
    docs = c.documents.where("document_id IS NOT NULL AND doc_type <> 'index'")
    return analytics.weak_component_signal(analytics.weak_components(docs, own), 1).select("document_id", "value")


@query("q9_inventory", f"WITH {CUST}, {GROUPS}, t AS (SELECT (SELECT count(*) FROM cust) AS c, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r, (SELECT count(*) + 2 FROM groups) AS i) SELECT name, CAST(p AS BIGINT) AS present, CAST(c + n + r + i - p AS BIGINT) AS missing, types AS value_types FROM (SELECT c, n, r, i, unnest([('id', c + n + r + i, 'string'), ('revision', c + n + r + i, 'integer'), ('type', c + n + r + i, 'string'), ('status', c, 'string'), ('depends_on', c + n, 'sequence'), ('validated_against', c, 'sequence'), ('related', c // 2, 'sequence'), ('weight', c - (c + 2) // 3, 'integer,string')]) AS u FROM t), LATERAL (SELECT u[1] AS name, u[2] AS p, u[3] AS types)")
def q9_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.metadata_inventory(linked_corpus(spark, sf_dir)).rows.select("name", "present", "missing", "value_types")


@query("q9_field", "SELECT 'CUST-' || c_custkey AS document_id, CASE c_custkey % 3 WHEN 1 THEN 'integer' ELSE 'string' END AS value_type, CASE c_custkey % 3 WHEN 1 THEN '7' ELSE '\"heavy\"' END AS value_json FROM customer WHERE c_custkey % 3 > 0")
def q9_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.metadata_inventory(linked_corpus(spark, sf_dir), "weight").rows


@query("q10_profile_check", "SELECT 'CUST-' || c_custkey AS document_id, 'missing-role' AS code, 'notes' AS subject FROM customer UNION ALL SELECT 'CUST-' || c_custkey, 'missing-metadata', 'weight' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'CUST-' || c_custkey, 'status-not-allowed', lower(c_mktsegment) FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'machinery')")
def q10_profile_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.profile_check(linked_corpus(spark, sf_dir)).rows.select("document_id", "code", "subject")


# Snapshots -----------------------------------------------------------------------------------
@query("q16_changes", "SELECT 'CUST-' || c_custkey AS document_id, 'changed' AS change FROM customer WHERE c_custkey % 5 = 0")
def q16_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that differ from a generation, named by the first 12 characters of its hash."""
    root, name = _generation(spark, linked_corpus(spark, sf_dir))
    return commands.changes(linked_corpus(spark, sf_dir, later=True), root, name[:12])["documents"]


@query("q6c_section_changes", "SELECT 'CUST-' || c_custkey AS document_id, a AS anchor, 'changed' AS change FROM customer, LATERAL (SELECT unnest(['history', 'customer-' || c_custkey]) AS a) WHERE c_custkey % 5 = 0")
def q6c_section_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, name = _generation(spark, linked_corpus(spark, sf_dir))
    return commands.changes(linked_corpus(spark, sf_dir, later=True), root, name)["sections"]


@query("q6a_packet_since", f"WITH {CUST} SELECT 'CUST-5' AS document_id, 'changed' AS state UNION ALL SELECT nat, 'unchanged' FROM cust WHERE k = 5")
def q6a_packet_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a packet's documents are against an earlier generation."""
    root, name = _generation(spark, linked_corpus(spark, sf_dir))
    return commands.context(linked_corpus(spark, sf_dir, later=True), "CUST-5", since=name, root=root)["state"].select("document_id", "state")


@query("k6_shards", f"WITH {CUST} SELECT id AS document_id, 'CUST' AS namespace, CAST(k % 100 AS INTEGER) AS bucket FROM cust")
def k6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = snapshots.with_shard(snapshots.document_table(linked_corpus(spark, sf_dir)))
    return own.where("doc_type = 'customer'").select("document_id", "namespace", "bucket")


@query("s10_targeted", f"WITH {CUST} SELECT 'depends_on' AS relation, id AS src_doc FROM cust WHERE n = 7 UNION ALL SELECT 'validated_against', id FROM cust WHERE n = 7 UNION ALL SELECT 'references', id FROM cust WHERE n = 7 UNION ALL SELECT 'contains', 'NAT-7' FROM (VALUES (1), (2)) UNION ALL SELECT 'references', 'IDX-1'")
def s10_targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming edges of one document, read from its bucket alone (F16)."""
    root, name = _generation(spark, linked_corpus(spark, sf_dir))
    return snapshots.read_generation(spark, root, name, "reverse_edges", "NAT-7").select("relation", "src_doc")


@query("s9_verified", f"WITH {PAGES} SELECT id AS document_id, sha256(top || rest) AS source_sha256 FROM pages")
def s9_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generation's documents, read only if it is current and its tables hash as written."""
    c = linked_corpus(spark, sf_dir)
    root, name = _generation(spark, c)
    return snapshots.load_verified(c, root, "documents").select("document_id", "source_sha256")


# Federation ----------------------------------------------------------------------------------
def _sources(spark: SparkSession, sf_dir: str) -> dict[str, Corpus]:
    return {"alpha": linked_corpus(spark, sf_dir), "beta": linked_corpus(spark, sf_dir, later=True)}


@query("q25_federation_impact", f"WITH {CUST} SELECT 'alpha::' || id AS source_id, 'depends_on' AS relation, 'semantic' AS impact FROM cust WHERE n = 7 UNION ALL SELECT 'alpha::' || id, 'validated_against', CASE WHEN k % 2 = 0 THEN 'freshness pin (current)' ELSE 'freshness pin (stale)' END FROM cust WHERE n = 7")
def q25_federation_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.federation_impact(_sources(spark, sf_dir), "alpha::NAT-7").select("source_id", "relation", "impact")


@query("g13_federation_context", f"WITH {CUST} SELECT 'beta::CUST-7' AS document_id, 0 AS distance UNION ALL SELECT 'beta::' || nat, 1 FROM cust WHERE k = 7")
def g13_federation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.federation_context(_sources(spark, sf_dir), "beta::CUST-7").select("document_id", "distance")


@query("k4_federated_objects", f"WITH {CUST}, {GROUPS}, n AS (SELECT (SELECT count(*) FROM cust) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) + 2 FROM groups) AS n) SELECT 'alpha' AS source, CAST(n AS BIGINT) AS documents, true AS reused FROM n UNION ALL SELECT 'beta', n, false FROM n")
def k4_federated_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second snapshot of two sources: the one that did not change is not written again."""
    both, root = _sources(spark, sf_dir), f"{shared_dir(spark).rstrip('/')}/federated-{uuid.uuid4().hex}"
    snapshots.write_federated({"alpha": both["alpha"], "beta": both["alpha"]}, root, policy_of={"beta": "first"})
    found = snapshots.write_federated(both, root)
    counts = snapshots.read_federated(spark, root, "documents").groupBy("source").agg(F.count("*").alias("documents"))
    return counts.join(spark.createDataFrame([(s, r) for s, r in found.items()], "source string, reused boolean"), "source")
