"""Every query of the library by name, with the SQL that checks it.

Names begin with the operators' IDs where a query shows one operator alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import analytics, federation, governance, program, ranges, resolve, snapshots, traverse, validate
from corpusloom.plans import commands
from corpusloom.plans.session import read_table, shared_dir
from corpusloom.plans.synth import POLICY, corpus, rendered
from corpusloom.sources.corpus import build_corpus, memberships

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


DEPS = """deps AS (
  SELECT 'depends_on' AS relation, 'NAT-' || n_nationkey AS source_id, 'REG-' || n_regionkey AS target_id, CAST(NULL AS BIGINT) AS pin FROM nation
  UNION ALL SELECT 'depends_on', 'CUST-' || c_custkey, 'NAT-' || c_nationkey, NULL FROM customer
  UNION ALL SELECT 'derived_from', 'ORD-' || o_orderkey, 'CUST-' || o_custkey, NULL FROM orders
  UNION ALL SELECT 'validated_against', 'ORD-' || o_orderkey, 'CUST-' || o_custkey, CAST(1 + o_orderkey % 3 AS BIGINT) FROM orders)"""
LINES = """lines AS (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS again,
         count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
DOCS = """docs AS (
  SELECT 'REG-' || r_regionkey AS id, 'geo/REG-' || r_regionkey || '.md' AS path, CAST(1 + r_regionkey % 3 AS BIGINT) AS revision, 'region' AS doc_type, CAST(NULL AS VARCHAR) AS status FROM region
  UNION ALL SELECT 'NAT-' || n_nationkey, 'geo/NAT-' || n_nationkey || '.md', 1 + n_nationkey % 3, 'nation', NULL FROM nation
  UNION ALL SELECT 'CUST-' || c_custkey, 'customers/CUST-' || c_custkey || '.md', 1 + c_custkey % 3, 'customer', lower(c_mktsegment) FROM customer
  UNION ALL SELECT 'ORD-' || o_orderkey, 'orders/ORD-' || o_orderkey || '.md', 1, 'order', o_orderstatus FROM orders)"""
LINKS = """links AS (
  SELECT 'REG-' || n_regionkey AS src_doc, 'nations' AS src_anchor, 'NAT-' || n_nationkey AS dst_doc, 'profile' AS dst_anchor FROM nation
  UNION ALL SELECT 'NAT-' || n_nationkey, 'profile', 'REG-' || n_regionkey, 'nations' FROM nation
  UNION ALL SELECT 'CUST-' || c_custkey, 'contact', 'NAT-' || c_nationkey, 'profile' FROM customer)"""


# Sources and parsing ------------------------------------------------------------
@query("s1_documents", f"WITH {DOCS} SELECT id AS document_id, path, revision, doc_type, status FROM docs")
def s1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).documents.select("document_id", "path", "revision", "doc_type", "status")


@query(
    "s3_memberships",
    """SELECT 'CUST-' || c_custkey || '.md' AS name, CASE WHEN c_custkey % 10 = 3 THEN 'excluded' ELSE 'included' END AS state,
  CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE 'customers' END AS role, CASE WHEN c_custkey % 10 = 3 THEN 'customers/**/*3.md' END AS reason FROM customer""",
)
def s3_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    files = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("customers/CUST-"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"))
    found = memberships(files, replace(POLICY, exclude=("customers/**/*3.md", "customers/*33.md")))
    return found.select(F.substring("path", 11, 99).alias("name"), "state", "role", "reason")


@query(
    "p5_sections_of_order",
    f"""WITH {LINES}
SELECT 'ORD-' || l_orderkey AS document_id, pos AS ordinal, 'Line ' || l_linenumber AS title, 'line-' || l_linenumber || CASE WHEN again > 0 THEN '-' || again ELSE '' END AS anchor,
  2 AS level, 9 + 2 * pos AS start_line, 10 + 2 * pos AS end_line FROM lines""",
)
def p5_sections_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus(spark, sf_dir).headings.where("document_id LIKE 'ORD-%' AND level = 2")
    return found.select("document_id", F.col("ordinal").cast("long").alias("ordinal"), "title", "anchor", F.col("level").cast("int").alias("level"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query(
    "p8_section_bytes",
    f"""WITH {LINES} SELECT 'ORD-' || l_orderkey AS document_id, pos AS ordinal, CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes, sha256(t) AS sha256
FROM (SELECT l_orderkey, pos, '## Line ' || l_linenumber || chr(10) || 'part ' || p || chr(10) AS t FROM (
  SELECT l_orderkey, l_linenumber, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey))""",
)
def p8_section_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus(spark, sf_dir).sections.where("document_id LIKE 'ORD-%' AND level = 2")
    return found.select("document_id", F.col("ordinal").cast("long").alias("ordinal"), "n_bytes", "sha256")


@query("f9_doc_sha", "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def f9_doc_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(
    "p11_links",
    f"WITH {LINKS} SELECT src_doc, src_anchor, dst_doc, dst_anchor FROM links",
)
def p11_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_links(corpus(spark, sf_dir))[0].select("src_doc", "src_anchor", "dst_doc", "dst_anchor")


# Joins ------------------------------------------------------------------------------
@query("j1_dependencies", f"WITH {DEPS} SELECT * FROM deps")
def j1_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.dependency_edges(corpus(spark, sf_dir))


@query("j2_unknown_refs", "SELECT 'CUST-' || c_custkey AS document_id, 'related' AS relation, 'CUST-' || (c_custkey + 10000000) AS target FROM customer WHERE c_custkey % 7 = 0")
def j2_unknown_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unknown_references(corpus(spark, sf_dir)).select("document_id", "relation", "target")


@query(
    "j4_boundaries",
    """SELECT 'CUST-' || c_custkey AS src_doc, 'contact' AS src_anchor,
  CASE c_custkey % 5 WHEN 0 THEN '../geo/NAT-' || c_nationkey || '.md#nowhere' WHEN 1 THEN 'https://example.com/' || c_custkey WHEN 2 THEN 'logo.png' WHEN 3 THEN '../../../etc/p.md' ELSE 'none-' || c_custkey || '.md' END AS raw_target,
  CASE c_custkey % 5 WHEN 0 THEN 'missing-anchor' WHEN 1 THEN 'external' WHEN 2 THEN 'resource' WHEN 3 THEN 'outside-root' ELSE 'unknown-document' END AS category FROM customer""",
)
def j4_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_links(corpus(spark, sf_dir))[1].select("src_doc", "src_anchor", "raw_target", "category")


@query(
    "j4_page_links",
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS raw FROM pages)
SELECT page_id, raw, CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.\\-]*:') OR raw LIKE '//%' THEN 'external' WHEN split_part(split_part(raw, '#', 1), '?', 1) = '' THEN 'fragment' ELSE 'internal' END AS category FROM l""",
)
def j4_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_table(spark, sf_dir, "pages").select("page_id", F.lit("").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("raw"))
    found = resolve.split_targets(found)
    return found.select("page_id", "raw", F.when(F.col("is_external"), "external").when(F.col("target_path").isNull(), "fragment").otherwise("internal").alias("category"))


@query(
    "j6_pin_states",
    """SELECT 'ORD-' || o_orderkey AS source_id, 'CUST-' || o_custkey AS target_id, CAST(1 + o_orderkey % 3 AS BIGINT) AS pin, CAST(1 + o_custkey % 3 AS BIGINT) AS current_revision,
  CASE WHEN o_orderkey % 3 = o_custkey % 3 THEN 'current' ELSE 'stale' END AS state FROM orders""",
)
def j6_pin_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.pin_states(corpus(spark, sf_dir))


@query(
    "j17_snapshot_diff",
    """WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 3), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 4)
SELECT CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS document_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""",
)
def j17_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", "text")
    old = docs.where("doc_id % 11 <> 3").select("document_id", F.sha2("text", 256).alias("source_sha256"))
    new = docs.where("doc_id % 13 <> 4").select("document_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("source_sha256"))
    return snapshots.document_changes(old, new)


@query(
    "j22_impact",
    """SELECT 'CUST-' || o_custkey AS target_id, 'ORD-' || o_orderkey AS source_id, relation, CASE WHEN relation = 'derived_from' THEN 'semantic' WHEN o_orderkey % 3 = o_custkey % 3 THEN 'freshness pin (current)' ELSE 'freshness pin (already stale)' END AS impact
FROM orders, (VALUES ('derived_from'), ('validated_against')) AS r(relation)
UNION ALL SELECT 'NAT-' || c_nationkey, 'CUST-' || c_custkey, 'depends_on', 'semantic' FROM customer UNION ALL SELECT 'REG-' || n_regionkey, 'NAT-' || n_nationkey, 'depends_on', 'semantic' FROM nation""",
)
def j22_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return analytics.impact(c, resolve.dependency_edges(c)).select("target_id", "source_id", "relation", "impact")


# Graph -------------------------------------------------------------------------------
@query(
    "g2_edges",
    f"""WITH {LINKS}, {DEPS}, {LINES} SELECT relation, authority, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'references' AS relation, 'observed' AS authority FROM links UNION ALL SELECT relation, 'authored' FROM deps
  UNION ALL SELECT 'contains', 'generated' FROM lines UNION ALL SELECT 'contains', 'generated' FROM orders
  UNION ALL SELECT 'contains', 'generated' FROM customer, range(2) UNION ALL SELECT 'contains', 'generated' FROM nation, range(2) UNION ALL SELECT 'contains', 'generated' FROM region, range(2)) GROUP BY ALL""",
)
def g2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.reference_graph(corpus(spark, sf_dir))[0].groupBy("relation", "authority").agg(F.count("*").alias("n"))


def _authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = resolve.dependency_edges(corpus(spark, sf_dir))
    return edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "relation", F.lit("authored").alias("authority"), F.lit("metadata").alias("origin"), F.lit(None).cast("string").alias("reason"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).documents.where("doc_type = 'region'").select(F.col("document_id").alias("start"))


@query(
    "refs_transitive",
    """WITH w AS (SELECT 'REG-' || n_regionkey AS r, 'NAT-' || n_nationkey AS n, 'CUST-' || c_custkey AS c, 'ORD-' || o_orderkey AS o FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey)
SELECT DISTINCT r AS start, n AS address, 1 AS distance, 'depends_on' AS relation, r || ' ' || n AS path FROM w
UNION ALL SELECT DISTINCT r, c, 2, 'depends_on', r || ' ' || n || ' ' || c FROM w WHERE c IS NOT NULL
UNION ALL SELECT DISTINCT r, o, 3, 'derived_from', r || ' ' || n || ' ' || c || ' ' || o FROM w WHERE o IS NOT NULL""",
)
def refs_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that depends on each region, with its proving path."""
    found = traverse.traverse(_authored(spark, sf_dir), _regions(spark, sf_dir), reverse=True)
    return found.select("start", "address", "distance", "relation", F.array_join("path", " ").alias("path"))


@query(
    "refs_all_reasons",
    """WITH w AS (SELECT 'REG-' || n_regionkey AS r, 'NAT-' || n_nationkey AS n, 'CUST-' || c_custkey AS c, 'ORD-' || o_orderkey AS o FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey)
SELECT DISTINCT r AS start, n AS address, 1 AS distance, 'depends_on' AS relation, r || ' ' || n AS path FROM w
UNION ALL SELECT DISTINCT r, c, 2, 'depends_on', r || ' ' || n || ' ' || c FROM w WHERE c IS NOT NULL
UNION ALL SELECT DISTINCT r, o, 3, relation, r || ' ' || n || ' ' || c || ' ' || o FROM w, (VALUES ('derived_from'), ('validated_against')) AS v(relation) WHERE o IS NOT NULL""",
)
def refs_all_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct reason at minimal distance."""
    found = traverse.traverse_reasons(_authored(spark, sf_dir), _regions(spark, sf_dir), reverse=True)
    return found.select("start", "address", "distance", "relation", F.array_join("path", " ").alias("path"))


@query(
    "g6_cycles",
    """SELECT 'step' AS relation, string_agg('N-' || k, ',' ORDER BY 'N-' || k) AS members FROM (SELECT o_orderkey AS k, o_orderkey // 3 AS g FROM orders) GROUP BY g""",
)
def g6_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of three orders each, joined by edges that close no ring."""
    k = F.col("o_orderkey")
    own = read_table(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit("N-"), c.cast("string"))
    ring = own.select(name(k).alias("src"), name(F.floor(k / 3) * 3 + (k + 1) % 3).alias("dst"), F.lit("step").alias("relation"))
    bridge = own.where("o_orderkey >= 3").select(name(k).alias("src"), name(k - 3).alias("dst"), F.lit("step").alias("relation"))
    return traverse.cycles(ring.unionByName(bridge)).select("relation", F.array_join("members", ",").alias("members"))


@query(
    "g8_weak_components",
    """WITH RECURSIVE none AS (SELECT 1) SELECT 'CUST-' || c_custkey AS document_id, least('CUST-' || c_custkey, coalesce((SELECT min('ORD-' || o_orderkey) FROM orders WHERE o_custkey = c_custkey), 'CUST-' || c_custkey)) AS component FROM customer
UNION ALL SELECT 'ORD-' || o_orderkey, least('CUST-' || o_custkey, min('ORD-' || o_orderkey) OVER (PARTITION BY o_custkey)) FROM orders""",
)
def g8_weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).documents.where("doc_type IN ('customer', 'order')")
    edges = _authored(spark, sf_dir).where("relation = 'derived_from'")
    return analytics.weak_components(docs, edges)


@query(
    "context_depth2",
    f"""WITH {DEPS}, one AS (SELECT source_id AS start, target_id AS document_id, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM deps GROUP BY ALL)
SELECT id AS start, id AS document_id, 0 AS distance, '' AS relations FROM (SELECT 'ORD-' || o_orderkey AS id FROM orders)
UNION ALL SELECT start, document_id, 1, relations FROM one WHERE start LIKE 'ORD-%'
UNION ALL SELECT a.start, b.document_id, 2, b.relations FROM one a JOIN one b ON a.document_id = b.start WHERE a.start LIKE 'ORD-%'""",
)
def context_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents within two steps of every order."""
    starts = corpus(spark, sf_dir).documents.where("doc_type = 'order'").select(F.col("document_id").alias("start"))
    found = traverse.context_selection(_authored(spark, sf_dir), starts, 2, ("depends_on", "derived_from", "validated_against"))
    return found.select("start", "document_id", "distance", F.array_join("relations", ",").alias("relations"))


@query(
    "view_omissions",
    """SELECT 'ORD-' || o_orderkey AS start, 'ORD-' || o_orderkey AS source_id, 'validated_against' AS relation, 'CUST-' || o_custkey AS target_id, 'relation-filter' AS reason FROM orders WHERE false
UNION ALL SELECT 'ORD-' || o_orderkey, 'CUST-' || o_custkey, 'depends_on', 'NAT-' || c_nationkey, 'relation-filter' FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def view_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a view of one relation and one step leaves out."""
    edges = _authored(spark, sf_dir)
    starts = corpus(spark, sf_dir).documents.where("doc_type = 'order'").select(F.col("document_id").alias("start"))
    wanted = ("derived_from",)
    return traverse.context_omissions(edges, traverse.context_selection(edges, starts, 1, wanted), 1, wanted)


# Aggregates ---------------------------------------------------------------------------
@query(
    "a2_edge_counts",
    f"""WITH {LINKS}, {DEPS} SELECT kind, name, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'authority' AS kind, 'observed' AS name FROM links UNION ALL SELECT 'relation', 'references' FROM links UNION ALL SELECT 'authority', 'authored' FROM deps UNION ALL SELECT 'relation', relation FROM deps) GROUP BY ALL""",
)
def a2_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = resolve.reference_graph(corpus(spark, sf_dir))
    return analytics.edge_counts(edges.where("authority <> 'generated'"))


@query("a3_boundary_counts", "SELECT CASE c_custkey % 5 WHEN 0 THEN 'missing-anchor' WHEN 1 THEN 'external' WHEN 2 THEN 'resource' WHEN 3 THEN 'outside-root' ELSE 'unknown-document' END AS category, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY ALL")
def a3_boundary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.boundary_counts(resolve.reference_graph(corpus(spark, sf_dir))[1])


@query(
    "a4_degrees",
    f"""WITH {DEPS}, {LINKS}, {DOCS}, e AS (SELECT source_id AS s, target_id AS t FROM deps UNION SELECT src_doc, dst_doc FROM links)
SELECT id AS document_id, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree FROM docs LEFT JOIN (SELECT t, count(*) AS n FROM e GROUP BY 1) i ON i.t = id LEFT JOIN (SELECT s, count(*) AS n FROM e GROUP BY 1) o ON o.s = id""",
)
def a4_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return analytics.degrees(c.documents, analytics.document_edges(resolve.reference_graph(c)[0]))


@query(
    "a6_orphans",
    "SELECT 'CUST-' || c_custkey AS document_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'NAT-' || n_nationkey FROM nation",
)
def a6_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, and customers without an order, when only orders' relations count as edges."""
    docs = corpus(spark, sf_dir).documents.where("doc_type IN ('customer', 'nation', 'order')")
    return analytics.orphans(docs, _authored(spark, sf_dir).where("relation <> 'depends_on'"))


@query(
    "a7_missing_metadata",
    f"""WITH {DOCS} SELECT id AS document_id, 'owner' AS field FROM docs WHERE doc_type <> 'customer' OR CAST(split_part(id, '-', 2) AS BIGINT) % 3 = 0
UNION ALL SELECT id, 'status' FROM docs WHERE status IS NULL""",
)
def a7_missing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.missing_metadata(corpus(spark, sf_dir).documents, POLICY.required_metadata)


@query(
    "a1_health_signals",
    f"""WITH {DEPS}, {LINKS}, {DOCS}, e AS (SELECT source_id AS s, target_id AS t FROM deps UNION SELECT src_doc, dst_doc FROM links)
SELECT 'high-in-degree' AS code, t AS document_id, CAST(count(*) AS BIGINT) AS value FROM e GROUP BY t HAVING count(*) >= 20
UNION ALL SELECT 'high-out-degree', s, count(*) FROM e GROUP BY s HAVING count(*) >= 3
UNION ALL SELECT 'boundary-concentration', 'CUST-' || c_custkey, 1 FROM customer
UNION ALL SELECT 'stale-pin-concentration', 'ORD-' || o_orderkey, 1 FROM orders WHERE o_orderkey % 3 <> o_custkey % 3
UNION ALL SELECT 'orphan-document', id, 0 FROM docs WHERE id NOT IN (SELECT s FROM e UNION SELECT t FROM e)
UNION ALL SELECT 'missing-metadata', id, CAST(status IS NULL AS BIGINT) + CAST(doc_type <> 'customer' OR CAST(split_part(id, '-', 2) AS BIGINT) % 3 = 0 AS BIGINT) FROM docs WHERE status IS NULL OR doc_type <> 'customer' OR CAST(split_part(id, '-', 2) AS BIGINT) % 3 = 0
UNION ALL SELECT 'dead-reference', 'CUST-' || c_custkey, 1 FROM customer WHERE c_custkey % 5 = 0""",
)
def a1_health_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return analytics.health_signals(c, *resolve.reference_graph(c))


@query(
    "a11_inventory",
    f"""WITH {DOCS}, f AS (
  SELECT id, doc_type, 'id' AS name, 'string' AS t FROM docs UNION ALL SELECT id, doc_type, 'revision', 'integer' FROM docs UNION ALL SELECT id, doc_type, 'type', 'string' FROM docs
  UNION ALL SELECT id, doc_type, 'status', 'string' FROM docs WHERE status IS NOT NULL
  UNION ALL SELECT id, doc_type, 'owner', 'string' FROM docs WHERE doc_type = 'customer' AND CAST(split_part(id, '-', 2) AS BIGINT) % 3 <> 0
  UNION ALL SELECT id, doc_type, 'weight', CASE WHEN CAST(split_part(id, '-', 2) AS BIGINT) % 2 = 0 THEN 'integer' ELSE 'string' END FROM docs WHERE doc_type = 'customer'
  UNION ALL SELECT id, doc_type, 'related', 'sequence' FROM docs WHERE doc_type = 'customer' AND CAST(split_part(id, '-', 2) AS BIGINT) % 7 = 0
  UNION ALL SELECT id, doc_type, 'depends_on', 'sequence' FROM docs WHERE doc_type IN ('customer', 'nation')
  UNION ALL SELECT id, doc_type, v, 'sequence' FROM docs, (VALUES ('derived_from'), ('validated_against')) AS x(v) WHERE doc_type = 'order')
SELECT name, CAST(count(DISTINCT id) AS BIGINT) AS present, CAST((SELECT count(*) FROM docs) - count(DISTINCT id) AS BIGINT) AS missing, string_agg(DISTINCT t, ',' ORDER BY t) AS value_types, string_agg(DISTINCT doc_type, ',' ORDER BY doc_type) AS doc_types, count(DISTINCT t) > 1 AS type_conflict FROM f GROUP BY name""",
)
def a11_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return analytics.metadata_inventory(analytics.field_rows(c.documents, c.relations), c.documents.where("document_id IS NOT NULL").count())


@query("f10_field_values", "SELECT 'CUST-' || c_custkey AS document_id, CASE WHEN c_custkey % 2 = 0 THEN 'integer' ELSE 'string' END AS value_type, CASE WHEN c_custkey % 2 = 0 THEN '7' ELSE '\"heavy\"' END AS value_json FROM customer")
def f10_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return analytics.field_occurrences(analytics.field_rows(c.documents, c.relations), "weight")


@query(
    "v8_profile_violations",
    """SELECT 'CUST-' || c_custkey AS document_id, 'missing-metadata' AS code, 'owner' AS subject, 'customer' AS profile FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'CUST-' || c_custkey, 'relation-not-allowed', 'related', 'customer' FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT 'CUST-' || c_custkey, 'status-not-allowed', lower(c_mktsegment), 'customer' FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'machinery')
UNION ALL SELECT 'ORD-' || o_orderkey, 'status-not-allowed', o_orderstatus, 'order' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'ORD-' || o_orderkey, 'missing-role', 'first-line', 'order' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (1, 2))""",
)
def v8_profile_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.profile_violations(corpus(spark, sf_dir))


@query(
    "a13_overlaps",
    "SELECT CAST(l_partkey AS VARCHAR) AS source, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
)
def a13_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.overlaps(read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("source"), F.col("l_suppkey").alias("owner")))


@query("j12_unowned", "SELECT CAST(p_partkey AS VARCHAR) AS source FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j12_unowned(spark: SparkSession, sf_dir: str) -> DataFrame:
    mappings = read_table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("source"))
    return analytics.unowned(read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source")), mappings)


@query(
    "g20_delivery_state",
    """SELECT CAST(p_partkey AS VARCHAR) AS source, CASE WHEN n > 1 THEN 'overlap' WHEN n = 1 THEN 'owned' ELSE 'unowned' END AS state FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey""",
)
def g20_delivery_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    mappings = read_table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("source"), F.col("l_suppkey").alias("owner"))
    return analytics.delivery_state(read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source")), mappings)


@query(
    "a14_duplicate_ids",
    "SELECT 'CUST-' || c_custkey AS target_id, 'error' AS severity, CAST(2 AS BIGINT) AS n FROM customer WHERE c_custkey % 50 = 0",
)
def a14_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files copied to another place; every copy is an error."""
    files = rendered(spark, sf_dir).where("path LIKE 'customers/%'")
    again = files.where(F.regexp_extract("path", r"CUST-(\d+)", 1).cast("long") % 50 == 0).withColumn("path", F.regexp_replace("path", "customers/", "customers/copies/"))
    issues = validate.metadata_issues(build_corpus(files.unionByName(again), POLICY))
    return issues.where("message LIKE 'duplicate document ID%'").groupBy("target_id", "severity").agg(F.count("*").alias("n"))


@query(
    "v2_issue_counts",
    """SELECT 'error' AS severity, 'unknown' AS what, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT 'warning', 'stale-pin', count(*) FROM orders WHERE o_orderkey % 3 <> o_custkey % 3""",
)
def v2_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = validate.metadata_issues(corpus(spark, sf_dir))
    return issues.groupBy("severity", F.coalesce("category", F.lit("unknown")).alias("what")).agg(F.count("*").alias("n"))


# Ranges and ranks -----------------------------------------------------------------------
@query(
    "a23_range_union",
    """WITH r AS (SELECT l_orderkey AS k, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS b FROM lineitem),
 m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
 i AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT k AS document_id, CAST(min(a) AS BIGINT) AS start_line, CAST(max(b) AS BIGINT) AS end_line FROM i GROUP BY k, g""",
)
def a23_range_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") * 10).cast("long").alias("start_line"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long")).cast("long").alias("end_line"))
    return ranges.range_union(rows)


@query(
    "f7_innermost_section",
    """WITH s AS (SELECT l_orderkey AS k, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS b FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS document_id, CAST(o_orderkey % 60 AS BIGINT) AS line, CAST(max(a) AS BIGINT) AS start_line FROM orders LEFT JOIN s ON k = o_orderkey AND o_orderkey % 60 BETWEEN a AND b GROUP BY 1, 2""",
)
def f7_innermost_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") * 10).cast("long").alias("start_line"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long")).cast("long").alias("end_line"))
    points = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderkey") % 60).cast("long").alias("line"))
    return ranges.innermost(points, sections)


MILESTONES = """m AS (SELECT c_custkey AS k, c_nationkey AS program, CAST(c_custkey % 4 AS BIGINT) AS priority, CASE c_custkey % 3 WHEN 0 THEN 'delivered' ELSE 'planned' END AS base, CASE WHEN c_custkey >= 5 THEN c_custkey - 5 END AS pre FROM customer)"""


@query(
    "a15_next_work",
    f"""WITH {MILESTONES}, s AS (SELECT m.*, CASE WHEN m.base = 'delivered' THEN 'delivered' WHEN p.base IS NULL OR p.base = 'delivered' THEN 'ready' ELSE 'waiting' END AS state FROM m LEFT JOIN m p ON p.k = m.pre)
SELECT CAST(program AS VARCHAR) AS program_id, 'start' AS action, CAST(k AS VARCHAR) AS milestone FROM (SELECT *, rank() OVER (PARTITION BY program ORDER BY priority) AS r FROM s WHERE state = 'ready') WHERE r = 1
UNION ALL SELECT CAST(program AS VARCHAR), CASE WHEN bool_and(state = 'delivered') THEN 'complete' ELSE 'blocked' END, NULL FROM s GROUP BY program HAVING NOT bool_or(state = 'ready')""",
)
def a15_next_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = program.milestone_states(_milestones(spark, sf_dir))
    return program.next_work(states).select("program_id", "action", "milestone")


def _milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    before: Column = F.when(k >= 5, F.array((k - 5).cast("string"))).otherwise(F.array().cast("array<string>"))
    return read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("program_id"), k.cast("string").alias("milestone"), (k % 4).cast("long").alias("priority"), F.when(k % 3 == 0, "delivered").otherwise("planned").alias("base_state"), before.alias("prerequisites"))


@query(
    "j14_unlocks",
    f"""WITH {MILESTONES} SELECT CAST(m.k AS VARCHAR) AS milestone, string_agg(CAST(n.k AS VARCHAR), ',' ORDER BY CAST(n.k AS VARCHAR)) AS unlocks FROM m JOIN m n ON n.pre = m.k GROUP BY m.k""",
)
def j14_unlocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.unlocks(_milestones(spark, sf_dir)).select("milestone", F.array_join("unlocks", ",").alias("unlocks"))


@query(
    "j15_owner_collisions",
    "SELECT CAST(s_suppkey AS VARCHAR) AS roadmap_id, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS programs FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1",
)
def j15_owner_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.owner_collisions(read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("roadmap_id"), F.col("l_returnflag").alias("program_id")))


@query(
    "g21_federated_union",
    """WITH d AS (SELECT 'alpha' AS source, 'CUST-' || c_custkey AS id FROM customer UNION ALL SELECT 'beta', 'CUST-' || c_custkey FROM customer WHERE c_custkey % 2 = 0),
 r AS (SELECT 'alpha' AS source, 'CUST-' || c_custkey AS owner, CASE c_custkey % 4 WHEN 0 THEN 'beta::CUST-' || c_custkey WHEN 1 THEN 'beta::CUST-' || c_custkey WHEN 2 THEN 'gamma::CUST-1' ELSE 'alpha::CUST-' || c_custkey END AS target FROM customer)
SELECT r.source || '::' || owner AS source_id, target AS target_id, CASE WHEN split_part(target, '::', 1) = r.source THEN 'self-source' WHEN split_part(target, '::', 1) = 'gamma' THEN 'unknown-source' WHEN d.id IS NULL THEN 'unknown-document' ELSE 'edge' END AS outcome FROM r LEFT JOIN d ON d.source || '::' || d.id = r.target""",
)
def g21_federated_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    own = read_table(spark, sf_dir, "customer").withColumn("document_id", F.concat(F.lit("CUST-"), k.cast("string")))
    documents = federation.qualified({"alpha": own.select("document_id"), "beta": own.where(k % 2 == 0).select("document_id")})
    target = F.when(k % 4 < 2, F.concat(F.lit("beta::"), "document_id")).when(k % 4 == 2, F.lit("gamma::CUST-1")).otherwise(F.concat(F.lit("alpha::"), "document_id"))
    refs = own.select(F.lit("alpha").alias("source"), "document_id", F.lit("related").alias("relation"), target.alias("target"), F.lit(None).cast("long").alias("pin"))
    return federation.resolve_targets(refs, documents).select("source_id", "target_id", "outcome")


# Plans, rules and snapshots --------------------------------------------------------------
@query(
    "p9_navigation",
    """SELECT 'ORD-' || o_orderkey AS document_id, sha256('---' || chr(10) || 'id: ORD-' || o_orderkey || chr(10) || 'revision: 1' || chr(10) || 'type: order' || chr(10) || 'status: ' || o_orderstatus || chr(10) || 'derived_from: [CUST-' || o_custkey || ']' || chr(10) || 'validated_against: [CUST-' || o_custkey || '@' || (1 + o_orderkey % 3) || ']' || chr(10) || '---' || chr(10) || '# Order ' || o_orderkey || chr(10)) AS sha256
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
def p9_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an order's document says before its first line section."""
    c = corpus(spark, sf_dir)
    own = c.parsed.where("doc_type = 'order'").where(F.exists("sections", lambda s: s["level"] == 2))
    return own.select("document_id", F.sha2(commands.navigation_text(c), 256).alias("sha256"))


@query("a10_pin_totals", "SELECT CASE WHEN o_orderkey % 3 = o_custkey % 3 THEN 'current' ELSE 'stale' END AS state, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def a10_pin_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.pin_states(corpus(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("n"))


@query(
    "a12_profile_counts",
    """SELECT 'customer' AS profile, CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (c_custkey % 3 = 0) + count(*) FILTER (c_custkey % 7 = 0) + count(*) FILTER (lower(c_mktsegment) NOT IN ('building', 'machinery')) AS BIGINT) AS violations FROM customer
UNION ALL SELECT 'order', count(*), count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) + count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (1, 2))) FROM orders""",
)
def a12_profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.profile_counts(corpus(spark, sf_dir))


@query("a17_next_id", "SELECT 'CUST-' || (max(c_custkey) + 1) AS document_id, 'customers/CUST-' || (max(c_custkey) + 1) || '.md' AS path FROM customer")
def a17_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([governance.next_id(corpus(spark, sf_dir), "CUST", "customers")], "document_id string, path string")


@query(
    "a22_transitions",
    """WITH h AS (SELECT CAST(o_custkey AS VARCHAR) AS workstream, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, CASE o_orderkey % 4 WHEN 0 THEN 'mandated' WHEN 1 THEN 'planned' WHEN 2 THEN 'implementing' ELSE 'blocked' END AS state FROM orders),
 s AS (SELECT *, lag(state) OVER (PARTITION BY workstream ORDER BY ordinal) AS before FROM h)
SELECT workstream, ordinal, CASE WHEN before IS NULL THEN 'invalid-start' ELSE 'invalid-transition' END AS code FROM s
WHERE (before IS NULL AND state <> 'mandated') OR (before IS NOT NULL AND NOT ((before = 'mandated' AND state IN ('planned', 'blocked')) OR (before = 'planned' AND state IN ('implementing', 'blocked')) OR (before = 'implementing' AND state = 'blocked')))""",
)
def a22_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(k % 4 == 0, "mandated").when(k % 4 == 1, "planned").when(k % 4 == 2, "implementing").otherwise("blocked")
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    history = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("workstream"), at.cast("long").alias("ordinal"), state.alias("state"), F.lit(1).alias("attempt"))
    return governance.transition_violations(history)


@query("a20_shared_finish", "SELECT CASE WHEN bool_and(r_regionkey % 3 = 0) THEN 'complete' WHEN bool_or(r_regionkey % 3 = 0) THEN 'partial' ELSE 'blocked' END AS status, CAST(count(*) FILTER (r_regionkey % 3 = 0) AS BIGINT) AS applied, CAST(count(*) FILTER (r_regionkey % 3 = 1) AS BIGINT) AS blocked, CAST(count(*) FILTER (r_regionkey % 3 = 2) AS BIGINT) AS skipped FROM region")
def a20_shared_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey") % 3
    return federation.finish_status(read_table(spark, sf_dir, "region").select(F.when(k == 0, "applied").when(k == 1, "blocked").otherwise("skipped").alias("status")))


@query(
    "j20_scope_result",
    """WITH b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS v FROM part WHERE p_partkey % 11 <> 0), c AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS v FROM part),
 d AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'x' WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS v FROM part WHERE p_partkey % 2 = 0)
SELECT 'p' || coalesce(b.k, d.k) AS path, CASE WHEN b.k IS NULL THEN 'outside' WHEN b.v IS DISTINCT FROM c.v AND d.k IS NULL THEN 'missing' WHEN b.v IS NOT DISTINCT FROM c.v THEN 'unchanged' ELSE 'mismatched' END AS outcome
FROM b LEFT JOIN c ON b.k = c.k FULL JOIN d ON d.k = b.k WHERE b.k IS NULL OR (b.v IS DISTINCT FROM c.v AND (d.k IS NULL OR c.v IS DISTINCT FROM d.v)) OR (b.v IS NOT DISTINCT FROM c.v AND d.k IS NOT NULL)""",
)
def j20_scope_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = read_table(spark, sf_dir, "part"), F.col("p_partkey")
    now = F.when(k % 3 == 0, F.col("p_type")).otherwise(F.col("p_name"))
    table = lambda df, v: df.select(F.concat(F.lit("p"), k.cast("string")).alias("path"), v.alias("sha256"))
    return governance.scope_result(table(part.where(k % 11 != 0), F.when(k % 5 != 0, F.col("p_name"))), table(part, now), table(part.where(k % 2 == 0), F.when(k % 7 == 0, "x").otherwise(now)))


@query("j18_source_diff", "SELECT n_name AS source, CASE WHEN n_nationkey % 5 = 0 THEN 'removed' WHEN n_nationkey % 5 = 1 THEN 'added' ELSE 'changed' END AS change FROM nation WHERE n_nationkey % 5 < 3")
def j18_source_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    base = read_table(spark, sf_dir, "nation").select(k, F.col("n_name").alias("source"), F.lit("d").alias("digest"), F.lit("p").alias("policy"), F.lit("available").alias("state"), F.lit(1).alias("documents"))
    return snapshots.source_changes(base.where(k % 5 != 1), base.where(k % 5 != 0).withColumn("documents", F.when(k % 5 == 2, 2).otherwise(F.col("documents"))))


@query(
    "g14_federated_references",
    """SELECT 'beta::NAT-' || c_nationkey AS start, 'alpha::CUST-' || c_custkey AS address, r AS relation, 1 AS distance FROM customer, (VALUES ('depends_on'), ('related')) AS v(r)
UNION ALL SELECT DISTINCT 'beta::NAT-' || c_nationkey, 'alpha::ORD-' || o_orderkey, 'derived_from', 2 FROM customer JOIN orders ON o_custkey = c_custkey""",
)
def g14_federated_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by address and relation, backwards from every nation of another source."""
    c, o = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edge = lambda df, src, dst, rel: df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("relation"), F.lit("authored").alias("authority"), F.lit("metadata").alias("origin"))
    outer = [edge(c, name("alpha::CUST-", "c_custkey"), name("beta::NAT-", "c_nationkey"), r) for r in ("depends_on", "related")]
    edges = outer[0].unionByName(outer[1]).unionByName(edge(o, name("alpha::ORD-", "o_orderkey"), name("alpha::CUST-", "o_custkey"), "derived_from"))
    starts = read_table(spark, sf_dir, "nation").select(name("beta::NAT-", "n_nationkey").alias("start"))
    return federation.federated_references(edges, starts, reverse=True).select("start", "address", "relation", "distance")


@query(
    "g17_dispositions",
    """SELECT 'CUST-' || c_custkey AS start, 'NAT-' || c_nationkey AS address, 'read' AS disposition, CAST(1 AS BIGINT) AS n_reasons FROM customer
UNION ALL SELECT 'CUST-' || c_custkey, 'REG-' || n_regionkey, 'read', 1 FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'CUST-' || o_custkey, 'ORD-' || o_orderkey, 'review', 2 FROM orders""",
)
def g17_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to read and to review before each customer's document changes."""
    edges = _authored(spark, sf_dir).withColumn("reason", F.lit(""))
    starts = corpus(spark, sf_dir).documents.where("doc_type = 'customer'").select(F.col("document_id").alias("start"))
    both = [traverse.traverse_reasons(edges, starts, back).withColumn("is_reverse", F.lit(back)) for back in (False, True)]
    return commands.dispositions(both[0].unionByName(both[1]))


@query("v5_reachability", f"WITH {DOCS} SELECT 'no index document above' AS message, CAST(count(*) AS BIGINT) AS n FROM docs")
def v5_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No folder of the rendered corpus has an index."""
    return validate.reachability_issues(corpus(spark, sf_dir)).groupBy("message").agg(F.count("*").alias("n"))


@query("v6_graph_issues", "SELECT 'customers/CUST-' || c_custkey || '.md' AS path, 'warning' AS severity, 'dead-reference' AS category FROM customer WHERE c_custkey % 5 = 0")
def v6_graph_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.graph_issues(corpus(spark, sf_dir)).select("path", "severity", "category")


@query(
    "v10_plan_violations",
    """WITH m AS (SELECT c_custkey AS k, CAST(c_nationkey AS VARCHAR) AS program_id, 'm' || c_custkey AS milestone FROM customer)
SELECT program_id, milestone, 'invalid-title' AS code FROM m WHERE k % 10 = 0 UNION ALL SELECT program_id, milestone, 'invalid-priority' FROM m WHERE k % 9 = 0
UNION ALL SELECT program_id, milestone, c FROM m, (VALUES ('self-prerequisite'), ('prerequisite-cycle')) AS v(c) WHERE k % 13 = 0
UNION ALL SELECT program_id, milestone, 'unknown-prerequisite' FROM m WHERE k % 17 = 0 AND k % 13 <> 0
UNION ALL SELECT program_id, milestone, CASE k % 4 WHEN 0 THEN 'document-only-source-contract' WHEN 1 THEN 'unknown-source-document' WHEN 2 THEN 'unknown-source-anchor' END FROM m WHERE k % 4 < 3""",
)
def v10_plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    key = F.concat(F.lit("m"), k.cast("string"))
    needs = F.when(k % 13 == 0, F.array(key)).when(k % 17 == 0, F.array(F.lit("lost"))).otherwise(F.array().cast("array<string>"))
    contract = F.when(k % 4 == 0, "CUST-1").when(k % 4 == 1, "DOC-9#x").when(k % 4 == 2, "CUST-1#nowhere").otherwise("CUST-1#contact")
    own = read_table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("program_id"), key.alias("milestone"), F.when(k % 10 != 0, "T").otherwise("").alias("title"), (k + 1).alias("ord"), F.when(k % 9 == 0, 0).otherwise(1).cast("long").alias("priority"),
        F.lit("planned").alias("authored_state"), none.alias("roadmap_id"), needs.alias("prerequisites"), F.array(contract).alias("source_contracts"), none.alias("waiting_for"), none.alias("reopen_when"),
    )
    c = corpus(spark, sf_dir)
    return program.plan_violations(own, c.documents, c.headings)


@query("k1_generation_edges", ORACLE_SQL["g2_edges"])
def k1_generation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges read back from a generation equal those resolved afresh."""
    c, root = corpus(spark, sf_dir), f"{shared_dir(spark).rstrip('/')}/generations-{uuid.uuid4().hex}"
    found = snapshots.read_generation(spark, root, snapshots.write_generation(c, root), "edges")
    return found.groupBy("relation", "authority").agg(F.count("*").alias("n"))
