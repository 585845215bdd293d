"""Federation: corpora of independent owners under qualified IDs ``source::ID``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.resolve import dependency_edges
from corpusloom.operators.traverse import cycles
from corpusloom.plans.session import materialize
from corpusloom.sources.corpus import Corpus


def qualified(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of several sources as one, with a leading column ``source``."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("source"), "*") for name, df in sorted(tables.items())))


def qualify(source: str, document: str) -> Column:
    return F.concat_ws("::", source, document)


def resolve_targets(references: DataFrame, documents: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Adds source_id, target_id and outcome to qualified references.

    An outcome is malformed, self-source, unknown-source, unknown-document,
    duplicate-edge (the source has it as a local edge already) or edge.
    """
    r = references.withColumns({"to_source": F.regexp_extract("target", "^([a-z][a-z0-9-]{0,31})::", 1), "to_id": F.regexp_extract("target", "::([A-Z][A-Z0-9]{1,15}-[0-9]+)$", 1)})
    sources = documents.select(F.col("source").alias("to_source"), F.lit(True).alias("has_source")).distinct()
    ids = documents.select(F.col("source").alias("to_source"), F.col("document_id").alias("to_id"), F.lit(True).alias("has_document")).distinct()
    found = r.join(F.broadcast(sources), "to_source", "left").join(ids, ["to_source", "to_id"], "left")  # as many rows as sources
    if local is not None:
        keys = local.select("source", F.col("source_id").alias("document_id"), "relation", F.col("target_id").alias("target"), F.lit(True).alias("is_local")).distinct()
        found = found.join(keys, ["source", "document_id", "relation", "target"], "left")
    else:
        found = found.withColumn("is_local", F.lit(None).cast("boolean"))
    outcome = (
        F.when((F.col("to_source") == "") | (F.col("to_id") == ""), "malformed")
        .when(F.col("to_source") == F.col("source"), "self-source")
        .when(F.col("has_source").isNull(), "unknown-source")
        .when(F.col("has_document").isNull(), "unknown-document")
        .when(F.col("is_local"), "duplicate-edge")
        .otherwise("edge")
    )
    return found.select(qualify("source", "document_id").alias("source_id"), F.col("target").alias("target_id"), "relation", "pin", outcome.alias("outcome"))


def federated_edges(corpora: dict[str, Corpus]) -> tuple[DataFrame, DataFrame]:
    """(edges, problems): local edges qualified, edges between sources, and what fails."""
    documents = qualified({s: c.unique.select("document_id") for s, c in corpora.items()})
    own = qualified({s: dependency_edges(c) for s, c in corpora.items()})
    outer = qualified({s: c.relations.where("kind = 'federated'").select("document_id", "relation", "target", "pin") for s, c in corpora.items()})
    found = materialize(resolve_targets(outer, documents), "federated")
    local = own.select(qualify("source", "source_id").alias("source_id"), qualify("source", "target_id").alias("target_id"), "relation", "pin")
    edges = local.unionByName(found.where("outcome = 'edge'").drop("outcome")).distinct()
    bad = found.where("outcome <> 'edge'").select("source_id", "target_id", F.col("outcome").alias("code"))
    return edges, bad.unionByName(pin_conflicts(edges)).unionByName(federated_cycles(edges))


def pin_conflicts(edges: DataFrame) -> DataFrame:
    """Targets that one document pins at several revisions."""
    pins = edges.where("relation = 'validated_against'").groupBy("source_id", "target_id").agg(F.countDistinct("pin").alias("n"))
    return pins.where("n > 1").select("source_id", "target_id", F.lit("pin-conflict").alias("code"))


def federated_cycles(edges: DataFrame) -> DataFrame:
    flat = edges.where("relation IN ('derived_from', 'depends_on', 'supersedes')").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "relation")
    member = cycles(flat).select(F.explode("members").alias("source_id"))
    return member.select("source_id", F.lit(None).cast("string").alias("target_id"), F.lit("cycle").alias("code"))


def federated_references(edges: DataFrame, starts: DataFrame, reverse: bool = False, transitive: bool = True) -> DataFrame:
    """(start, address, relation, authority, origin, distance): rows may share an address.

    Rows are distinct by (relation, authority, origin, address). An edge back to the
    start is a row, too, but is not followed.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    moves = edges.select(F.col(a).alias("here"), F.col(b).alias("address"), "relation", "authority", "origin").distinct()
    frontier, out, level = starts.select("start", F.col("start").alias("here")).distinct(), None, 1
    seen = frontier
    while True:
        rows = frontier.join(moves, "here").select("start", "address", "relation", "authority", "origin").distinct()
        if out is not None:
            rows = rows.join(out, ["start", "address", "relation", "authority", "origin"], "left_anti")
        found = materialize(rows.withColumn("distance", F.lit(level)), "level")
        out = found if out is None else out.unionByName(found)
        if not transitive:
            return out
        frontier = materialize(found.select("start", F.col("address").alias("here")).distinct().join(seen, ["start", "here"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return out
        seen, level = seen.unionByName(frontier), level + 1


def finish_status(results: DataFrame) -> DataFrame:
    """(status, applied, blocked, skipped) of a shared finish over sources."""
    n = lambda s: F.count_if(F.col("status") == s)
    state = F.when(n("applied") == F.count("*"), "complete").when(n("applied") > 0, "partial").otherwise("blocked")
    return results.agg(state.alias("status"), n("applied").alias("applied"), n("blocked").alias("blocked"), n("skipped").alias("skipped"))
