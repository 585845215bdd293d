"""Resolution: relations and links become typed edges, or boundaries that say why not.

Every join is a left join whose misses are rows of a second result; nothing is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.markdown import INDEX_NAMES
from corpusloom.sources.corpus import Corpus

EDGE = ("src_doc", "src_anchor", "dst_doc", "dst_anchor", "relation", "authority", "origin", "reason", "pin")
BOUNDARY = ("src_doc", "src_anchor", "raw_target", "category", "reason")


def folded(path: Column) -> Column:
    """{parts, out}: a slash path without ``.`` and ``..``; out if it leaves the root."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        parts = (
            F.when(up, F.slice(acc["parts"], F.lit(1), F.greatest(F.lit(0), F.size(acc["parts"]) - 1)))
            .when((part == ".") | (part == ""), acc["parts"])
            .otherwise(F.concat(acc["parts"], F.array(part)))
        )
        return F.struct(parts.alias("parts"), (acc["out"] | (up & (F.size(acc["parts"]) == 0))).alias("out"))

    return F.aggregate(F.split(path, "/"), start, step)


def decoded(x: Column) -> Column:
    """Percent-decoded; a plus sign stays, and what is no encoding stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def split_targets(links: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds is_external, target_path (folded, null if none), is_outside and fragment."""
    r = F.col(raw)
    external = r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | r.startswith("//")
    bare = F.split_part(F.split_part(r, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    inner = F.replace(decoded(bare), F.lit("\\"), F.lit("/"))
    parent = F.regexp_replace("path", r"[^/]*$", "")
    fold = folded(F.concat(parent, inner))
    found = links.withColumns({"is_external": external, "_bare": bare, "_fold": fold, "fragment": decoded(F.when(r.contains("#"), F.regexp_extract(r, "#(.*)$", 1)).otherwise(""))})
    return found.withColumns(
        {
            "is_outside": (F.col("_bare") != "") & (F.col("_fold.out") | inner.startswith("/")),
            "target_path": F.when(F.col("_bare") != "", F.array_join("_fold.parts", "/")),
        }
    ).drop("_bare", "_fold")


def directory_indexes(paths: DataFrame) -> DataFrame:
    """(directory, index_path): every folder with files below; its index file or null."""
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    above = F.transform(F.sequence(F.lit(0), depth), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    own = F.array_join(F.slice(parts, F.lit(1), depth), "/")
    rows = paths.select("path", own.alias("own"), F.explode(above).alias("directory"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    index = F.when((F.col("own") == F.col("directory")) & name.isin(*INDEX_NAMES), F.struct(name.alias("name"), F.col("path").alias("path")))
    return rows.groupBy("directory").agg(F.min(index).alias("i")).select("directory", F.col("i.path").alias("index_path"))


def through_directories(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Links to a folder become links to its index; ``no_index`` where it has none."""
    joined = links.join(directory_indexes(paths), links["target_path"] == F.col("directory"), "left")
    return joined.withColumns({"no_index": F.col("directory").isNotNull() & F.col("index_path").isNull(), "target_path": F.coalesce("index_path", "target_path")}).drop("directory", "index_path")


def owning_section(links: DataFrame, headings: DataFrame) -> DataFrame:
    """Adds src_anchor, of the innermost section that holds the link's line, or null."""
    s = headings.select(F.col("path").alias("s_path"), F.col("anchor").alias("s_anchor"), "start_line", "end_line")
    inside = (links["path"] == s["s_path"]) & (links["line"] >= s["start_line"]) & (links["line"] <= s["end_line"])
    keys = [c for c in links.columns]
    return links.join(s, inside, "left").groupBy(*keys).agg(F.max_by("s_anchor", "start_line").alias("src_anchor"))


def resolve_links(corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """(observed edges, boundaries) of all links outside fenced code."""
    documents = corpus.documents.select("path", F.col("document_id").alias("target_id"))
    links = owning_section(corpus.links, corpus.headings)
    found = through_directories(split_targets(links), corpus.documents.select("path"))
    found = found.withColumn("goal", F.coalesce("target_path", "path"))
    found = found.join(documents.withColumnRenamed("path", "goal"), "goal", "left")
    anchors = corpus.headings.select(F.col("path").alias("goal"), F.col("anchor").alias("fragment"), F.lit(True).alias("has_anchor")).distinct()
    found = found.join(anchors, ["goal", "fragment"], "left")
    category = (
        F.when(F.col("is_external"), "external")
        .when(F.col("target_path").isNull() & (F.col("fragment") == ""), "malformed")
        .when(F.col("is_outside"), "outside-root")
        .when(F.col("no_index"), "unknown-document")
        .when(~F.lower("goal").endswith(".md"), "resource")
        .when(F.col("target_id").isNull(), "unknown-document")
        .when((F.col("fragment") != "") & F.col("has_anchor").isNull(), "missing-anchor")
    )
    reason = (
        F.when(category == "external", "external URL")
        .when(category == "malformed", "neither a path nor a fragment")
        .when(category == "outside-root", "path leaves the documentation root")
        .when(F.col("no_index"), "directory has no index document")
        .when(category == "resource", "no document")
        .when(category == "unknown-document", F.concat("goal", F.lit(" is no cataloged document")))
        .otherwise(F.concat("target_id", F.lit("#"), "fragment", F.lit(" has no section")))
    )
    found = found.withColumns({"category": category, "why": reason, "src_doc": F.col("document_id")})
    edges = found.where("category IS NULL").select(
        "src_doc", "src_anchor", F.col("target_id").alias("dst_doc"), F.nullif("fragment", F.lit("")).alias("dst_anchor"), F.lit("references").alias("relation"),
        F.lit("observed").alias("authority"), F.lit("markdown-link").alias("origin"), F.concat(F.lit("line "), F.col("line").cast("string")).alias("reason"), F.lit(None).cast("long").alias("pin"),
    )
    boundaries = found.where("category IS NOT NULL").select("src_doc", "src_anchor", F.col("raw").alias("raw_target"), "category", F.col("why").alias("reason"))
    return edges, boundaries


def legacy_relations(corpus: Corpus) -> DataFrame:
    """Path-valued relations with target_id (a migration), or category and reason.

    A path that leads to its own document is the category ``self``.
    """
    legacy = corpus.relations.where("kind = 'legacy'").withColumn("raw", F.col("target"))
    found = through_directories(split_targets(legacy), corpus.documents.select("path"))
    targets = corpus.documents.select(F.col("path").alias("target_path"), F.col("document_id").alias("target_id"))
    found = found.join(targets, "target_path", "left")
    hit = F.col("target_id").isNotNull() & ~F.col("is_external") & ~F.col("is_outside")
    category = F.when(F.col("is_external"), "external").when(hit & (F.col("target_id") == F.col("document_id")), "self").when(~hit, "resource")
    return found.select("path", "document_id", "relation", F.col("raw").alias("value"), F.when(category.isNull(), F.col("target_id")).alias("target_id"), category.alias("category"))


def dependency_edges(corpus: Corpus) -> DataFrame:
    """Distinct (relation, source_id, target_id, pin) between documents of unique IDs."""
    ids = corpus.unique.select("document_id")
    own = corpus.relations.where("kind = 'canonical'").select("relation", F.col("document_id").alias("source_id"), F.col("target").alias("target_id"), "pin")
    if corpus.policy.legacy_paths == "resolve":
        moved = legacy_relations(corpus).where("target_id IS NOT NULL")
        own = own.unionByName(moved.select("relation", F.col("document_id").alias("source_id"), "target_id", F.lit(None).cast("long").alias("pin")))
    own = own.where("source_id <> target_id")
    own = own.join(ids.withColumnRenamed("document_id", "source_id"), "source_id", "left_semi")
    return own.join(ids.withColumnRenamed("document_id", "target_id"), "target_id", "left_semi").select("relation", "source_id", "target_id", "pin").distinct()


def unknown_references(corpus: Corpus) -> DataFrame:
    """Canonical relations whose target no document has."""
    ids = corpus.documents.where("document_id IS NOT NULL").select(F.col("document_id").alias("target"))
    return corpus.relations.where("kind = 'canonical'").join(ids, "target", "left_anti").select("path", "document_id", "relation", "target", "pin")


def pin_states(corpus: Corpus) -> DataFrame:
    """Each pin with the target's revision and state: current, stale or historical."""
    pins = dependency_edges(corpus).where("relation = 'validated_against'")
    owners = corpus.unique.select(F.col("document_id").alias("source_id"), is_historical(corpus).alias("is_historical"))
    now = corpus.unique.select(F.col("document_id").alias("target_id"), F.col("revision").alias("current_revision"))
    state = F.when(F.col("is_historical"), "historical").when(F.col("pin") == F.col("current_revision"), "current").otherwise("stale")
    return pins.join(owners, "source_id").join(now, "target_id").select("source_id", "target_id", "pin", "current_revision", state.alias("state"))


def is_historical(corpus: Corpus) -> Column:
    """Whether a document is a snapshot by policy: of a type, or of a type and status."""
    found = F.col("doc_type").isin(*corpus.policy.snapshot_types) if corpus.policy.snapshot_types else F.lit(False)
    for rule in corpus.policy.snapshot_rules:
        own = F.col("doc_type") == rule.doc_type
        found = found | (own & F.col("status").isin(*rule.statuses) if rule.statuses else own)
    return F.coalesce(found, F.lit(False))


def reference_graph(corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """(edges, boundaries): generated, authored and observed edges of unique documents."""
    ids = corpus.unique.select("document_id", "path")
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")

    def edge(df: DataFrame, relation: Column, authority: str, origin: str, src_anchor: Column = text, dst_anchor: Column = text, reason: Column = text, pin: Column = none) -> DataFrame:
        return df.select(
            F.col("document_id").alias("src_doc"), src_anchor.alias("src_anchor"), F.col("target").alias("dst_doc"), dst_anchor.alias("dst_anchor"),
            relation.alias("relation"), F.lit(authority).alias("authority"), F.lit(origin).alias("origin"), reason.alias("reason"), pin.alias("pin"),
        )

    sections = corpus.headings.join(ids, ["document_id", "path"], "left_semi").withColumn("target", F.col("document_id"))
    contains = edge(sections, F.lit("contains"), "generated", "section", dst_anchor=F.col("anchor"))
    known = ids.select(F.col("document_id").alias("target"))
    own = corpus.relations.where("kind = 'canonical' AND target <> document_id").join(ids.select("document_id"), "document_id", "left_semi").join(known, "target", "left_semi")
    authored = edge(own, F.col("relation"), "authored", "metadata", pin=F.col("pin"))
    observed, boundaries = resolve_links(corpus)
    observed = observed.join(ids.select(F.col("document_id").alias("src_doc")), "src_doc", "left_semi").select(*EDGE)
    legacy = legacy_relations(corpus)
    parts = [contains, authored, observed]
    missed = legacy.where("category IS NOT NULL AND category <> 'self'")
    if corpus.policy.legacy_paths == "resolve":
        parts.append(edge(legacy.where("target_id IS NOT NULL").withColumn("target", F.col("target_id")), F.col("relation"), "authored", "legacy-metadata"))
    federated = corpus.relations.where("kind = 'federated'")
    outer = federated.select(F.col("document_id").alias("src_doc"), text.alias("src_anchor"), F.col("target").alias("raw_target"), F.lit("federated").alias("category"), F.lit("document of another source").alias("reason"))
    left = missed.select(F.col("document_id").alias("src_doc"), text.alias("src_anchor"), F.col("value").alias("raw_target"), "category", F.concat(F.lit("legacy "), F.col("relation")).alias("reason"))
    return reduce(DataFrame.unionByName, parts), boundaries.unionByName(left).unionByName(outer).select(*BOUNDARY)


def address(doc: str, anchor: str) -> Column:
    """``ID`` or ``ID#anchor``."""
    return F.concat(F.col(doc), F.coalesce(F.concat(F.lit("#"), F.col(anchor)), F.lit("")))


def addressed(edges: DataFrame) -> DataFrame:
    """(src, dst, relation, authority, origin, reason, pin) with addresses as text."""
    return edges.select(address("src_doc", "src_anchor").alias("src"), address("dst_doc", "dst_anchor").alias("dst"), "relation", "authority", "origin", "reason", "pin")


def known_addresses(edges: DataFrame) -> DataFrame:
    """(address) of every end of an addressed edge, once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("address")).distinct()


def boundaries_from(boundaries: DataFrame, source: str) -> DataFrame:
    """The boundaries of one address, in order."""
    return boundaries.where(address("src_doc", "src_anchor") == source).orderBy("raw_target", "category", "reason")
