"""Validation rules, each a query of issues, and the blockers of every query kind.

An issue is (path, severity, message, affects_graph, target_id, category).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.resolve import legacy_relations, pin_states, reference_graph, split_targets, through_directories, unknown_references
from corpusloom.operators.traverse import cycles
from corpusloom.sources.corpus import Corpus

ORDERED = ("derived_from", "depends_on", "supersedes")  #: relations that may not cycle


def _issues(df: DataFrame, message: Column, severity: str | Column = "error", graph: bool | Column = False, target: Column | None = None, category: str | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("string")
    return df.select("path", lit(severity).alias("severity"), message.alias("message"), lit(graph).alias("affects_graph"), (none if target is None else target).alias("target_id"), (none if category is None else F.lit(category)).alias("category"))


def membership_issues(corpus: Corpus) -> DataFrame:
    return _issues(corpus.memberships.where("state = 'unmapped'"), F.lit("Markdown file belongs to no area"), graph=True)


def metadata_issues(corpus: Corpus) -> DataFrame:
    """Parse issues, duplicate IDs, self and unknown references, stale pins, boundaries."""
    docs = corpus.documents.where("document_id IS NOT NULL")
    twice = docs.join(docs.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1"), "document_id")
    paths = corpus.unique.select(F.col("document_id").alias("source_id"), "path")
    itself = corpus.relations.where("kind = 'canonical' AND target = document_id")
    unknown = unknown_references(corpus)
    stale = pin_states(corpus).where("state = 'stale'").join(paths, "source_id")
    outer = corpus.relations.where("kind = 'federated'")
    text = lambda *parts: F.concat(*(F.col(p) if p.isidentifier() and p in names else F.lit(p) for p in parts))
    names = {"document_id", "relation", "target", "target_id"}
    return reduce(
        DataFrame.unionByName,
        [
            _issues(corpus.metadata_issues, F.col("message"), graph=F.col("affects_graph")),
            _issues(twice, text("duplicate document ID ", "document_id"), graph=True, target=F.col("document_id")),
            _issues(itself, text("document refers to itself by ", "relation"), graph=True, target=F.col("target")),
            _issues(unknown, F.concat(F.col("relation"), F.lit(" names unknown document "), F.col("target")), graph=True, target=F.col("target")),
            _issues(stale, F.concat(F.lit("stale pin of "), F.col("target_id"), F.lit("@"), F.col("pin").cast("string")), "warning", target=F.col("target_id"), category="stale-pin"),
            _issues(outer, F.concat(F.lit("document of another source "), F.col("target")), "warning", target=F.col("target"), category="federated"),
        ],
    )


def adoption_issues(corpus: Corpus) -> DataFrame:
    """Legacy paths: errors in strict mode, warnings otherwise; to itself always an error."""
    strict = corpus.policy.legacy_paths == "strict"
    severity = F.when((F.col("category") == "self") | F.lit(strict), "error").otherwise("warning")
    what = F.when(F.col("category") == "self", "leads to its own document").when(F.col("target_id").isNotNull(), F.concat(F.lit("can be "), F.col("target_id"))).otherwise(F.concat(F.lit("is "), F.col("category")))
    kind = F.when(F.col("target_id").isNotNull(), "legacy-migration").otherwise("legacy-boundary")
    rows = legacy_relations(corpus)
    out = _issues(rows, F.concat(F.lit("legacy "), F.col("relation"), F.lit(" "), F.col("value"), F.lit(" "), what), severity, graph=F.lit(strict) | (F.coalesce("category", F.lit("")) == "self"), target=F.col("target_id"))
    return out.drop("category").join(rows.select("path", F.concat(F.lit("legacy "), F.col("relation"), F.lit(" "), F.col("value"), F.lit(" "), what).alias("message"), kind.alias("category")).distinct(), ["path", "message"]).select(*out.columns)


def section_rules(corpus: Corpus) -> DataFrame:
    wanted = corpus.policy.extend_through
    found = _issues(corpus.section_issues, F.col("message"))
    if wanted:
        wrong = corpus.headings.where(F.col("anchor").isin(*wanted) & (F.col("level") != 2))
        found = found.unionByName(_issues(wrong, F.concat(F.lit("navigation anchor "), F.col("anchor"), F.lit(" is a heading of level "), F.col("level").cast("string"))))
    return found


def reachability_issues(corpus: Corpus) -> DataFrame:
    """Documents that their nearest index does not link, and folders of several indexes.

    The nearest index is that of the deepest folder above with exactly one index, in the
    document's area; an index starts from the folder above its own, and that of an
    area's root needs no link.
    """
    docs = corpus.documents.select("path", "role", "is_index")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    areas = dict(corpus.policy.areas)
    root = F.create_map(*(F.lit(x) for kv in areas.items() for x in kv)) if areas else F.create_map(F.lit(""), F.lit(""))
    placed = docs.select("path", "role", "is_index", folder.alias("folder"), F.when(root[F.col("role")] == ".", "").otherwise(root[F.col("role")]).alias("root"))
    many = placed.where("is_index").groupBy("folder").agg(F.count("*").alias("n"), F.min("path").alias("index"), F.sort_array(F.collect_list("path")).alias("all"))
    several = many.where("n > 1").select(F.explode("all").alias("path"), "folder")
    one = many.where("n = 1").select("folder", "index")
    start = F.when(F.col("is_index"), F.regexp_replace("folder", r"/?[^/]*$", "")).otherwise(F.col("folder"))
    needy = placed.where(~(F.col("is_index") & (F.col("folder") == F.col("root")))).withColumn("start", start)
    parts = F.split("start", "/")
    above = F.when(F.col("start") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    ways = needy.select("path", "root", F.explode(above).alias("folder")).where((F.col("root") == "") | (F.col("folder") == F.col("root")) | F.col("folder").startswith(F.concat("root", F.lit("/"))))
    nearest = ways.join(one, "folder").where("index <> path").groupBy("path").agg(F.max_by("index", F.length("folder")).alias("index"))
    raw = corpus.parsed.select("path", F.explode("reach_links").alias("raw"))
    linked = through_directories(split_targets(raw), corpus.documents.select("path")).where("NOT is_external AND NOT is_outside").select(F.col("path").alias("index"), F.col("target_path").alias("path")).distinct()
    lost = nearest.join(linked, ["index", "path"], "left_anti")
    alone = needy.join(nearest, "path", "left_anti")
    return reduce(
        DataFrame.unionByName,
        [
            _issues(several, F.concat(F.lit("several index documents in folder "), F.col("folder"))),
            _issues(lost, F.concat(F.lit("not linked from "), F.col("index"))),
            _issues(alone, F.lit("no index document above")),
        ],
    )


def graph_issues(corpus: Corpus) -> DataFrame:
    """An error per member of a cycle, and a warning per link to a missing section."""
    edges, boundaries = reference_graph(corpus)
    flat = edges.where(F.col("authority") == "authored").select(F.col("src_doc").alias("src"), F.col("dst_doc").alias("dst"), "relation").where(F.col("relation").isin(*ORDERED))
    members = cycles(flat).select("relation", F.explode("members").alias("document_id"), F.array_join("members", ", ").alias("all"))
    paths = corpus.unique.select("document_id", "path")
    dead = boundaries.where("category = 'missing-anchor'").join(paths.withColumnRenamed("document_id", "src_doc"), "src_doc")
    return _issues(members.join(paths, "document_id"), F.concat(F.lit("cycle of "), F.col("relation"), F.lit(": "), F.col("all")), graph=True).unionByName(_issues(dead, F.concat(F.lit("dead reference "), F.col("raw_target"), F.lit(": "), F.col("reason")), "warning", category="dead-reference"))


def catalog_issues(corpus: Corpus, graph: bool = False) -> DataFrame:
    """All rules' issues; sort by (path, severity, message) to list them."""
    rules = [membership_issues, metadata_issues, adoption_issues, section_rules, reachability_issues, *([graph_issues] if graph else [])]
    return reduce(DataFrame.unionByName, (rule(corpus) for rule in rules))


def validation_summary(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, migrations and boundaries of legacy paths, stale pins."""
    of = lambda c: F.count_if(F.col("category") == c)
    return issues.agg(
        F.count_if(F.col("severity") != "warning").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
        of("legacy-migration").alias("adoption_resolved"), of("legacy-boundary").alias("adoption_boundaries"), of("stale-pin").alias("stale_pins"),
    )


def compacted(issues: DataFrame, verbose: bool = False) -> DataFrame:
    """(path, severity, message, n): warnings of legacy paths as one counted row a category."""
    folds = F.lit(not verbose) & (F.col("severity") == "warning") & F.coalesce(F.col("category").isin("legacy-migration", "legacy-boundary"), F.lit(False))
    rows = issues.select(F.when(~folds, F.col("path")).alias("path"), "severity", F.when(folds, F.col("category")).otherwise(F.col("message")).alias("message"))
    return rows.groupBy("path", "severity", "message").agg(F.count("*").alias("n"))


def blockers(corpus: Corpus, query: str, documents: DataFrame | None = None) -> DataFrame:
    """Issues that keep a query from answering; ``documents`` (path) are those it touches.

    read: section issues of the document. dependencies: graph issues of its metadata, of
    all for the reverse. references, change-plan, impact, context: graph issues of
    membership, metadata and adoption. health, inventory, delivery: every error. index,
    federation: every error but those of the graph.
    """
    if query == "read":
        found = _issues(corpus.section_issues, F.col("message"))
    elif query in ("dependencies", "dependencies-reverse"):
        found = metadata_issues(corpus).where("affects_graph")
        if query == "dependencies-reverse":
            found = found.unionByName(membership_issues(corpus))
    elif query in ("references", "change-plan", "impact", "context"):
        found = reduce(DataFrame.unionByName, (rule(corpus) for rule in (membership_issues, metadata_issues, adoption_issues))).where("affects_graph")
        if query == "context":
            found = found.unionByName(_issues(corpus.section_issues, F.col("message")))
    else:
        found = catalog_issues(corpus, graph=query in ("health", "inventory", "delivery"))
    found = found.where("severity <> 'warning'")
    return found if documents is None else found.join(documents.select("path"), "path", "left_semi")
