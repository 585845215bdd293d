"""Health, inventory, profile and delivery queries over a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.markdown import LIST_RELATIONS, PIN_RELATION
from corpusloom.operators.components import connected_components
from corpusloom.operators.resolve import pin_states
from corpusloom.sources.corpus import Corpus


# Health ------------------------------------------------------------------------
def document_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, relation, authority) between documents, from section-level edges."""
    return edges.select(F.col("src_doc").alias("src"), F.col("dst_doc").alias("dst"), "relation", "authority")


def edge_counts(edges: DataFrame) -> DataFrame:
    """(kind, name, n): edges by authority and by relation, in one pass."""
    grouped = edges.groupingSets([["authority"], ["relation"]], "authority", "relation").agg(F.count("*").alias("n"))
    return grouped.select(F.when(F.col("authority").isNotNull(), "authority").otherwise("relation").alias("kind"), F.coalesce("authority", "relation").alias("name"), "n")


def boundary_counts(boundaries: DataFrame) -> DataFrame:
    return boundaries.groupBy("category").agg(F.count("*").alias("n"))


def degrees(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """(document_id, in_degree, out_degree): distinct neighbours, generated edges aside."""
    own = edges.where("authority <> 'generated' AND src <> dst").select("src", "dst").distinct()
    out = own.groupBy(F.col("src").alias("document_id")).agg(F.count("*").alias("out_degree"))
    into = own.groupBy(F.col("dst").alias("document_id")).agg(F.count("*").alias("in_degree"))
    return documents.select("document_id").distinct().join(into, "document_id", "left").join(out, "document_id", "left").na.fill(0, ["in_degree", "out_degree"])


def orphans(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents without any neighbour."""
    return degrees(documents, edges).where("in_degree = 0 AND out_degree = 0").select("document_id")


def weak_components(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """(document_id, component): components of all but generated edges; singletons, too."""
    ids = documents.select("document_id").distinct()
    links = edges.where("authority <> 'generated'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    found = connected_components(links).withColumnRenamed("node", "document_id")
    return ids.join(found, "document_id", "left").select("document_id", F.coalesce("component", "document_id").alias("component"))


def missing_metadata(documents: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(document_id, field) of every required field that a document lacks."""
    present = metadata_fields()
    want = F.array(*map(F.lit, required)).cast("array<string>") if required else F.array().cast("array<string>")
    return documents.where("document_id IS NOT NULL").select("document_id", F.explode(F.array_except(want, present)).alias("field"))


def metadata_fields() -> Column:
    """The names of a document's present fields, relations aside."""
    core = F.array(F.lit("id"), F.lit("revision"), F.when(F.col("doc_type").isNotNull(), "type"), F.when(F.col("status").isNotNull(), "status"))
    return F.array_distinct(F.concat(F.array_compact(core), F.transform("additional", lambda a: a["name"])))


def health_signals(corpus: Corpus, edges: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(code, document_id, value): what the policy's thresholds and switches report."""
    docs, flat, limits = corpus.documents.where("document_id IS NOT NULL"), document_edges(edges), dict(corpus.policy.thresholds)
    degree = degrees(docs, flat)
    parts: list[DataFrame] = []

    def over(df: DataFrame, code: str, value: str) -> None:
        if code in limits:
            parts.append(df.where(F.col(value) >= limits[code]).select(F.lit(code).alias("code"), "document_id", F.col(value).cast("long").alias("value")))

    over(degree, "high-in-degree", "in_degree")
    over(degree, "high-out-degree", "out_degree")
    over(boundaries.groupBy(F.col("src_doc").alias("document_id")).agg(F.count("*").alias("n")), "boundary-concentration", "n")
    stale = pin_states(corpus).where("state = 'stale'")
    over(stale.groupBy(F.col("source_id").alias("document_id")).agg(F.count("*").alias("n")), "stale-pin-concentration", "n")
    if corpus.policy.report_orphans:
        parts.append(orphans(docs, flat).select(F.lit("orphan-document").alias("code"), "document_id", F.lit(0).cast("long").alias("value")))
    missing = missing_metadata(docs, corpus.policy.required_metadata)
    parts.append(missing.groupBy("document_id").agg(F.count("*").alias("value")).select(F.lit("missing-metadata").alias("code"), "document_id", "value"))
    dead = boundaries.where("category = 'missing-anchor'").groupBy(F.col("src_doc").alias("document_id")).agg(F.count("*").alias("value"))
    parts.append(dead.select(F.lit("dead-reference").alias("code"), "document_id", "value"))
    if "weak-component" in limits:
        parts.append(weak_component_signal(weak_components(docs, flat), limits["weak-component"]))
    return reduce(DataFrame.unionByName, parts)


def weak_component_signal(components: DataFrame, most: int) -> DataFrame:
    """Documents outside the largest component, if there are more than ``most``."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.count("*").alias("value"), F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("largest"))
    out = components.join(F.broadcast(whole), F.col("component") != F.col("largest")).where(F.col("value") > most)  # one row
    return out.select(F.lit("weak-component").alias("code"), "document_id", "value")


# Inventory -----------------------------------------------------------------------
def field_rows(documents: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, doc_type, name, value_type, value_json) of every present field."""
    known = documents.where("document_id IS NOT NULL")
    base = known.select("document_id", "doc_type", F.explode(F.expr("""concat(
        array(struct('id' AS name, 'string' AS value_type, to_json(named_struct('v', document_id)) AS value_json),
              struct('revision' AS name, 'integer' AS value_type, to_json(named_struct('v', revision)) AS value_json)),
        filter(array(struct('type' AS name, 'string' AS value_type, to_json(named_struct('v', doc_type)) AS value_json),
                     struct('status' AS name, 'string' AS value_type, to_json(named_struct('v', status)) AS value_json)), x -> x.value_json <> '{}'))""")).alias("f"))  # fmt: skip
    base = base.select("document_id", "doc_type", "f.name", "f.value_type", F.regexp_extract("f.value_json", r"^\{\"v\":(.*)\}$", 1).alias("value_json"))
    more = known.select("document_id", "doc_type", F.explode("additional").alias("a")).select("document_id", "doc_type", "a.*")
    own = relations.where("kind <> 'federated'").groupBy("document_id", F.col("relation").alias("name")).agg(F.to_json(F.sort_array(F.collect_list("target"))).alias("value_json"))
    own = own.join(known.select("document_id", "doc_type"), "document_id").select("document_id", "doc_type", "name", F.lit("sequence").alias("value_type"), "value_json")
    return base.unionByName(more).unionByName(own)


def metadata_inventory(fields: DataFrame, n_documents: int) -> DataFrame:
    """Per field: documents with and without it, its types, and whether they conflict."""
    out = fields.groupBy("name").agg(
        F.countDistinct("document_id").alias("present"),
        F.array_join(F.sort_array(F.collect_set("value_type")), ",").alias("value_types"),
        F.array_join(F.sort_array(F.collect_set("doc_type")), ",").alias("doc_types"),
        (F.countDistinct("value_type") > 1).alias("type_conflict"),
    )
    return out.withColumn("missing", F.lit(n_documents).cast("long") - F.col("present"))


def field_occurrences(fields: DataFrame, name: str) -> DataFrame:
    return fields.where(F.col("name") == name).select("document_id", "value_type", "value_json")


def edge_degrees(edges: DataFrame) -> DataFrame:
    """(document_id, outgoing, incoming): numbers of edges, for the inventory."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("document_id")).agg(F.sum("e.o").alias("outgoing"), F.sum("e.i").alias("incoming"))


# Profiles --------------------------------------------------------------------------
def profile_violations(corpus: Corpus) -> DataFrame:
    """(document_id, code, subject, profile) of documents that break their type's profile."""
    parsed, parts = corpus.parsed.where("document_id IS NOT NULL"), []
    anchors = F.transform("sections", lambda s: s["anchor"])
    used = F.array_distinct(F.transform(F.filter("relations", lambda r: r["kind"] != "federated"), lambda r: r["relation"]))
    for p in corpus.policy.profiles:
        own = parsed.where(F.col("doc_type") == p.doc_type)

        def add(items: Column, code: str, own: DataFrame = own, name: str = p.name) -> None:
            parts.append(own.select("document_id", F.lit(code).alias("code"), F.explode(items).alias("subject"), F.lit(name).alias("profile")))

        if p.required_metadata:
            add(F.array_except(F.array(*map(F.lit, p.required_metadata)), metadata_fields()), "missing-metadata")
        if p.required_roles:
            lacking = [F.when(~F.arrays_overlap(F.array(*map(F.lit, aliases)), anchors), F.lit(role)) for role, aliases in p.required_roles]
            add(F.array_compact(F.array(*lacking)), "missing-role")
        if p.relations is not None:
            add(F.array_except(used, F.array(*map(F.lit, p.relations)).cast("array<string>")), "relation-not-allowed")
        if p.statuses is not None:
            bad = F.col("status").isNotNull() & ~F.col("status").isin(*p.statuses) if p.statuses else F.col("status").isNotNull()
            add(F.array_compact(F.array(F.when(bad, F.col("status")))), "status-not-allowed")
    if not parts:
        return parsed.limit(0).select("document_id", F.lit("").alias("code"), F.lit("").alias("subject"), F.lit("").alias("profile"))
    return reduce(DataFrame.unionByName, parts)


def profile_counts(corpus: Corpus) -> DataFrame:
    """(profile, documents, violations), zero where there are none."""
    if not corpus.policy.profiles:
        return profile_violations(corpus).select("profile", F.lit(0).cast("long").alias("documents"), F.lit(0).cast("long").alias("violations"))
    names = corpus.parsed.sparkSession.createDataFrame([(p.name, p.doc_type) for p in corpus.policy.profiles], "profile string, doc_type string")
    own = corpus.documents.where("document_id IS NOT NULL").groupBy("doc_type").agg(F.count("*").alias("documents"))
    bad = profile_violations(corpus).groupBy("profile").agg(F.count("*").alias("violations"))
    return names.join(own, "doc_type", "left").join(bad, "profile", "left").na.fill(0).select("profile", "documents", "violations")


# Delivery ---------------------------------------------------------------------------
def delivery_rows(corpus: Corpus) -> DataFrame:
    """Each delivered contract address of an owner: its parts, and codes of what is wrong."""
    policy = corpus.policy
    owners = corpus.parsed.where(F.col("doc_type").isin(*policy.delivery_types) & F.col("document_id").isNotNull()) if policy.delivery_types else corpus.parsed.limit(0)
    owners = owners.select("document_id", "status", F.try_element_at(F.filter("additional", lambda a: a["name"] == policy.delivery_field), F.lit(1)).alias("f"))
    listed = F.from_json("f.value_json", "array<string>")
    bad_field = owners.where("f IS NOT NULL AND f.value_type <> 'sequence'").select(F.col("document_id").alias("owner"), "status", F.lit(None).cast("string").alias("source"), F.lit("invalid-delivery-field").alias("code"))
    none = owners.where("f IS NOT NULL AND f.value_type = 'sequence'").where(F.size(listed) == 0).select(F.col("document_id").alias("owner"), "status", F.lit(None).cast("string").alias("source"), F.lit("empty-delivery-field").alias("code"))
    rows = owners.where("f.value_type = 'sequence'").select(F.col("document_id").alias("owner"), "status", F.posexplode(listed).alias("at", "source"))
    rows = rows.withColumns({"doc": F.split_part("source", F.lit("#"), F.lit(1)), "anchor": F.when(F.col("source").contains("#"), F.regexp_extract("source", "#(.*)$", 1))})
    ids = corpus.unique.select(F.col("document_id").alias("doc"), F.lit(True).alias("known"))
    anchors = corpus.headings.select(F.col("document_id").alias("doc"), "anchor", F.lit(True).alias("has_anchor")).distinct()
    found = rows.join(ids, "doc", "left").join(anchors, ["doc", "anchor"], "left")
    times = found.groupBy("owner", "source").agg(F.min("at").alias("first"))
    found = found.join(times, ["owner", "source"])
    code = (
        F.when(~F.col("doc").rlike("^[A-Z][A-Z0-9]{1,15}-[0-9]+$") | (F.col("anchor") == ""), "invalid-source-address")
        .when(F.col("at") > F.col("first"), "duplicate-source-address")
        .when(F.col("anchor").isNull(), "document-only-source")
        .when(F.col("known").isNull(), "unknown-source-document")
        .when(F.col("doc") == F.col("owner"), "self-delivery")
        .when(F.col("has_anchor").isNull(), "unknown-source-anchor")
    )
    return found.select("owner", "status", "source", code.alias("code")).unionByName(bad_field).unionByName(none)


def evidence_rows(corpus: Corpus) -> DataFrame:
    """(owner, role, anchor, code): the one section that bears each evidence role."""
    policy = corpus.policy
    own = corpus.parsed.where(F.col("doc_type").isin(*policy.delivery_types) & F.col("document_id").isNotNull()) if policy.delivery_types else corpus.parsed.limit(0)
    parts = []
    for role, aliases in policy.evidence_roles:
        found = F.array_intersect(F.transform("sections", lambda s: s["anchor"]), F.array(*map(F.lit, aliases)))
        code = F.when(F.size(found) == 0, "missing-evidence-role").when(F.size(found) > 1, "ambiguous-evidence-role")
        parts.append(own.select(F.col("document_id").alias("owner"), F.lit(role).alias("role"), F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1))).alias("anchor"), code.alias("code")))
    if not parts:
        return own.limit(0).select(F.col("document_id").alias("owner"), F.lit("").alias("role"), F.lit("").alias("anchor"), F.lit("").alias("code"))
    return reduce(DataFrame.unionByName, parts)


def overlaps(mappings: DataFrame, source: str = "source", owner: str = "owner") -> DataFrame:
    """Contracts that more than one owner delivers."""
    return mappings.groupBy(source).agg(F.countDistinct(owner).alias("owners")).where("owners > 1")


def unowned(requested: DataFrame, mappings: DataFrame, source: str = "source") -> DataFrame:
    """Requested contracts that nobody delivers."""
    return requested.join(mappings.select(source).distinct(), source, "left_anti")


def delivery_state(requested: DataFrame, mappings: DataFrame) -> DataFrame:
    """(source, state): overlap, owned or unowned."""
    n = mappings.groupBy("source").agg(F.countDistinct("owner").alias("n"))
    state = F.when(F.col("n") > 1, "overlap").when(F.col("n") == 1, "owned").otherwise("unowned")
    return requested.join(n, "source", "left").select("source", state.alias("state"))


# Impact --------------------------------------------------------------------------------
def impact(corpus: Corpus, dependencies: DataFrame) -> DataFrame:
    """(target_id, source_id, relation, pin, impact) of every incoming edge."""
    pins = pin_states(corpus).select("source_id", "target_id", "pin", "state")
    found = dependencies.join(pins.withColumn("relation", F.lit(PIN_RELATION)), ["source_id", "target_id", "pin", "relation"], "left")
    return found.select("target_id", "source_id", "relation", "pin", impact_class().alias("impact"))


def impact_class() -> Column:
    """From relation and the state of a pin."""
    return (
        F.when(F.col("relation") == "related", "related navigation")
        .when((F.col("relation") == PIN_RELATION) & (F.col("state") == "historical"), "historical snapshot")
        .when((F.col("relation") == PIN_RELATION) & (F.col("state") == "current"), "freshness pin (current)")
        .when(F.col("relation") == PIN_RELATION, "freshness pin (already stale)")
        .when(F.col("relation") == "supersedes", "lineage")
        .otherwise("semantic")
    )


ALL_RELATIONS = (*LIST_RELATIONS, PIN_RELATION)
