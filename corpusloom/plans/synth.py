"""Markdown corpora rendered from relational tables, which the real parser then reads."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.session import read_table, stamp
from corpusloom.sources.corpus import Corpus, build_corpus
from corpusloom.sources.policy import Policy, Profile, SnapshotRule, View

POLICY = Policy(
    areas=(("customers", "customers"), ("geo", "geo"), ("orders", "orders")),
    prefixes=frozenset({"REG", "NAT", "CUST", "ORD"}),
    required_metadata=("owner", "status"),
    thresholds=(("boundary-concentration", 1), ("high-in-degree", 20), ("high-out-degree", 3), ("stale-pin-concentration", 1)),
    report_orphans=True,
    profiles=(Profile("customer", "customer", ("owner",), (("contact", ("contact", "reach")),), ("depends_on",), ("building", "machinery")), Profile("order", "order", (), (("first-line", ("line-1", "line-2")),), None, ("F", "O"))),
)
_kept: dict[tuple, Corpus] = {}


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def _page(path: Column, *parts: str | Column) -> list[Column]:
    return [path.alias("path"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("content")]


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): regions, nations, customers and orders as linked documents."""
    region, nation, customer, orders, lineitem = (read_table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem"))
    listed = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- [nation](NAT-"), _s("n_nationkey"), F.lit(".md#profile)")))), "\n").alias("body"))
    r = region.join(listed, "r_regionkey", "left")
    regions = r.select(*_page(F.concat(F.lit("geo/REG-"), _s("r_regionkey"), F.lit(".md")), "---\nid: REG-", _s("r_regionkey"), "\nrevision: ", (F.col("r_regionkey") % 3 + 1).cast("string"), "\ntype: region\n---\n# ", F.col("r_name"), "\n\n## Nations\n", F.coalesce("body", F.lit("")), "\n"))
    nations = nation.select(*_page(F.concat(F.lit("geo/NAT-"), _s("n_nationkey"), F.lit(".md")), "---\nid: NAT-", _s("n_nationkey"), "\nrevision: ", (F.col("n_nationkey") % 3 + 1).cast("string"), "\ntype: nation\ndepends_on: [REG-", _s("n_regionkey"), "]\n---\n# ", F.col("n_name"), "\n\n## Profile\n[region](REG-", _s("n_regionkey"), ".md#nations)\n"))
    k, n = _s("c_custkey"), _s("c_nationkey")
    rest = F.col("c_custkey") % 5
    extra = (
        F.when(rest == 0, F.concat(F.lit("[x](../geo/NAT-"), n, F.lit(".md#nowhere)")))
        .when(rest == 1, F.concat(F.lit("[x](https://example.com/"), k, F.lit(")")))
        .when(rest == 2, F.lit("[x](logo.png)"))
        .when(rest == 3, F.lit("[x](../../../etc/p.md)"))
        .otherwise(F.concat(F.lit("[x](none-"), k, F.lit(".md)")))
    )
    related = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("related: [CUST-"), (F.col("c_custkey") + 10_000_000).cast("string"), F.lit("]\n"))).otherwise("")
    owner = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("owner: team-"), rest.cast("string"), F.lit("\n"))).otherwise("")
    weight = F.when(F.col("c_custkey") % 2 == 0, "weight: 7\n").otherwise("weight: heavy\n")
    customers = customer.select(*_page(F.concat(F.lit("customers/CUST-"), k, F.lit(".md")), "---\nid: CUST-", k, "\nrevision: ", (F.col("c_custkey") % 3 + 1).cast("string"), "\ntype: customer\nstatus: ", F.lower("c_mktsegment"), "\ndepends_on: [NAT-", n, "]\n", related, owner, weight, "---\n# ", F.col("c_name"), "\n\n## Contact\n[nation](../geo/NAT-", n, ".md#profile)\n", extra, "\n"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("own"))
    body = F.array_join(F.transform("own", lambda x: F.concat(F.lit("## Line "), x["l_linenumber"].cast("string"), F.lit("\npart "), x["l_partkey"].cast("string"), F.lit("\n"))), "")
    o, c = _s("o_orderkey"), _s("o_custkey")
    pages = orders.join(lines, "o_orderkey", "left").select(*_page(F.concat(F.lit("orders/ORD-"), o, F.lit(".md")), "---\nid: ORD-", o, "\nrevision: 1\ntype: order\nstatus: ", F.col("o_orderstatus"), "\nderived_from: [CUST-", c, "]\nvalidated_against: [CUST-", c, "@", (F.col("o_orderkey") % 3 + 1).cast("string"), "]\n---\n# Order ", o, "\n\n", F.coalesce(body, F.lit(""))))
    return reduce(DataFrame.unionByName, [regions, nations, customers, pages])


def _parsed(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], render: Callable[[SparkSession, str], DataFrame], policy: Policy) -> Corpus:
    """A rendered corpus, parsed once in a Spark application while its tables stay as they are."""
    stamps = tuple(stamp(spark, f"{sf_dir}/{t}.parquet") for t in tables)
    key = (spark.sparkContext.applicationId, render.__name__, sf_dir, stamps)
    if key not in _kept:
        _kept[key] = build_corpus(render(spark, sf_dir), policy)
    return _kept[key]


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return _parsed(spark, sf_dir, ("region", "nation", "customer", "orders", "lineitem"), rendered, POLICY)


# A corpus without errors, whose indexes link every document ---------------------------
LINKED = Policy(
    areas=(("customers", "customers"), ("geo", "geo")),
    prefixes=frozenset({"IDX", "REG", "NAT", "CUST"}),
    required_metadata=("weight",),
    thresholds=(("high-in-degree", 20), ("weak-component", 1)),
    profiles=(Profile("customer", "customer", ("weight",), (("contact", ("contact", "reach")), ("notes", ("notes",))), ("depends_on", "related", "validated_against"), ("building", "machinery")),),
    views=(("around", View("both", ("depends_on",), 1)),),
)


def _listing(df: DataFrame, key: Column, *item: str | Column) -> Column:
    """Links, one a line, in the order of a number."""
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in item))
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), text.alias("t")))), lambda x: x["t"]), "\n")


def linked(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """(path, content) of regions, nations and customers; with ``changed`` some histories differ."""
    region, nation, customer = (read_table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    k, n, group = F.col("c_custkey"), _s("c_nationkey"), F.floor(F.col("c_custkey") / 20)
    regions = region.select(*_page(F.concat(F.lit("geo/REG-"), _s("r_regionkey"), F.lit(".md")), "---\nid: REG-", _s("r_regionkey"), "\nrevision: 1\ntype: region\n---\n# ", F.col("r_name"), "\n\n## Nations\nlisted\n"))
    nations = nation.select(*_page(F.concat(F.lit("geo/NAT-"), _s("n_nationkey"), F.lit(".md")), "---\nid: NAT-", _s("n_nationkey"), "\nrevision: 1\ntype: nation\ndepends_on: [REG-", _s("n_regionkey"), "]\n---\n# ", F.col("n_name"), "\n\n## Profile\n[region](REG-", _s("n_regionkey"), ".md#nations)\n"))
    related = F.when(k % 2 == 1, F.concat(F.lit("related: [CUST-"), (k - 1).cast("string"), F.lit("]\n"))).otherwise("")
    weight = F.when(k % 3 == 0, "").when(k % 3 == 1, "weight: 7\n").otherwise("weight: heavy\n")
    since = F.concat(F.lit("since "), _s("c_custkey"), F.when(F.lit(changed) & (k % 5 == 0), " or so").otherwise(""))
    customers = customer.select(*_page(F.concat(F.lit("customers/g"), group.cast("string"), F.lit("/CUST-"), _s("c_custkey"), F.lit(".md")), "---\nid: CUST-", _s("c_custkey"), "\nrevision: 1\ntype: customer\nstatus: ", F.lower("c_mktsegment"), "\ndepends_on: [NAT-", n, "]\n", related, "validated_against: [NAT-", n, "@", (k % 2 + 1).cast("string"), "]\n", weight, "---\n# Customer ", _s("c_custkey"), "\n\n## Contact\n[nation](../../geo/NAT-", n, ".md#profile)\n\n## History\n", since, "\n\n### Early\nnone\n"))
    head = lambda number: F.concat(F.lit("---\nid: IDX-"), number, F.lit("\nrevision: 1\ntype: index\n---\n# Index\n"))
    geo = region.select(F.col("r_regionkey").alias("k"), F.concat(F.lit("- [r](REG-"), _s("r_regionkey"), F.lit(".md)")).alias("t")).unionAll(nation.select(F.col("n_nationkey") + 1000, F.concat(F.lit("- [n](NAT-"), _s("n_nationkey"), F.lit(".md)"))))
    index = geo.agg(_listing(geo, F.col("k"), F.col("t")).alias("b")).select(F.lit("geo/README.md").alias("path"), F.concat(head(F.lit("1")), "b", F.lit("\n")).alias("content"))
    groups = customer.groupBy(group.alias("g")).agg(_listing(customer, k, "- [c](CUST-", _s("c_custkey"), ".md)").alias("b"))
    inner = groups.select(F.concat(F.lit("customers/g"), F.col("g").cast("string"), F.lit("/README.md")).alias("path"), F.concat(head((F.col("g") + 10).cast("string")), "b", F.lit("\n")).alias("content"))
    outer = groups.agg(_listing(groups, F.col("g"), "- [g](g", F.col("g").cast("string"), "/README.md)").alias("b")).select(F.lit("customers/README.md").alias("path"), F.concat(head(F.lit("2")), "b", F.lit("\n")).alias("content"))
    return reduce(DataFrame.unionByName, [regions, nations, customers, index, inner, outer])


def linked_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, sf_dir, changed=True)


def linked_corpus(spark: SparkSession, sf_dir: str, later: bool = False) -> Corpus:
    return _parsed(spark, sf_dir, ("region", "nation", "customer"), linked_later if later else linked, LINKED)


# A corpus of legacy paths, deliveries, plans and broken rules ---------------------------
FLAWED = Policy(
    areas=(("programs", "programs"), ("specs", "specs"), ("suppliers", "suppliers")),
    prefixes=frozenset({"IDX", "PART", "PRG", "SUP"}),
    extend_through=("contract",),
    legacy_paths="boundary",
    snapshot_types=("archive",),
    snapshot_rules=(SnapshotRule("delivery", ("completed",)),),
    delivery_types=("delivery",),
    evidence_roles=(("evidence", ("proof", "evidence")),),
)


def flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of parts, suppliers and nations with one flaw of a kind each."""
    part, supplier, nation = (read_table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    k, p, folder = F.col("p_partkey"), _s("p_partkey"), F.floor(F.col("p_partkey") / 20)
    goal = F.when(k % 4 == 0, F.concat(F.lit("../../suppliers/SUP-"), (k % 10).cast("string"), F.lit(".md"))).when(k % 4 == 1, F.concat(F.lit("missing-"), p, F.lit(".txt"))).when(k % 4 == 2, F.concat(F.lit("https://example.com/"), p)).otherwise(F.concat(F.lit("PART-"), p, F.lit(".md")))
    block = F.when(k % 6 == 0, F.concat(F.lit("<!-- tool:managed target=terms -->\nbody "), (k % 12).cast("string"), F.lit("\n<!-- /tool:managed target=terms -->\n"))).otherwise("")
    parts = part.select(*_page(F.concat(F.lit("specs/f"), folder.cast("string"), F.lit("/PART-"), p, F.lit(".md")), "---\nid: PART-", p, "\nrevision: 1\ntype: spec\nrelated: [", goal, "]\n---\n# Part ", p, "\n\n", F.when(k % 5 == 0, '<a id="lost"></a>\ntext\n').otherwise(""), F.when(k % 7 == 0, "### Contract\nx\n").otherwise("## Contract\nx\n"), block))
    listed = part.where(k % 3 != 0).groupBy(folder.alias("f")).agg(_listing(part, k, "- [p](PART-", p, ".md)").alias("b"))
    head = lambda number: F.concat(F.lit("---\nid: IDX-"), number.cast("string"), F.lit("\nrevision: 1\ntype: index\n---\n# Index\n"))
    f = F.col("f")
    indexes = listed.select(F.concat(F.lit("specs/f"), f.cast("string"), F.lit("/README.md")).alias("path"), F.concat(head(f), "b", F.lit("\n")).alias("content"))
    more = listed.where(f % 10 == 0).select(F.concat(F.lit("specs/f"), f.cast("string"), F.lit("/index.md")).alias("path"), head(f + 1_000_000).alias("content"))
    s, t = F.col("s_suppkey"), _s("s_suppkey")
    address = F.concat(F.lit("PART-"), t)
    cases = [F.concat(F.lit("["), address, F.lit("#contract]")), F.concat(F.lit("["), address, F.lit("#contract, "), address, F.lit("#contract]")), F.concat(F.lit("["), address, F.lit("]")), F.lit("[NONE-9#x]"), F.concat(F.lit("[SUP-"), t, F.lit("#proof]")), F.concat(F.lit("["), address, F.lit("#nowhere]")), F.lit("[]"), F.lit("text")]
    delivers = reduce(lambda out, i: F.when(s % 9 == i, cases[i]).otherwise(out), range(len(cases)), F.lit("[lower]"))
    status = F.when(s % 3 == 0, "completed").when(s % 3 == 1, "active").otherwise("planned")
    proof = F.when(s % 4 == 0, "").when(s % 4 == 1, "## Proof\nx\n## Evidence\ny\n").otherwise("## Proof\nx\n")
    suppliers = supplier.select(*_page(F.concat(F.lit("suppliers/SUP-"), t, F.lit(".md")), "---\nid: SUP-", t, "\nrevision: 1\ntype: delivery\nstatus: ", status, "\ndelivers: ", delivers, "\n---\n# Supplier ", t, "\n", proof))
    n, nk = _s("n_nationkey"), F.col("n_nationkey")
    third = F.when(nk % 5 == 0, "{id: last-").otherwise("{id: later-")
    plan = F.concat(F.lit("program_plan:\n  version: "), F.when(nk % 6 == 0, "2").otherwise("1"), F.lit("\n  milestones:\n  - {id: base-"), n, F.lit(", title: T, order: 1, roadmap: SUP-"), (nk % 10).cast("string"), F.lit("}\n  - {id: next-"), n, F.lit(", title: T, order: 2, prerequisites: [base-"), n, F.lit("]}\n  - "), third, n, F.lit(", title: T, order: 3, state: deferred, reopen_when: "), F.when(nk % 4 == 0, "[x]").otherwise("x"), F.when(nk % 3 == 0, ", colour: red").otherwise(""), F.lit("}\n"))
    odd = F.when(nk % 7 == 0, "program_plan: none\n").when(nk % 7 == 1, "program_plan: {version: 1, milestones: [], extra: 1}\n").otherwise(plan)
    programs = nation.select(*_page(F.concat(F.lit("programs/PRG-"), n, F.lit(".md")), "---\nid: PRG-", n, "\nrevision: 1\ntype: ", F.when(nk % 8 == 0, "note").otherwise("roadmap"), "\n", odd, "---\n# Program ", n, "\n"))
    loose = nation.select(F.concat(F.lit("loose/NAT-"), n, F.lit(".md")).alias("path"), F.lit("no front matter\n").alias("content"))
    return reduce(DataFrame.unionByName, [parts, indexes, more, suppliers, programs, loose])


def flawed_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return _parsed(spark, sf_dir, ("part", "supplier", "nation"), flawed, FLAWED)
