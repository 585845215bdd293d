"""Generations: snapshots of a corpus in Parquet, named by content, and their differences.

A generation is a folder ``generation=<id>`` with tables partitioned by the namespace
and bucket of their documents, so a query for one document reads its bucket only. A
pointer row names the current generation; a reader that finds it stale parses afresh.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.resolve import addressed, reference_graph
from corpusloom.plans.session import materialize, scratch
from corpusloom.sources.corpus import Corpus

BUCKETS = 100


def with_shard(df: DataFrame, key: str = "document_id") -> DataFrame:
    """Adds namespace (the ID's prefix) and bucket (of its number)."""
    number = F.regexp_extract(key, r"-(\d+)$", 1).try_cast("decimal(38,0)")
    return df.withColumns({"namespace": F.regexp_extract(key, "^([A-Z0-9]+)-", 1), "bucket": F.coalesce((number % BUCKETS).cast("int"), F.lit(0))})


def document_table(corpus: Corpus) -> DataFrame:
    return corpus.documents.where("document_id IS NOT NULL").select("document_id", "path", "role", "revision", "doc_type", "status", "source_sha256", "additional")


def section_table(corpus: Corpus) -> DataFrame:
    return corpus.sections.where("document_id IS NOT NULL").select("document_id", "ordinal", "title", "anchor", "level", "start_line", "end_line", "sha256", "n_bytes")


def generation_id(corpus: Corpus) -> str:
    """A hash of the policy and of every document's path, identity and content.

    Rows are hashed where they lie and combined by sums, so order does not matter and
    nothing but numbers reaches the driver.
    """
    row = F.sha2(F.concat_ws("\x1f", "path", F.coalesce("document_id", F.lit("")), "role", "source_sha256"), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    found = corpus.documents.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256("|".join([corpus.policy.fingerprint(), *(str(v) for v in found)]).encode()).hexdigest()


def write_generation(corpus: Corpus, root: str) -> str:
    """Writes a generation unless it is there, appends it to the manifest, drops old ones."""
    spark, name = corpus.parsed.sparkSession, generation_id(corpus)
    known = manifest(spark, root)
    if known is None or known.where(F.col("generation") == name).isEmpty():
        rows = []
        with scratch(spark):
            edges, boundaries = reference_graph(corpus)
            edges = materialize(edges, "edges")  # resolving costs far more than what is written from it
            tables = {
                "documents": with_shard(document_table(corpus)),
                "sections": with_shard(section_table(corpus)),
                "edges": with_shard(edges, "src_doc"),
                "reverse_edges": with_shard(edges, "dst_doc"),
                "boundaries": with_shard(boundaries, "src_doc"),
            }
            for table, df in tables.items():
                path = f"{root}/generation={name}/{table}"
                df.repartition("namespace", "bucket").write.mode("overwrite").partitionBy("namespace", "bucket").parquet(path)
                rows.append((table, df.schema.json(), table_hash(spark.read.schema(df.schema).parquet(path))))
        spark.createDataFrame(rows, "table string, schema string, sha256 string").coalesce(1).write.mode("overwrite").parquet(f"{root}/generation={name}/hashes")
    row = spark.range(1).select(F.lit(name).alias("generation"), F.lit(corpus.policy.fingerprint()).alias("policy"), F.current_timestamp().alias("written"))
    row.write.mode("append").parquet(f"{root}/manifest")  # a reader sees the generation from here on
    _retain(spark, root, corpus.policy.keep_generations)
    return name


def table_hash(table: DataFrame) -> str:
    """A hash of a table's rows, whatever their order: sums of row hashes, and their number."""
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return hashlib.sha256("|".join(map(str, table.agg(F.count("*"), *parts).first())).encode()).hexdigest()


def _written(spark: SparkSession, root: str, generation: str) -> list[Row]:
    """(table, schema, sha256) of a generation's tables: a row each."""
    return spark.read.parquet(f"{root}/generation={generation}/hashes").collect()


def _table(spark: SparkSession, root: str, generation: str, table: str) -> DataFrame:
    """A table as it was written; one without rows has no file that tells its columns."""
    schema = next((r.schema for r in _written(spark, root, generation) if r.table == table), None)
    if schema is None:
        raise LookupError(f"a generation has no table {table}")
    return spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{root}/generation={generation}/{table}")


def is_intact(spark: SparkSession, root: str, generation: str, tables: tuple[str, ...] | None = None) -> bool:
    """Whether the tables of a generation are there and hash as when they were written."""
    try:
        hashes = {r.table: r.sha256 for r in _written(spark, root, generation)}
        return all(table_hash(_table(spark, root, generation, t)) == hashes[t] for t in tables or hashes)
    except (LookupError, Py4JJavaError, PySparkException):
        return False


def load_verified(corpus: Corpus, root: str, table: str) -> DataFrame:
    """A table of the current generation; stale or corrupt ones raise ``LookupError``."""
    spark, state = corpus.parsed.sparkSession, generation_status(corpus, root)
    name = generation_id(corpus)
    if state != "current" or not is_intact(spark, root, name, (table,)):
        raise LookupError(f"the generation is {state if state != 'current' else 'corrupt'}")
    return read_generation(spark, root, name, table)


def write_federated(corpora: dict[str, Corpus], root: str, policy_of: dict[str, str] | None = None) -> dict[str, bool]:
    """Writes each source's tables under the hash of its content; says which were there already.

    A source that did not change is reused, and objects that no source names any more go.
    """
    spark = next(iter(corpora.values())).parsed.sparkSession
    names = {s: hashlib.sha256(f"{s}|{(policy_of or {}).get(s, '')}|{generation_id(c)}".encode()).hexdigest() for s, c in sorted(corpora.items())}
    before = _federated_names(spark, root)
    reused = {}
    for source, name in names.items():
        reused[source] = before.get(source) == name
        if not reused[source]:
            tables = {"documents": document_table(corpora[source]), "edges": reference_graph(corpora[source])[0]}
            for table, df in tables.items():
                df.write.mode("overwrite").parquet(f"{root}/objects/{name}/{table}")
    spark.createDataFrame(sorted(names.items()), "source string, object string").coalesce(1).withColumn("written", F.current_timestamp()).write.mode("append").parquet(f"{root}/sources")
    for old in set(before.values()) - set(names.values()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/objects/{old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return reused


def _federated_names(spark: SparkSession, root: str) -> dict[str, str]:
    """The object of every source of the snapshot written last: as many rows as sources."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/sources")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    rows = spark.read.parquet(f"{root}/sources")
    return {r.source: r.object for r in rows.groupBy("source").agg(F.max_by("object", "written").alias("object")).collect()}


def read_federated(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of all sources of a federated snapshot, with a leading column ``source``."""
    parts = [spark.read.parquet(f"{root}/objects/{name}/{table}").select(F.lit(source).alias("source"), "*") for source, name in sorted(_federated_names(spark, root).items())]
    if not parts:
        raise LookupError(f"no federated snapshot under {root}")
    return reduce(DataFrame.unionByName, parts)


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{root}/manifest").groupBy("generation", "policy").agg(F.max("written").alias("written"))


def _retain(spark: SparkSession, root: str, keep: int) -> None:
    """Deletes the folders of all but the ``keep`` generations written last."""
    rows = [r.generation for r in manifest(spark, root).orderBy(F.desc("written")).collect()]
    for name in rows[max(1, keep) :]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/generation={name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def resolve_generation(spark: SparkSession, root: str, selector: str) -> str:
    """The one generation that a full hash or at least 12 characters of it name."""
    found = manifest(spark, root)
    if found is None or len(selector) < 12:
        raise LookupError("no generations, or a selector of fewer than 12 characters")
    rows = found.where(F.col("generation").startswith(selector)).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{len(rows)} generations begin with {selector}")
    return rows[0].generation


def read_generation(spark: SparkSession, root: str, generation: str, table: str, document_id: str | None = None) -> DataFrame:
    """A table of a generation, or one document's part of it by its bucket alone."""
    df = _table(spark, root, generation, table)
    if document_id is None:
        return df.drop("namespace", "bucket")
    namespace, number = document_id.rsplit("-", 1)
    key = {"edges": "src_doc", "boundaries": "src_doc", "reverse_edges": "dst_doc"}.get(table, "document_id")
    own = (F.col("namespace") == namespace) & (F.col("bucket") == int(number) % BUCKETS) & (F.col(key) == document_id)
    return df.where(own).drop("namespace", "bucket")


def generation_status(corpus: Corpus, root: str, verify: bool = False) -> str:
    """missing, current, stale or corrupt: whether the newest generation is that of the corpus.

    Corrupt, which only ``verify`` looks for, is one of the corpus' name whose tables are
    not as they were written; that reads all of them.
    """
    found = manifest(corpus.parsed.sparkSession, root)
    if found is None:
        return "missing"
    newest = found.orderBy(F.desc("written")).first()
    if not newest or newest.generation != generation_id(corpus):
        return "stale"
    return "corrupt" if verify and not is_intact(corpus.parsed.sparkSession, root, newest.generation) else "current"


def load_edges(corpus: Corpus, root: str | None) -> DataFrame:
    """Addressed edges from a current generation, else resolved afresh; never a mix."""
    if root and generation_status(corpus, root) == "current":
        return addressed(read_generation(corpus.parsed.sparkSession, root, generation_id(corpus), "edges"))
    return addressed(reference_graph(corpus)[0])


def document_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, change): added, removed or changed content; a rename is no change."""
    a = old.select("document_id", F.col("source_sha256").alias("a"))
    b = new.select("document_id", F.col("source_sha256").alias("b"))
    both = a.join(b, "document_id", "full_outer").where("NOT (a <=> b)")
    return both.select("document_id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def section_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, anchor, change) of sections, by content."""
    a = old.select("document_id", "anchor", F.col("sha256").alias("a"))
    b = new.select("document_id", "anchor", F.col("sha256").alias("b"))
    both = a.join(b, ["document_id", "anchor"], "full_outer").where("NOT (a <=> b)")
    return both.select("document_id", "anchor", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def metadata_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, name, before, after) of fields, from ``field_rows`` of both sides."""
    a = old.select("document_id", "name", F.col("value_json").alias("before"))
    b = new.select("document_id", "name", F.col("value_json").alias("after"))
    return a.join(b, ["document_id", "name"], "full_outer").where("NOT (before <=> after)")


def source_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, change) of registered sources whose digest, policy, state or count differ."""
    fields = ("digest", "policy", "state", "documents")
    a = old.select("source", F.struct(*fields).alias("a"))
    b = new.select("source", F.struct(*fields).alias("b"))
    both = a.join(b, "source", "full_outer").where("NOT (a <=> b)")
    return both.select("source", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
