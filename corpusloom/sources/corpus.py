"""A corpus as tables: files, memberships, and what parsing finds in each document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

from corpusloom.functions.markdown import INDEX_NAMES, parse_document
from corpusloom.plans.session import materialize, shuffle_partitions, ship
from corpusloom.sources.policy import Policy

def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


_TEXT, _INT, _LONG, _FLAG = StringType(), IntegerType(), LongType(), BooleanType()
PARSED = _struct(
    path=_TEXT,
    content=_TEXT,
    lines=ArrayType(_TEXT),
    end_line=_INT,
    document_id=_TEXT,
    revision=_LONG,
    doc_type=_TEXT,
    status=_TEXT,
    relations=ArrayType(_struct(relation=_TEXT, kind=_TEXT, target=_TEXT, pin=_LONG)),
    additional=ArrayType(_struct(name=_TEXT, value_type=_TEXT, value_json=_TEXT)),
    issues=ArrayType(_struct(message=_TEXT, affects_graph=_FLAG)),
    sections=ArrayType(_struct(ordinal=_INT, title=_TEXT, anchor=_TEXT, level=_INT, start_line=_INT, end_line=_INT)),
    section_issues=ArrayType(_TEXT),
    links=ArrayType(_struct(ordinal=_INT, raw=_TEXT, line=_INT)),
    reach_links=ArrayType(_TEXT),
)


@dataclass(frozen=True)
class Corpus:
    """Tables of one corpus. ``documents`` has one row per included file."""

    policy: Policy
    memberships: DataFrame  #: path, state, role, reason
    parsed: DataFrame  #: PARSED and role, is_index, written once

    @property
    def documents(self) -> DataFrame:
        return self.parsed.select("path", "role", "is_index", "document_id", "revision", "doc_type", "status", "additional", F.sha2("content", 256).alias("source_sha256"))

    @property
    def unique(self) -> DataFrame:
        """Documents whose ID no other has; copies of an ID leave every graph."""
        known = self.parsed.where("document_id IS NOT NULL").select("document_id", "revision", "doc_type", "status", "path", "role")
        once = known.groupBy("document_id").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("revision", "doc_type", "status", "path", "role")))
        return once.where("n = 1").drop("n")

    @property
    def sections(self) -> DataFrame:
        one = self.parsed.select("path", "document_id", F.explode("sections").alias("s"), "lines")
        text = section_text(F.col("lines"), F.col("s.start_line"), F.col("s.end_line"))
        return one.select("path", "document_id", "s.*", F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("n_bytes"))

    @property
    def headings(self) -> DataFrame:
        """Sections without what their text would have to be read for."""
        return self.parsed.select("path", "document_id", F.explode("sections").alias("s")).select("path", "document_id", "s.*")

    @property
    def relations(self) -> DataFrame:
        return self.parsed.where("document_id IS NOT NULL").select("path", "document_id", F.explode("relations").alias("r")).select("path", "document_id", "r.*")

    @property
    def links(self) -> DataFrame:
        return self.parsed.where("document_id IS NOT NULL").select("path", "document_id", F.explode("links").alias("l")).select("path", "document_id", "l.*")

    @property
    def metadata_issues(self) -> DataFrame:
        return self.parsed.select("path", "document_id", F.explode("issues").alias("i")).select("path", "document_id", "i.*")

    @property
    def section_issues(self) -> DataFrame:
        return self.parsed.select("path", "document_id", F.explode("section_issues").alias("message"))


def section_text(lines, start, end):
    """Lines start..end without white space at the end, and a line end."""
    part = F.array_join(F.slice(lines, start, F.greatest(F.lit(0), end - start + 1)), "\n")
    return F.concat(F.regexp_replace(part, r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2028}\x{2029}]+$", ""), F.lit("\n"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ``*`` stays in a name, ``**`` spans names."""
    out = []
    for part in glob.split("/"):
        if part == "**":
            out.append("(?:[^/]+/)*")
        else:
            own = re.sub(r"[*?]|\[!?[^\]]*\]|[^\w]", lambda m: {"*": "[^/]*", "?": "[^/]"}.get(m[0]) or (m[0].replace("[!", "[^") if len(m[0]) > 1 else re.escape(m[0])), part)
            out.append(own + "/")
    return "^" + "".join(out).removesuffix("/") + "$"


def list_files(root: str | Path) -> list[str]:
    """Relative paths of all Markdown files, hidden and underscored ones included."""
    base = Path(root)
    return sorted(p.relative_to(base).as_posix() for p in base.rglob("*") if p.suffix.lower() == ".md" and p.is_file())


def scan_files(spark: SparkSession, root: str | Path) -> DataFrame:
    """(path, content) of a folder that driver and executors see under one name.

    Spark's own readers drop names that begin with ``_`` or ``.``, so the driver lists.
    """
    ship(spark)
    paths, base = list_files(root), str(root)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths) // 64, 512)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = [(Path(base) / n).read_bytes().decode("utf-8", "replace") for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "content"])

    return listed.mapInArrow(read, "path string, content string")


def memberships(files: DataFrame, policy: Policy, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(path, state, role, reason): excluded by the first glob, else of the deepest area."""
    role = F.lit(None).cast("string")
    for name, folder in sorted(policy.areas, key=lambda a: (0 if a[1] == "." else len(a[1].split("/")), a[0])):
        inside = F.lit(True) if folder == "." else F.col("path").startswith(folder.rstrip("/") + "/")
        role = F.when(inside, F.lit(name)).otherwise(role)
    reason = F.coalesce(*(F.when(F.col("path").rlike(glob_pattern(g)), F.lit(g)) for g in policy.exclude), F.lit(None).cast("string"))
    found = files.where(F.lower("path").endswith(".md")).select(*keep, reason.alias("reason"), role.alias("role"))
    state = F.when(F.col("reason").isNotNull(), "excluded").when(F.col("role").isNull(), "unmapped").otherwise("included")
    return found.select(*keep, state.alias("state"), F.when(F.col("reason").isNull(), F.col("role")).alias("role"), "reason")


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """``values`` as an array; lists of mappings field by field, which is much faster than whole ones."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    flat = [x for own in values for x in own]
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    fields = list(kind.value_type)
    inner = pa.StructArray.from_arrays([_column([x[f.name] for x in flat], f.type) for f in fields], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends), inner, type=kind)


def parse_files(files: DataFrame, policy: Policy) -> DataFrame:
    """One row of ``PARSED`` per file, by one Arrow-batched pass of the parser."""
    ship(files.sparkSession)
    schema, prefixes = to_arrow_schema(PARSED), policy.prefixes
    columns = lambda rows: [_column([r[f.name] for r in rows], f.type) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500).to_pylist()
                yield pa.RecordBatch.from_arrays(columns([{"path": r["path"], **parse_document(r["content"] or "", prefixes)} for r in part]), schema=schema)

    return files.select("path", "content").mapInArrow(run, PARSED)


def build_corpus(files: DataFrame, policy: Policy) -> Corpus:
    """Parses the included files once; the result is written and read by every query.

    Files are dealt out by path first: parsing costs far more than moving a text.
    """
    files = files.repartition(max(shuffle_partitions(files.sparkSession), files.sparkSession.sparkContext.defaultParallelism), "path")
    members = memberships(files, policy)
    parsed = memberships(parse_files(files, policy), policy, ("path", *PARSED.fieldNames()[1:]))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    whole = parsed.where("state = 'included'").drop("state", "reason").withColumn("is_index", name.isin(*INDEX_NAMES))
    return Corpus(policy, members, materialize(whole, "corpus"))


