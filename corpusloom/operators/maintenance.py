"""Managed blocks over a whole corpus, and migrations of legacy relations.

Markers are found by the parser of ``functions.blocks``, one pass over the texts; who
owns a block, and whether it still says what its source says, are joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.blocks import Span, block_diff, block_text, replace_block, rewrite_relations, scan_markers
from corpusloom.operators.resolve import legacy_relations
from corpusloom.operators.transactions import Edit
from corpusloom.plans.session import ship
from corpusloom.sources.corpus import Corpus, build_corpus

_BLOCK = "path string, document_id string, kind string, start int, end int, body string, issue string"


def marker_table(corpus: Corpus, target: str) -> DataFrame:
    """(path, document_id, kind, start, end, body, issue): blocks of a target, and what is wrong."""
    ship(corpus.parsed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                spans, issues = scan_markers(r["content"], target)
                own = {"path": r["path"], "document_id": r["document_id"]}
                rows += [{**own, "kind": s.kind, "start": s.start, "end": s.end, "body": block_text(r["content"], s), "issue": None} for s in spans]
                rows += [{**own, "kind": None, "start": None, "end": None, "body": None, "issue": i} for i in issues]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return corpus.parsed.where(F.col("content").contains(target)).select("path", "document_id", "content").mapInArrow(run, _BLOCK)


_ARROW = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (c.split(" ") for c in _BLOCK.split(", "))])


def _bound(corpus: Corpus, target: str, sources: DataFrame | None) -> DataFrame:
    """(path, document_id, start, end, anchor, state, wanted) of every managed block of a target."""
    blocks = marker_table(corpus, target).where("issue IS NULL")
    held = blocks.where("kind = 'managed'").join(corpus.headings.select("path", "anchor", "start_line", "end_line"), "path", "left")
    inside = (F.col("start_line") <= F.col("start")) & (F.col("end") <= F.col("end_line"))
    owned = held.groupBy("path", "document_id", "start", "end", "body").agg(F.max_by(F.when(inside, F.col("anchor")), F.when(inside, F.col("start_line"))).alias("anchor"))
    said = (blocks.where("kind = 'source'") if sources is None else sources).agg(F.count("*").alias("n"), F.min("body").alias("wanted"))
    found = owned.join(F.broadcast(said))  # one row
    state = F.when(F.col("anchor").isNull(), "unowned").when(F.col("n") != 1, "unbound").when(F.col("body") == F.col("wanted"), "current").otherwise("drifted")
    return found.select("path", "document_id", "start", "end", "anchor", state.alias("state"), "wanted")


def occurrences(corpus: Corpus, target: str, sources: DataFrame | None = None) -> DataFrame:
    """(document_id, anchor, state) of every managed block of a target.

    ``anchor`` is of the innermost section that holds the block. The one source block of
    the target (or of ``sources``, which has ``body``) decides: current or drifted; with
    none or several sources every block is unbound. Blocks outside sections are unowned.
    """
    return _bound(corpus, target, sources).select("document_id", "anchor", "state")


_PREVIEW = pa.schema([("path", pa.string()), ("document_id", pa.string()), ("before", pa.string()), ("content", pa.string()), ("diff", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def preview(corpus: Corpus, target: str, sources: DataFrame | None = None) -> DataFrame:
    """(path, document_id, before, content, diff, starts, ends): files with drifted blocks as they should be.

    ``before`` is the sha256 of the file as it is; ``starts`` and ``ends`` are the lines
    of the blocks, markers included, outside which nothing changes.
    """
    ship(corpus.parsed.sparkSession)
    drifted = _bound(corpus, target, sources).where("state = 'drifted'").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.first("wanted").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                spans = [Span("managed", s["start"], s["end"]) for s in r["spans"]]
                text, diffs = r["content"], []
                for span in reversed(spans):
                    diffs.append(block_diff(block_text(text, span), r["wanted"]))
                    text = replace_block(text, span, r["wanted"])
                rows.append({"path": r["path"], "document_id": r["document_id"], "before": r["before"], "content": text, "diff": "".join(reversed(diffs)), "starts": [s.start for s in spans], "ends": [s.end for s in spans]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_PREVIEW)

    joined = corpus.parsed.select("path", "document_id", "content", F.sha2("content", 256).alias("before")).join(drifted, "path")
    return joined.mapInArrow(run, "path string, document_id string, before string, content string, diff string, starts array<int>, ends array<int>")


def write_plan(corpus: Corpus, target: str) -> tuple[list[Edit], dict[str, str]]:
    """The edits that a preview shows, and as a guard the file of the source block.

    A file that holds both the source block and a drifted one is an error. The files are
    brought to the driver, which writes them.
    """
    edits = [Edit(r.path, r.before, r.content, tuple(zip(r.starts, r.ends, strict=True))) for r in preview(corpus, target).orderBy("path").toLocalIterator()]
    source = marker_table(corpus, target).where("kind = 'source'").select("path").join(corpus.parsed.select("path", F.sha2("content", 256).alias("sha256")), "path")
    guards = {r.path: r.sha256 for r in source.limit(2).collect()}
    if shared := sorted(guards.keys() & {e.path for e in edits}):
        raise ValueError(f"source and drifted blocks share {', '.join(shared)}")
    return edits, guards


def migration_plan(corpus: Corpus) -> DataFrame:
    """(path, document_id, content): files whose legacy relations can be stable IDs, rewritten."""
    ship(corpus.parsed.sparkSession)
    moves = legacy_relations(corpus).where("target_id IS NOT NULL").groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("value", "target_id"))).alias("moves"))
    schema = pa.schema([("path", pa.string()), ("document_id", pa.string()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": r["path"], "document_id": r["document_id"], "content": rewrite_relations(r["content"], dict(r["moves"]))} for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    joined = corpus.parsed.select("path", "document_id", "content").join(moves, "path")
    return joined.mapInArrow(run, "path string, document_id string, content string")


def migrated(corpus: Corpus, plan: DataFrame) -> Corpus:
    """The corpus that applying a migration plan would leave, parsed afresh to validate it."""
    files = corpus.parsed.select("path", "content").join(plan.select("path", F.col("content").alias("_new")), "path", "left")
    return build_corpus(files.select("path", F.coalesce("_new", "content").alias("content")), corpus.policy)
