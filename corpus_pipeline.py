"""A corpus pipeline: five stages over ``documents``, each on what the one before kept.

1. toxicity: documents that the factorization machine rejects go.
2. near_dedup: one document of each group of near-duplicates stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. pii: personal data in the texts is replaced by its kind.
5. mixing: every document gets the rate at which to draw it for the target mix.

Rows whose text is null or empty pass all stages (they hold nothing to reject). Rows
without a doc_id are no copies of each other and stay. Rows of one doc_id and text fare
alike: near_dedup keeps all or none of them. An empty table gives an empty result. Extra
columns pass as they are, whatever their names. What a stage writes for itself is
deleted when its result is written, and that when the next one's is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, mixing, neardup, pii, toxicity
from corpusloom.llm.queries import TARGETS, label_domain
from corpusloom.plans.session import drop_path, materialize, read_table, scratch


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is 0.5 or more."""
    (score,) = _fresh(docs, "score")
    machine = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine, tuple(docs.columns), score).where(F.col(score) < 0.5).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group."""
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a hit word."""
    plain = docs.select("doc_id", "text", *(F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)))
    names = [f"_{i}" for i in range(len(docs.columns))]
    found = decontaminate.scan(plain, read_table(spark, sf_dir, "benchmark"), keep=tuple(names)).where("n_hit = 0")
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span found; n_chars, where there is such a column, follows."""
    (masked,) = _fresh(docs, "masked")
    out = pii.masked(docs, tuple(docs.columns), masked).withColumn("text", F.col(masked)).drop(masked)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's rate and likeliest domain for the target mix, and what the mix misses."""
    plain = docs.select("doc_id", "text", *(F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)))
    names = [f"_{i}" for i in range(len(docs.columns))]
    found = mixing.mix(plain, read_table(spark, sf_dir, "labels"), TARGETS, label_domain(), tuple(names))  # tokens are words: a worker of five stages has no memory for a transducer
    rate, domain, gap = _fresh(docs, "rate", "domain", "gap")
    made = [F.round("rate", 6).alias(rate), F.col("domain").alias(domain), F.round("gap", 6).alias(gap)]
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)), *made)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Trained models decide in two stages, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written and read again by the next."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scratch(spark) as own:
            docs = own.keep(materialize(stage(spark, docs, sf_dir), name))
            written = own.paths[-1]
        if before:
            drop_path(spark, before)
        before = written
    return docs
