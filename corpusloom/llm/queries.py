"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, licenses, media, mixing, neardup, oracle, pii, substring, suffixes, tokencount, toxicity
from corpusloom.plans.session import read_table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.scan(docs, items))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.substring_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the named public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path())


#: Shares of all tokens that the mix aims at, by the labels' quality and toxicity.
TARGETS = {"good": 0.80, "plain": 0.12, "good toxic": 0.06, "plain toxic": 0.02}


def label_domain() -> Column:
    quality = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    return F.concat(quality, F.when(F.col("toxic") == 1, " toxic").when(F.col("toxic") == 0, ""))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    found = mixing.mix(docs, labels, TARGETS, label_domain(), tokenizer=tokenizer_path())
    return found.select("doc_id", "n_tokens", "domain", F.transform("posterior", lambda x: F.round(x, 6)).alias("posterior"), F.round("rate", 6).alias("rate"), F.round("gap", 6).alias("gap"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents")).drop("found")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(read_table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.decided(toxicity.score(docs, machine))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"]))
    return found.select("doc_id", "n_words", "license", F.round("coverage", 6).alias("coverage"), "n_aligned", F.array_join(spans, ",").alias("matches"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.suffix_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_substring": op2_substring,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_media": op6_media,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op9_suffix_array": op9_suffix_array,
    "op10_minhash": op10_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": oracle.DECONTAMINATE,
    "op2_substring": oracle.SUBSTRING,
    "op10_minhash": oracle.NEAR_DUPLICATES,
}
