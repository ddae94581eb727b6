"""Five stages from raw documents to token ids; each works on all that the stage before it kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from skylag.llm import decontaminate, exact_dedup, jaccard, language_id, sentencepiece_bpe
from skylag.llm.tables import reach_workers, read_table, shared_path

#: A document goes if its text has no letter, or if the network gives no language this much. Of few languages the best
#: one nearly always has more, so that only texts in none of them go.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels know."""
    return language_id.accept(docs, language_id.fit(docs), LEAST_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.remove(docs, decontaminate.indexes(read_table(spark, sf_dir, "benchmark")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their texts."""
    return sentencepiece_bpe.encode(docs)


def _prepared(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reach_workers(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, _prepared(stage)) for name, stage in [
    ("language_id", identify_language), ("exact_dedup", drop_copies), ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark), ("sentencepiece", tokenise)]]

#: Two stages (a trained network, a vocabulary) are not to be had in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
