"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procaudit.llm.common import scratch_path
from procaudit.llm.decontaminate import decontaminate
from procaudit.llm.line_dedup import dedup_lines
from procaudit.llm.mixing import mix_sources
from procaudit.llm.ngram_join import near_duplicates
from procaudit.llm.quality import keep_good

#: Near-duplicate stages take five-word shingles and a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are judged like any; very long ones as a
    whole; repeated rows stay or go together; an empty table stays empty."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay in one document only, that of the largest id; ``n_chars`` follows the text. Null texts stay
    null, empty ones empty; repeated rows of one id lose the same lines; an empty table stays empty."""
    cut = dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, all its rows if it is repeated. Documents
    without an id, null, empty and blank texts stay; very long texts are compared whole; an empty table stays empty."""
    groups = near_duplicates(docs, n=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    return docs.join(groups.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go, repeated rows alike. Null and empty texts stay; very long texts are
    searched whole; an empty table stays empty."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which documents the mixture takes, in which epoch and block: a row a document and epoch. A null source is one of
    its own; texts without words cost nothing; repeated rows count each; without tokens there are no rows."""
    return mix_sources(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("ngram_join", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
