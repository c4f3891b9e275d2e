"""A corpus from raw documents to packed sequences.

Documents that the quality classifier rejects go, then exact copies, then all but one of each group of near copies (five-word shingles,
Jaccard similarity of at least 0.8); what stays is mixed to the sources' target weights, which repeats documents and may cut one document of each source, and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, exact_dedup, jaccard_join, mixing, packing, quality
from millrace.llm.queries import tokenizer_path


def settings(spark: SparkSession) -> None:
    """This job's own: a stage's result runs when it is written, and texts should reach Python in small batches then too."""
    for name, value in (("maxRecordsPerBatch", common.BATCH_ROWS), ("maxBytesPerBatch", common.BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settings(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settings(spark)
    return exact_dedup.drop_duplicates(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settings(spark)
    return jaccard_join.one_of_each(docs, words=5, num=80, den=100)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality classifier", good), ("exact dedup", unique), ("n-gram Jaccard join", apart), ("mixing", mixed), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
