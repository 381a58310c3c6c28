"""The corpus pipeline: stages over ``documents``, each one of the operators
of ``tessera.llm``.  Every stage's rows are written as Parquet in the shared
folder and read again as the next stage's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm._common import checkpoint_dir
from tessera.llm.langid import keep_known
from tessera.llm.packing import pack
from tessera.llm.quality import keep_good
from tessera.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the weighed rules reject."""
    return keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter, or no language with half of theirs."""
    return keep_known(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Buckets and batches of the documents that are left."""
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("language ID", language), ("SimHash near-dedup", simhash), ("packing", packing)]

#: Estimated rules, learned languages and fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the rows of the last one."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
