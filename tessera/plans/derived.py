"""Paired-text relations derived from the driver tables.

* ``pairs_conv``: a user turn and the assistant turn that answers it.
* ``doc_lines``: the cleaned non-empty lines of each document.
* ``doc_candidates``: per document the first line is the gold summary and
  every later line is a candidate (``cand_rank`` 0, 1, ...).  Built row-locally
  from one scan, so gold travels with its candidates and no join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.sources.tables import spread, table


def documents(spark: SparkSession, sf: str, cols=("doc_id", "text")) -> DataFrame:
    return spread(table(spark, sf, "documents", list(cols)), "doc_id")


def pairs_conv(spark: SparkSession, sf: str) -> DataFrame:
    conv = spread(table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"]), "conv_id")
    user = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("source"))
    reply = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return user.join(reply, ["conv_id", "turn"])


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id", F.posexplode(tx.non_empty_lines("text")).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("long"))


def doc_candidates(spark: SparkSession, sf: str, with_source: bool = False) -> DataFrame:
    """(sample_id, cand_rank, text, gold[, source]) — one row per candidate."""
    cols = ["doc_id", "text"]
    d = documents(spark, sf, cols).select(
        F.col("doc_id").alias("sample_id"),
        F.col("text").alias("source"),
        tx.non_empty_lines("text").alias("_lines"))
    out = d.select(
        "sample_id", "source", F.get(F.col("_lines"), 0).alias("gold"),
        F.posexplode(F.slice(F.col("_lines"), 2, F.greatest(F.size("_lines") - 1, F.lit(1))))
         .alias("cand_rank", "text"),
    ).where(F.col("gold").isNotNull()).withColumn("cand_rank", F.col("cand_rank").cast("long"))
    keep = ["sample_id", "cand_rank", "text", "gold"] + (["source"] if with_source else [])
    return out.select(*keep)


def doc_candidate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, cand_rank, pt, rt): ROUGE tokens of each candidate and of
    its gold; every line of a document is tokenised once, before candidates
    fan out."""
    d = documents(spark, sf).select(
        F.col("doc_id").alias("sample_id"),
        F.transform(tx.non_empty_lines("text"), lambda line: tx.alnum_tokens(line)).alias("_toks"))
    d = d.where(F.size("_toks") > 1)
    return d.select("sample_id", F.get("_toks", F.lit(0)).alias("rt"),
                    F.posexplode(F.slice("_toks", 2, F.size("_toks") - 1)).alias("cand_rank", "pt")
                    ).select("sample_id", F.col("cand_rank").cast("long").alias("cand_rank"), "pt", "rt")


def doc_gold(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, gold, source): the first cleaned line of each document."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("sample_id"),
        tx.first_line("text").alias("gold"),
        F.col("text").alias("source")).where(F.col("gold").isNotNull())
