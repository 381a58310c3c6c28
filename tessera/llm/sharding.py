"""Sharding by jump consistent hashing.

Law ``key``: the row's key and the number of shards decide its shard, nothing
else.  There is no ring table, so adding machines or rows changes nothing, and
appending one shard moves only the rows that the new shard takes (about one in
``n + 1``); no row moves between old shards.  The hash of the key is mapped by
the published jump rule in numpy, row by row, without a shuffle; only the
slots need one, over the narrow columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import cut_lineage, read, slots


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach) of unsigned 64-bit keys."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    out = np.zeros(len(keys), dtype=np.int32)
    rows = np.arange(len(keys))
    k, b, j = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    while len(rows):
        b = j
        k = k * np.uint64(2862933555777941757) + np.uint64(1)
        j = ((b + 1) * (float(1 << 31) / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        done = j >= shards
        out[rows[done]] = b[done]
        k, j, rows = k[~done], j[~done], rows[~done]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """Shard (int, from 0) of a key column of any type; null keys share the
    shard of their hash seed."""
    @F.pandas_udf("int")
    def placed(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy(np.int64).view(np.uint64), shards))

    return placed(F.xxhash64(key))


def jump_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1, ``text_crc32`` the
    unsigned CRC-32 of those bytes (null: of no byte, 0), ``slot`` the row's
    gapless place in its shard by key, ``grown_shard`` its shard once one more
    is appended.  Rows with equal keys get the same shard and slots next to
    each other; an empty table gives an empty result; other columns are not
    read, whatever their names.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), shards).alias("shard"),
        shard_of(F.col(key), shards + 1).alias("grown_shard"))
    # written once: ordering samples its input before it deals it out
    placed = slots(cut_lineage(rows), "shard", [key], "slot")
    return placed.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id",
                 rows_per_file: int = 1_000_000) -> None:
    """Write whole rows as Parquet, one folder for each shard.  Every task
    writes its own files, so a large shard needs no task of its own."""
    (docs.withColumn("shard", shard_of(F.col(key), shards))
         .write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path))


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards(read(spark, sf_dir, "documents", "doc_id", "text"), 16)
