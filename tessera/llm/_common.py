"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordering import global_index
from tessera.session import checkpoint_dir, cut_lineage  # noqa: F401

#: ASCII white space, as a Java and as a Python character class body.
WS = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of one given table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def sliced(run, rows: int = 512, mb: int = 16):
    """``run`` over smaller Arrow batches, bounded by rows and by bytes, so
    that long texts don't pile up in a worker; the session stays as it is."""
    def slices(batches):
        for batch in batches:
            most = max(1, min(rows, batch.num_rows * (mb << 20) // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, most):
                yield batch.slice(at, most)

    return lambda batches: run(slices(batches))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{WS}]+|[{WS}]+$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{WS}]+"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slots(df: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """Gapless position (from 0) of each row inside its group, by ``order``.

    For few groups (their number is a parameter of the caller): rows are
    ordered over range partitions, so a group with most of the rows is spread
    over many tasks, and only one row per group is broadcast.
    """
    rows = global_index(df, [group, *order], "_at")
    first = rows.groupBy(group).agg(F.min("_at").alias("_first"))
    first = first.withColumnRenamed(group, "_group")
    return (rows.join(F.broadcast(first), rows[group].eqNullSafe(first["_group"]))
                .withColumn(name, (F.col("_at") - F.col("_first")).cast("long"))
                .drop("_at", "_first", "_group"))
