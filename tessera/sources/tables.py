"""Parquet table access with explicit column pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str,
          columns: Sequence[str] | None = None) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``; select only ``columns`` so the scan's
    ReadSchema carries just what the plan needs."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Deal rows over ``tessera.scan.partitions`` partitions (a session
    setting) before CPU-heavy per-row work, for inputs in a few small files;
    without the setting scans keep their splits."""
    n = df.sparkSession.conf.get("tessera.scan.partitions", None)
    if not n:
        return df
    return df.repartition(int(n), key) if key else df.repartition(int(n))
