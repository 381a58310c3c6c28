"""Writers (K1-K9).  Row order in exported text files is an explicit key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, default_partitions


def write_pairs_text(pairs: DataFrame, out_dir: str, prefix: str, key: str = "pair_id",
                     parts: int | None = None, mode: str = "errorifexists") -> None:
    """``{prefix}.source`` / ``{prefix}.target`` folders whose i-th part files
    hold the same rows: both are written from one range-partitioned,
    checkpointed frame."""
    n = parts or default_partitions(pairs.sparkSession)
    staged = cut_lineage(pairs.repartitionByRange(n, key).sortWithinPartitions(key))
    for col in ("source", "target"):
        staged.select(col).write.mode(mode).text(f"{out_dir.rstrip('/')}/{prefix}.{col}")


def write_tsv(df: DataFrame, path: str, header: bool = False, mode: str = "errorifexists",
              reject_tabs: Sequence[str] = ()) -> None:
    """Tab-separated export; text columns in ``reject_tabs`` must not hold a
    tab or newline (the job fails instead of corrupting the file)."""
    out = df
    for c in reject_tabs:
        bad = F.col(c).rlike("[\t\n]")
        out = out.where(F.when(bad, F.raise_error(F.concat(F.lit(f"tab/newline in {c}: "), F.col(c))))
                        .otherwise(F.lit(True)))
    out.write.mode(mode).option("sep", "\t").option("header", header).option("quote", "\u0000").csv(path)


def write_quoted_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated export with a header, in which cells may hold tabs,
    newlines and quotes: every cell is quoted, quotes in it are doubled."""
    out = df.write.mode(mode).option("sep", "\t").option("header", True).option("quoteAll", True).option("quote", '"').option("escape", '"')
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_shards(df: DataFrame, directory: str, rank: str, mode: str = "errorifexists") -> None:
    """JSON records of each rank in a folder ``rank_{k}.json`` of its own."""
    df.withColumn("rank", F.format_string("rank_%d.json", F.col(rank).cast("long"))).write.mode(mode).partitionBy("rank").json(directory)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append metric rows (sorted keys) to a growing table."""
    metrics.select(*sorted(metrics.columns)).write.mode("append").parquet(path)


def write_metrics_json(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row with keys in sorted order."""
    metrics.select(*sorted(metrics.columns)).write.mode(mode).json(path)


def write_ordered_text(df: DataFrame, path: str, key: str | Sequence[str], text: str, mode: str = "errorifexists") -> None:
    """Newline-terminated lines in key order (range-partitioned part files)."""
    df.orderBy(*([key] if isinstance(key, str) else key)).select(text).write.mode(mode).text(path)


def write_sections(sections: DataFrame, path: str, key: str, mode: str = "errorifexists") -> None:
    """The rows of ``cluster_sections`` as text."""
    write_ordered_text(sections, path, ["cluster_no", "kind", key], "line", mode)


def carry_split(*frames: DataFrame) -> DataFrame:
    """Union untouched splits with processed ones (duplicates kept)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
