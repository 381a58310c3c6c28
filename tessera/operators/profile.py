"""Category counts, numeric profiles and target/source word overlap
(P3, A1, A2, A3, B7, A11, T3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.arrays import distinct_overlap_ratio
from tessera.operators.ordering import exact_quantiles
from tessera.session import cut_lineage

R = 6


def collapse_rare(df: DataFrame, col: str, threshold: int, out: str) -> DataFrame:
    """Replace categories seen at most ``threshold`` times (inclusive) by
    ``<rare>``.  Counts are a partial aggregate joined back (AQE broadcasts
    the count table when it is small, shuffles it otherwise); the rows, which
    should be narrow, are written once for both sides."""
    df = cut_lineage(df)
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return (df.join(counts, col, "left")
              .withColumn(out, F.when(F.col("_n") <= threshold, F.lit(tx.RARE_LABEL))
                                .otherwise(F.col(col)))
              .drop("_n"))


def category_counts(df: DataFrame, col: str) -> DataFrame:
    counts = cut_lineage(df.groupBy(col).agg(F.count(F.lit(1)).alias("n")))
    total = F.broadcast(counts.agg(F.sum("n").alias("_total")))  # one row
    return counts.crossJoin(total).select(col, "n", F.round(F.col("n") / F.col("_total"), R).alias("share"))


def numeric_profile(df: DataFrame, value: str, probs: dict[str, float],
                    group: Sequence[str] = (), prefix: str = "v", count_name: str = "n",
                    with_minmax_round: bool = False) -> DataFrame:
    """count, min, max, mean and exact linear quantiles per group.  The values
    are written once; ordering and counting read them from there."""
    group = list(group)
    df = cut_lineage(df.select(*group, value))
    mn, mx = F.min(value), F.max(value)
    if with_minmax_round:
        mn, mx = F.round(mn, R), F.round(mx, R)
    basic = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias(count_name), mn.alias(f"min_{prefix}"),
        mx.alias(f"max_{prefix}"), F.round(F.avg(value), R).alias(f"mean_{prefix}"))
    q = exact_quantiles(df, value, probs, group)
    q = q.select(*group, *[F.round(k, R).alias(k) for k in probs])
    if group:
        return basic.join(q, group)
    return basic.join(F.broadcast(q), F.lit(True), "left")  # a row each


def target_source_overlap(pairs: DataFrame, keys: Sequence[str], source: str = "source",
                          target: str = "target", rounded: bool = True) -> DataFrame:
    """size(set(target words) & set(source words)) / size(set(target words))."""
    ratio = distinct_overlap_ratio(tx.lower_ws_tokens(target), tx.lower_ws_tokens(source))
    return pairs.select(*keys, (F.round(ratio, R) if rounded else ratio).alias("overlap"))


def new_word_frequency(pairs: DataFrame, source: str = "source",
                       target: str = "target") -> DataFrame:
    """Document frequency of target words missing from the source."""
    new = F.array_except(F.array_distinct(tx.lower_ws_tokens(target)), tx.lower_ws_tokens(source))
    return (pairs.select(F.explode(new).alias("word"))
                 .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def top_k(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """Top-k by score descending, ties by ``tie`` ascending (TakeOrdered)."""
    return df.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(k)
