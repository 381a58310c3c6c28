"""Order-dependent primitives that never funnel a whole relation (or a whole
group) through one task.

``global_index``: range-partition on the order key, sort inside partitions,
write that layout once to the checkpoint folder, take each row's position
inside its partition from ``monotonically_increasing_id`` and add the row
count of all earlier partitions.  The only collected-side table is one row per partition, so the
broadcast is bounded by the partition count, not the data.

``rank_within``: the same index over (group, order) minus the index of the
group's first row.  A hot group is spread over many range partitions instead
of landing in one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage, default_partitions

_PID, _MID, _CNT, _OFF = "_tsr_pid", "_tsr_mid", "_tsr_cnt", "_tsr_off"


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _numbered_layout(df: DataFrame, order_cols: list[Column], num_partitions: int | None) -> DataFrame:
    """One range-partitioned, sorted layout of ``df``, written once.

    Every later reader (counts, offsets, positions) uses these files, so all
    of them see the same range boundaries.  Deriving two branches from an
    unwritten range exchange is wrong: column pruning makes the exchanges
    different plans and each one samples boundaries of its own.
    """
    n_parts = num_partitions or default_partitions(df.sparkSession)
    return cut_lineage(df.repartitionByRange(n_parts, *order_cols)
                         .sortWithinPartitions(*order_cols)
                         .withColumn(_PID, F.spark_partition_id())
                         .withColumn(_MID, F.monotonically_increasing_id()))


def global_index(df: DataFrame, order: Sequence, name: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based LONG ``name`` = position of the row in ``order``.

    ``order`` should end in a unique column so positions are reproducible.
    All columns of ``df`` are written once to the checkpoint folder: pass a
    narrow table (key and order columns) and join wide payload back.
    """
    staged = _numbered_layout(df, _cols(order), num_partitions)
    counts = staged.groupBy(_PID).agg(F.count(F.lit(1)).alias(_CNT))
    offsets = counts.select(
        _PID,
        F.coalesce(F.sum(_CNT).over(
            Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias(_OFF))
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return (staged.join(F.broadcast(offsets), _PID)
                  .withColumn(name, (F.col(_OFF) + local).cast("long"))
                  .drop(_PID, _MID, _OFF))


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence,
                name: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside its group, ordered by ``order``."""
    group = list(group)
    if not group:
        return global_index(df, order, name, num_partitions)
    tmp = "_tsr_gidx"
    indexed = global_index(df, [*group, *_cols(order)], tmp, num_partitions)
    first = indexed.groupBy(*group).agg(F.min(tmp).alias("_tsr_first"))
    return (indexed.join(first, group)
                   .withColumn(name, F.col(tmp) - F.col("_tsr_first"))
                   .drop(tmp, "_tsr_first"))


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float],
                    group: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles (numpy default / ``quantile_cont``).

    Rows are ranked by value, only the two neighbours of each requested
    position survive the filter, so the final aggregate touches a handful of
    rows per group.  Result: group columns + one DOUBLE column per name.
    """
    group = list(group)
    base = df.select(*group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    ranked = rank_within(base, group, ["_v"], "_r")
    if group:
        sizes = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        joined = ranked.join(sizes, group)
    else:
        joined = ranked.crossJoin(F.broadcast(ranked.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    pos = {k: F.lit(p) * (F.col("_n") - 1) for k, p in probs.items()}
    keep = None
    for k, h in pos.items():
        cond = (F.col("_r") == F.floor(h)) | (F.col("_r") == F.ceil(h))
        keep = cond if keep is None else keep | cond
    picked = joined.where(keep)
    aggs = []
    for k, h in pos.items():
        lo = F.max(F.when(F.col("_r") == F.floor(h), F.col("_v")))
        hi = F.max(F.when(F.col("_r") == F.ceil(h), F.col("_v")))
        frac = F.first(h - F.floor(h))
        aggs.append((lo + (hi - lo) * frac).alias(k))
    return picked.groupBy(*group).agg(*aggs)


def running_sums(df: DataFrame, order: Sequence, sums: Sequence[str],
                 suffix: str = "_cum", num_partitions: int | None = None) -> DataFrame:
    """Inclusive prefix sums of ``sums`` in ``order``.

    Range-partition + sort, a vectorised cumulative sum inside each partition
    (Arrow batches, carried across batches), then the totals of earlier
    partitions (one row per partition, broadcast) are added."""
    from pyspark import TaskContext
    from pyspark.sql import types as T

    order_cols = _cols(order)
    n_parts = num_partitions or default_partitions(df.sparkSession)
    staged = df.repartitionByRange(n_parts, *order_cols).sortWithinPartitions(*order_cols)
    fields = list(staged.schema.fields) + [T.StructField(_PID, T.LongType())] + [
        T.StructField(c + suffix, T.DoubleType()) for c in sums]
    schema = T.StructType(fields)
    cols = list(sums)

    def local(batches):
        pid = TaskContext.get().partitionId()
        carry = {c: 0.0 for c in cols}
        for pdf in batches:
            pdf[_PID] = pid
            for c in cols:
                cum = pdf[c].astype("float64").cumsum() + carry[c]
                if len(cum):
                    carry[c] = float(cum.iloc[-1])
                pdf[c + suffix] = cum
            yield pdf

    # written once: the totals and the rows must come from the same layout
    loc = cut_lineage(staged.mapInPandas(local, schema))
    totals = loc.groupBy(_PID).agg(*[F.sum(c).cast("double").alias(f"_t_{c}") for c in cols])
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PID, *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0.0)).alias(f"_o_{c}")
                                    for c in cols])
    out = loc.join(F.broadcast(offsets), _PID)
    for c in cols:
        out = out.withColumn(c + suffix, F.col(c + suffix) + F.col(f"_o_{c}"))
    return out.drop(_PID, *[f"_o_{c}" for c in cols])
