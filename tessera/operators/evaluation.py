"""Scorer evaluation and run roll-ups: lexical pair scorer, rerank, picked-
the-best counts, MSE, threshold metrics, fold aggregation, parameter grids
and leaderboards (U3 C9 C10 A4 A7 A8 A9 A17 C11 J8 T5 P20)."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.candidates import pick_best
from tessera.operators.ordering import running_sums

R = 6


def lexical_share(source_words: Column, candidate) -> Column:
    """Share of the source's distinct words (lower-cased whitespace tokens)
    that the candidate covers, rounded to 6; 0 without words."""
    c = F.array_distinct(tx.lower_ws_tokens(candidate))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(c, source_words)).cast("double"),
                                           F.size(source_words).cast("double")), F.lit(0.0)), R)


def lexical_score(source, candidate) -> Column:
    """Default pair scorer: ``lexical_share`` of a source text."""
    return lexical_share(F.array_distinct(tx.lower_ws_tokens(source)), candidate)


def rerank(examples: DataFrame, key: str = "sample_id", score: str = "score",
           rank: str = "cand_rank", payload: Sequence[str] = ("text",)) -> DataFrame:
    return pick_best(examples, key, score, rank, payload)


def evaluate_scorer(examples: DataFrame, key: str = "sample_id", score: str = "score",
                    label: str = "label", rank: str = "cand_rank", chosen: dict[str, str] | None = None) -> DataFrame:
    """n ids, ids where the top-scored candidate has the best label (> 0),
    the MSE of scores against labels over all candidates, and the mean over
    the chosen candidates of the columns named in ``chosen`` (e.g. ROUGE)."""
    more = dict(chosen or {})
    picked = pick_best(examples, key, score, rank, payload=[label, *more]).select(
        key, F.col(label).alias("_chosen"), *[F.col(c).alias(f"_{c}") for c in more])
    best = examples.groupBy(key).agg(F.max(label).alias("_best"),
                                     F.sum(F.pow(F.col(score) - F.col(label), 2)).alias("_se"),
                                     F.count(F.lit(1)).alias("_n"))
    j = best.join(picked, key, "left")
    return j.agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.count_if((F.col("_chosen") == F.col("_best")) & (F.col("_best") > 0)).alias("num_best_target"),
        F.round(F.sum("_se") / F.sum("_n"), R).alias("mse"),
        *[F.round(F.avg(f"_{c}"), 4).alias(name) for c, name in more.items()])


def threshold_metrics(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Binary metrics of ``score >= t`` over all distinct thresholds t:
    best accuracy, best F1 (with its precision/recall; highest t wins ties)
    and average precision.  Prefix sums are range-partitioned, never a
    single-task window."""
    dist = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"),
                                 F.count_if(F.col(label) != 1).alias("neg"))
    tot = df.agg(F.count_if(F.col(label) == 1).alias("P"), F.count(F.lit(1)).alias("T")).first()
    n_pos, n_all = int(tot["P"] or 0), int(tot["T"] or 0)
    n_neg = n_all - n_pos
    cum = running_sums(dist, [F.col(score).desc()], ["pos", "neg"])
    tp, fp = F.col("pos_cum"), F.col("neg_cum")
    prec = tp / (tp + fp)
    rec = tp / F.lit(float(max(n_pos, 1)))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    acc = (tp + F.lit(float(n_neg)) - fp) / F.lit(float(max(n_all, 1)))
    per = cum.select(F.col(score).alias("t"), "pos", prec.alias("p"), rec.alias("r"),
                     f1.alias("f1"), acc.alias("acc"))
    best_f1 = F.max_by(F.struct("f1", "p", "r", "t"), F.struct("f1", "t"))
    best_acc = F.max_by(F.struct("acc", "t"), F.struct("acc", "t"))
    ap = F.sum(F.col("pos") / F.lit(float(max(n_pos, 1))) * F.col("p"))
    out = per.agg(best_f1.alias("bf"), best_acc.alias("ba"), ap.alias("ap"))
    all_neg_acc = n_neg / max(n_all, 1)
    return out.select(
        F.round(F.greatest(F.col("ba.acc"), F.lit(all_neg_acc)), R).alias("accuracy"),
        F.round(F.col("bf.f1"), R).alias("f1"), F.round(F.col("bf.p"), R).alias("precision"),
        F.round(F.col("bf.r"), R).alias("recall"), F.round(F.col("bf.t"), R).alias("f1_threshold"),
        F.round(F.col("ap"), R).alias("average_precision"))


def aggregate_runs(long_df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Per metric over runs/folds: mean, population std, min, max, n."""
    return long_df.groupBy(metric).agg(
        F.round(F.avg(value), R).alias("mean"), F.round(F.stddev_pop(value), R).alias("std"),
        F.round(F.min(value), R).alias("min"), F.round(F.max(value), R).alias("max"),
        F.count(F.lit(1)).alias("n"))


def parse_grid(grid: str) -> list[dict[str, str]]:
    """``"a=1:2 b=3:4"`` -> the cartesian product as dicts (a driver-side
    parameter, never data)."""
    names, values = [], []
    for part in grid.split():
        k, vs = part.split("=", 1)
        names.append(k)
        values.append(vs.split(":"))
    return [dict(zip(names, combo)) for combo in itertools.product(*values)]


def grid_frame(spark: SparkSession, grid: str) -> DataFrame:
    """The grid as a DataFrame, built by explode (one generated row, no join)."""
    parts = [p.split("=", 1) for p in grid.split()]
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in parts])
    for k, _ in parts:
        df = df.withColumn(k, F.explode(F.split(F.col(k), ":")))
    return df.select(*[typed_value(F.col(k)).alias(k) for k, _ in parts])


def typed_value(c: Column) -> Column:
    """true/false -> 1/0, else integer, else float (as DOUBLE)."""
    low = F.lower(c)
    return (F.when(low == "true", F.lit(1.0)).when(low == "false", F.lit(0.0))
             .otherwise(F.coalesce(c.try_cast("long").cast("double"), c.try_cast("double"))))


def leaderboard(results: DataFrame, metrics: Sequence[str], params: Sequence[str]) -> DataFrame:
    """Rank runs by the metric tuple (descending), params ascending on ties.
    Input rows are one per parameter combination (bounded by the grid)."""
    order = [F.col(m).desc() for m in metrics] + [F.col(p).asc() for p in params]
    return results.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
