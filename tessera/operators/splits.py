"""Seeded stratified folds and splits, hold-out views, shuffles, minify
(W5, W6, X4, T6, T2, J9/C3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import global_index, rank_within


def seeded_hash(key, seed: int) -> Column:
    """60-bit integer from md5(seed:key): uniform, reproducible, and spelled
    identically in SQL engines that have md5."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))
    return F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("long")


def _stratum_offsets(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows in all earlier strata (strata sorted by key) — one row per stratum."""
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_sn"))
    w = Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*strata, "_sn", F.coalesce(F.sum("_sn").over(w), F.lit(0)).alias("_soff"))


def stratified_folds(df: DataFrame, id_col: str, strata: Sequence[str], k: int = 10,
                     seed: int = 42, name: str = "fold") -> DataFrame:
    """Balanced stratified k-fold: rank inside each stratum by md5(seed:id),
    then deal folds round-robin continuing from the previous stratum, so
    every stratum and every fold differ in size by at most one."""
    strata = list(strata)
    hashed = df.withColumn("_h", seeded_hash(id_col, seed))
    ranked = rank_within(hashed, strata, ["_h", id_col], "_rn")
    offsets = _stratum_offsets(df, strata)
    return (ranked.join(offsets, strata)
                  .withColumn(name, ((F.col("_soff") + F.col("_rn")) % k).cast("long"))
                  .drop("_h", "_rn", "_sn", "_soff"))


def stratified_split(df: DataFrame, id_col: str, strata: Sequence[str], frac: float = 0.5,
                     seed: int = 42, name: str = "split", first: str = "train",
                     second: str = "val") -> DataFrame:
    """Seeded stratified two-way split; round(frac * stratum size) rows go first."""
    strata = list(strata)
    hashed = df.withColumn("_h", seeded_hash(id_col, seed))
    ranked = rank_within(hashed, strata, ["_h", id_col], "_rn")
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_sn"))
    cut = F.round(F.lit(frac) * F.col("_sn"))
    return (ranked.join(sizes, strata)
                  .withColumn(name, F.when(F.col("_rn") < cut, F.lit(first)).otherwise(F.lit(second)))
                  .drop("_h", "_rn", "_sn"))


def holdout_split(fold: str = "fold", k: int = 10, test_fold: int = 9) -> Column:
    """Fold ``test_fold`` (mod k) is the held-out test part, the rest train."""
    return F.when(F.col(fold) % k == test_fold, F.lit("test")).otherwise(F.lit("train"))


def fold_view(df: DataFrame, k: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Train = every other fold, test = fold k; no copies materialised."""
    return df.where(F.col(fold) != k), df.where(F.col(fold) == k)


def fold_train_sizes(folded: DataFrame, extension: DataFrame | None, k: int,
                     fold: str = "fold") -> DataFrame:
    """Per fold: base train rows, shared extension rows, and their sum.

    Extension rows belong to every fold's train part (kept once, counted per
    fold) — fold copies are never materialised."""
    per_fold = folded.groupBy(fold).agg(F.count(F.lit(1)).alias("_nf"))
    total = folded.count()
    n_ext = extension.count() if extension is not None else 0
    return per_fold.select(
        F.col(fold).cast("long").alias(fold),
        (F.lit(total) - F.col("_nf")).cast("long").alias("n_base_train"),
        F.lit(n_ext).cast("long").alias("n_extension"),
        (F.lit(total) - F.col("_nf") + F.lit(n_ext)).cast("long").alias("n_train"))


def extended_fold(folded: DataFrame, extension: DataFrame, k: int, id_col: str, seed: int = 42,
                  fold: str = "fold") -> DataFrame:
    """(part, pos, id, extension) of fold ``k``: the train rows of all other
    folds and the extension rows in one seeded shuffle, the rows of fold ``k``
    as val and as test in order of their ids."""
    base = folded.select(F.col(id_col).alias("id"), F.col(fold).alias("_f"), F.lit(False).alias("extension"))
    more = extension.select(F.col(id_col).alias("id"), F.lit(True).alias("extension"))
    train = base.where(F.col("_f") != k).drop("_f").unionByName(more)
    train = train.withColumn("_h", seeded_hash(F.concat_ws("-", F.col("extension").cast("int"), "id"), seed))
    train = global_index(train, ["_h", "extension", "id"], "pos").select(F.lit("train").alias("part"), "pos", "id", "extension")
    held = global_index(base.where(F.col("_f") == k).drop("_f"), ["id"], "pos")
    return train.unionByName(held.select(F.explode(F.array(F.lit("val"), F.lit("test"))).alias("part"), "pos", "id", "extension"))


def shuffle_positions(df: DataFrame, id_col: str, seed: int = 42,
                      name: str = "shuffle_pos") -> DataFrame:
    """Seeded shuffle as an explicit position column (md5 order, id tie-break)."""
    return global_index(df.withColumn("_h", seeded_hash(id_col, seed)), ["_h", id_col], name).drop("_h")


def first_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int,
                      name: str = "pos") -> DataFrame:
    """Keep the first n rows of each group in ``order``; n <= 0 keeps all."""
    ranked = rank_within(df, group, order, name)
    return ranked if n is None or n <= 0 else ranked.where(F.col(name) < n)
