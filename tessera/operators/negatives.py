"""Seeded negative sampling without replacement and labelled example
construction (J6 T7 F7 C4 B8).

Each row draws k distinct pool positions (a + j*step) mod N with a and step
from seeded hashes (1 <= step <= N div k keeps the k positions distinct),
then one equi-join on position fetches the negatives.  No cross join, no
collect: the pool is indexed with the range-partitioned global index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import global_index
from tessera.operators.splits import seeded_hash
from tessera.session import cut_lineage


def sample_negatives(examples: DataFrame, key: str, target: str, k: int,
                     seed: int = 42, part: str | None = None) -> DataFrame:
    """(key, j, neg_key, neg_target) — negatives equal to the row's own
    target text are dropped (text comparison, as in the reference).

    Only keys are indexed; the drawn rows' texts come by a join on the key.
    With ``part``, a column with few values, rows draw from their own part:
    one index, in which each part's positions follow those of the part before.
    """
    name = F.lit("") if part is None else F.col(part).cast("string")
    texts = examples.select(F.col(key).alias("neg_key"), F.col(target).alias("neg_target"))
    keys = examples.select(name.alias("_part"), F.col(key).alias("neg_key"))
    pool = cut_lineage(global_index(keys, ["_part", "neg_key"], "pos"))
    sizes = {r["_part"]: (r["n"], r["first"]) for r in pool.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).collect()}
    for own, (n, _) in (sizes or {"": (0, 0)}).items():
        if k > n:
            raise ValueError(f"cannot draw {k} negatives from a pool of {n}" + (f" ({own})" if own else ""))
    n = first = F.lit(None).cast("long")
    for own, (size, at) in sizes.items():  # few parts
        here = F.col("_part") == own
        n, first = F.when(here, F.lit(size)).otherwise(n), F.when(here, F.lit(at)).otherwise(first)
    drawn = pool.select(F.col("neg_key").alias(key), n.alias("_n"), first.alias("_first"))
    step = F.lit(1) + seeded_hash(key, seed + 1) % F.floor(F.col("_n") / k)
    drawn = drawn.select(key, "_n", "_first", (seeded_hash(key, seed) % F.col("_n")).alias("_a"), step.alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    drawn = drawn.select(key, "j", (F.col("_first") + (F.col("_a") + F.col("j") * F.col("_s")) % F.col("_n")).cast("long").alias("pos"))
    drawn = drawn.join(pool.drop("_part"), "pos").join(texts, "neg_key").join(examples.select(key, F.col(target).alias("_own")), key)
    return drawn.where(F.col("neg_target") != F.col("_own")).select(key, F.col("j").cast("long").alias("j"), "neg_key", "neg_target")


def labelled_examples(examples: DataFrame, key: str, source: str, target: str, k: int,
                      seed: int = 42, score_fn=None, part: str | None = None) -> DataFrame:
    """Positives (label 1.0) plus k sampled negatives per row (label 0.0 or
    ``score_fn(neg_target, target)`` normalised by the target's self-score);
    with ``part``, drawn inside the parts, which the rows keep."""
    own = [] if part is None else [part]
    pos = examples.select(F.col(key).alias("guid"), F.col(key).alias("cand_key"),
                          F.col(source).alias("source"), F.col(target).alias("candidate"),
                          F.lit(1.0).alias("label"), *own)
    negs = sample_negatives(examples.select(key, target, source, *own), key, target, k, seed, part)
    negs = negs.join(examples.select(key, source, target, *own), key)
    if score_fn is None:
        lab = F.lit(0.0)
    else:
        lab = F.coalesce(F.try_divide(score_fn(F.col("neg_target"), F.col(target)),
                                      score_fn(F.col(target), F.col(target))), F.lit(0.0))
    negs = negs.select(F.col(key).alias("guid"), F.col("neg_key").alias("cand_key"),
                       F.col(source).alias("source"), F.col("neg_target").alias("candidate"),
                       lab.alias("label"), *own)
    return pos.unionByName(negs)


def split_examples(parts: dict[str, DataFrame], key: str, source: str, target: str, k: int, seed: int = 42, score_fn=None) -> DataFrame:
    """``labelled_examples`` of named parts, negatives drawn inside each (no
    gold text of one part becomes an example of another); keys are unique over
    all parts."""
    rows = None
    for name, part in parts.items():
        own = part.select(key, source, target).withColumn("part", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return labelled_examples(rows, key, source, target, k, seed, score_fn, "part")
