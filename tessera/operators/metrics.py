"""Corpus-level scoring: mean ROUGE, Poisson-bootstrap ROUGE intervals,
corpus BLEU (B4, B5, B9, A12)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions import bleu as bl
from tessera.functions import rouge as rg
from tessera.operators.splits import seeded_hash


def raw_rouge(pairs: DataFrame, pred: str = "pred", ref: str = "ref", carried: Sequence[str] = (),
              keys: Sequence[str] = ("rouge1", "rouge2", "rougeL"), stem: bool = True) -> DataFrame:
    """The scores of every row: (p, r, f) structs named by metric."""
    return rg.scored(pairs, pred, ref, keys, stem, carried)


def corpus_rouge(pairs: DataFrame, pred: str = "pred", ref: str = "ref",
                 keys: Sequence[str] = ("rouge1", "rouge2", "rougeL"), stem: bool = True,
                 triple: bool = False) -> DataFrame:
    """Deterministic aggregation: mean F1 x 100 rounded to 4, long form; with
    ``triple`` the means of precision and recall beside it."""
    parts = (("p", "precision"), ("r", "recall"), ("f", "value")) if triple else (("f", "value"),)
    means = rg.scored(pairs, pred, ref, keys, stem, ()).agg(*[
        F.struct(F.lit(k).alias("metric"), *[F.round(F.avg(F.col(k)[x]) * 100.0, 4).alias(n) for x, n in parts]).alias(k) for k in keys])
    return means.select(F.inline(F.array(*keys)))


#: Hashes are mixed for each replicate modulo this prime.
PRIME = 2**31 - 1


def _poisson_bounds(n: int = 12) -> tuple[float, ...]:
    """The first ``n`` values of the distribution function of Poisson(1)."""
    out, total, term = [], 0.0, math.exp(-1.0)
    for k in range(1, n + 1):
        total += term
        out.append(total)
        term /= k
    return tuple(out)


POISSON = _poisson_bounds()


def bootstrap_rouge(pairs: DataFrame, key: str, pred: str = "pred", ref: str = "ref",
                    keys: Sequence[str] = ("rouge1", "rouge2", "rougeL"), replicates: int = 1000,
                    seed: int = 42, stem: bool = True) -> DataFrame:
    """Poisson bootstrap: each row has a Poisson(1) weight in each replicate,
    from one hash of its key and a seeded mix per replicate.  A task sums its
    rows for all replicates at once and passes on one row each; low, mid and
    high are the 2.5, 50 and 97.5 percentiles of the replicates' means."""
    def mixed(tag: str, i: int) -> int:
        return int(hashlib.md5(f"{seed}:{tag}{i}".encode()).hexdigest()[:15], 16)

    a = np.array([1 + mixed("a", i) % (PRIME - 1) for i in range(1, replicates + 1)], np.int64)
    c = np.array([mixed("c", i) % PRIME for i in range(1, replicates + 1)], np.int64)
    names = list(keys)

    def sums(batches):
        total = np.zeros((replicates, len(names) + 1))
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at:at + 2048]
                u = (part["_h"].to_numpy(np.int64)[:, None] * a + c) % PRIME / PRIME
                w = np.searchsorted(POISSON, u, side="right").astype(np.float64)
                total[:, 0] += w.sum(axis=0)
                total[:, 1:] += w.T @ part[names].to_numpy(np.float64)
        yield pd.DataFrame({"b": np.arange(replicates), "w": total[:, 0], **{k: total[:, i + 1] for i, k in enumerate(names)}})

    scored = rg.scored(pairs, pred, ref, keys, stem, (key,)).select(
        (seeded_hash(key, seed) % F.lit(PRIME)).alias("_h"), *[F.col(k)["f"].alias(k) for k in keys])
    parts = scored.mapInPandas(sums, "b long, w double, " + ", ".join(f"{k} double" for k in keys))
    means = parts.groupBy("b").agg(*[(F.sum(k) / F.sum("w")).alias(k) for k in keys])
    agg = means.agg(*[F.percentile(F.col(k), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias(k) for k in keys])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("metric"),
                 F.round(F.col(k)[0] * 100, 4).alias("low"),
                 F.round(F.col(k)[1] * 100, 4).alias("mid"),
                 F.round(F.col(k)[2] * 100, 4).alias("high")) for k in keys])))


def corpus_bleu(pairs: DataFrame, pred: str = "pred", ref: str = "ref", smooth: str = "exp",
                tokenizer: str = "13a", normalize: bool = False) -> DataFrame:
    """Sum clipped matches / totals / lengths over rows, then the closed form;
    with ``normalize`` both sides are normalised first."""
    from tessera.functions import text as tx
    if normalize:
        pairs = pairs.select(tx.normalize_text(pred).alias(pred), tx.normalize_text(ref).alias(ref))
    stats = pairs.select(F.inline(F.array(bl.bleu_stats(pred, ref, tokenizer))))
    sums = stats.agg(*[F.sum(c).cast("long").alias(c) for c in stats.columns])
    return sums.select("*", *bl.corpus_bleu_from_sums(smooth))


def mean_length(df: DataFrame, tokens_col: str, pad: str | None = None, digits: int = 1) -> DataFrame:
    """Mean non-pad token count, rounded to one digit (generation length)."""
    size = F.size(F.filter(F.col(tokens_col), lambda t: t != F.lit(pad))) if pad is not None \
        else F.size(F.col(tokens_col))
    return df.agg(F.round(F.avg(size), digits).alias("gen_len"))


def corpus_score(pairs: DataFrame, metric: str, pred: str = "pred", ref: str = "ref", **options) -> DataFrame:
    """Scoring by name: ``rouge`` (all of them), ``bleu``, or one ROUGE metric."""
    if metric == "bleu":
        return corpus_bleu(pairs, pred, ref, **options)
    if metric == "rouge":
        return corpus_rouge(pairs, pred, ref, **options)
    return corpus_rouge(pairs, pred, ref, (metric,), **options)


def observed(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of aggregates over its rows, filled by the
    action that writes what is made of ``df``: no scan of its own."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in aggregates.items()]), seen


def run_result(scores: DataFrame, n_rows: int, seconds: float) -> DataFrame:
    """Long-form scores with the run's rows, seconds and seconds per row."""
    extra = scores.sparkSession.createDataFrame(
        [("n_obs", float(n_rows)), ("runtime", round(seconds, 4)), ("seconds_per_sample", round(seconds / max(n_rows, 1), 4))],
        "metric string, value double")
    return scores.select("metric", F.col("value").cast("double").alias("value")).unionByName(extra)
