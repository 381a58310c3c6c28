"""Exact bootstrap: resampling n rows with replacement.

In a replicate n draws fall on n rows.  Rows have positions; a tree halves the
range of positions, and at each node a binomial variate, conditional on the
draws of the node, tells how many of them fall on its left half.  The leaves
are blocks of ``BLOCK`` rows, in which draws are spread uniformly.  Every node's
random numbers come from a generator seeded by the node alone, so a task that
holds some rows walks down to their blocks and needs nothing else: the counts
are the same for any split of the rows, and sum to n in every replicate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rouge as rg
from tessera.operators.ordering import global_index
from tessera.session import cut_lineage

BLOCK = 1024


class Draws:
    """How often each position is drawn in each of ``replicates`` replicates."""

    def __init__(self, n: int, replicates: int, seed: int):
        self.n, self.replicates, self.seed = n, replicates, seed
        self.blocks = -(-n // BLOCK)
        self._known: dict[tuple[int, int], np.ndarray] = {(0, self.blocks): np.full(replicates, n, np.int64)}

    def _rows(self, lo: int, hi: int) -> int:
        return min(hi * BLOCK, self.n) - lo * BLOCK

    def _generator(self, *node: int) -> np.random.Generator:
        return np.random.Generator(np.random.PCG64(np.random.SeedSequence([self.seed, *node])))

    def of_block(self, block: int) -> np.ndarray:
        """Draws that fall on a block, in each replicate."""
        lo, hi, drawn = 0, self.blocks, self._known[0, self.blocks]
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if (lo, mid) not in self._known:
                if len(self._known) > 4096:  # the paths of neighbours are what is used again
                    self._known = {(0, self.blocks): self._known[0, self.blocks]}
                left = self._generator(lo, hi).binomial(drawn, self._rows(lo, mid) / self._rows(lo, hi))
                self._known[lo, mid], self._known[mid, hi] = left, drawn - left
            lo, hi = (lo, mid) if block < mid else (mid, hi)
            drawn = self._known[lo, hi]
        return drawn

    def weights(self, block: int) -> np.ndarray:
        """Replicates x rows of a block: how often each row is drawn."""
        size, drawn = self._rows(block, block + 1), self.of_block(block)
        at = self._generator(block, block + 1, 1).integers(0, size, int(drawn.sum()))
        row = np.repeat(np.arange(self.replicates), drawn)
        return np.bincount(row * size + at, minlength=self.replicates * size).reshape(self.replicates, size)


def bootstrap_means(rows: DataFrame, order: Sequence[str], values: Sequence[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(b, value...): the mean of each value in each replicate.  ``order``
    gives the rows their positions and should be unique; null values count as
    0.  A task passes on one row of sums for each replicate."""
    names = list(values)
    # written first: positions read their rows twice, and values may be dear
    known = cut_lineage(rows.select(*order, *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in names]))
    placed = cut_lineage(global_index(known, order, "_at"))
    n = placed.count()

    def sums(batches):
        draws, total = Draws(n, replicates, seed), np.zeros((replicates, len(names)))
        for pdf in batches:
            at, x = pdf["_at"].to_numpy(), pdf[names].to_numpy(np.float64)
            for block in np.unique(at // BLOCK):
                own = at // BLOCK == block
                total += draws.weights(int(block))[:, at[own] % BLOCK] @ x[own]
        yield pd.DataFrame({"b": np.arange(replicates), **{v: total[:, i] for i, v in enumerate(names)}})

    parts = placed.select("_at", *names).mapInPandas(sums, "b long, " + ", ".join(f"{v} double" for v in names))
    return parts.groupBy("b").agg(*[(F.sum(v) / F.lit(max(n, 1))).alias(v) for v in names])


def intervals(means: DataFrame, values: Sequence[str], scale: float = 100.0, digits: int = 4) -> DataFrame:
    """(metric, low, mid, high): the 2.5, 50 and 97.5 percentiles over the
    replicates."""
    agg = means.agg(*[F.percentile(F.col(v), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias(v) for v in values])

    def of(c: Column, i: int) -> Column:
        return F.round(c[i] * scale, digits)

    return agg.select(F.inline(F.array(*[F.struct(F.lit(v).alias("metric"), of(F.col(v), 0).alias("low"), of(F.col(v), 1).alias("mid"),
                                                  of(F.col(v), 2).alias("high")) for v in values])))


def bootstrap_rouge(pairs: DataFrame, order: Sequence[str], pred: str = "pred", ref: str = "ref", keys: Sequence[str] = ("rouge1", "rouge2", "rougeL"),
                    replicates: int = 1000, seed: int = 42, stem: bool = True) -> DataFrame:
    """(metric, low, mid, high) of the F scores x 100, by resampling rows."""
    scored = rg.scored(pairs, pred, ref, keys, stem, tuple(order)).select(*order, *[F.col(k)["f"].alias(k) for k in keys])
    return intervals(bootstrap_means(scored, list(order), keys, replicates, seed), keys)
