"""ROUGE-N / ROUGE-L / ROUGE-Lsum per pair as column expressions.

Tokens follow the ROUGE convention (lower-case ``[a-z0-9]`` runs, optional
Porter stemming of tokens longer than three characters).  Texts are taken
apart and counted by one Arrow UDF for all metrics, a reference once for the
rows in succession that have it; ROUGE-N of token arrays is native (sorted
run-length overlap), the LCS variants of token arrays call the Arrow UDFs in
``tessera.functions.lcs``.  Every score is a struct ``(p, r, f)`` in [0, 1].
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.arrays import let, multiset_overlap, ngrams
from tessera.functions.lcs import lcs_of_masks, lcs_masks, lcs_udf, summary_lcs_hits, summary_lcs_udf
from tessera.functions.stem import stem_token

NAMES = ("rouge1", "rouge2", "rouge3", "rouge4", "rougeL", "rougeLsum")


def gram_counts(tokens: list, n: int) -> Counter:
    return Counter(tokens if n == 1 else zip(*(tokens[i:] for i in range(n))))


def shared(a: Counter, b: Counter) -> int:
    """``sum_x min(a[x], b[x])``"""
    return sum(min(a[x], b[x]) for x in a.keys() & b.keys())


class _Text:
    """What is counted of a lower-cased text (null: of an empty one), once."""

    def __init__(self, text: str | None, stem: bool):
        self.text, self._stem, self._grams = text, stem, {}

    def _tokens(self, text: str) -> list[str]:
        found = re.findall("[a-z0-9]+", text)
        return [stem_token(t) for t in found] if self._stem else found

    @cached_property
    def tokens(self) -> list[str]:
        return self._tokens(self.text or "")

    @cached_property
    def sentences(self) -> list[list[str]]:
        """Tokens of each sentence (``tx.sentences``) that has some."""
        return [t for s in tx.python_sentences(self.text or "") if (t := self._tokens(s))]

    @cached_property
    def masks(self) -> dict:
        return lcs_masks(self.tokens)

    def grams(self, n: int) -> Counter:
        if n not in self._grams:
            self._grams[n] = gram_counts(self.tokens, n)
        return self._grams[n]

    def counted(self, ref: _Text, metric: str) -> tuple[int, int, int]:
        """Matches with a reference, items of this text, items of the reference."""
        if metric == "rougeLsum":
            return (summary_lcs_hits(ref.sentences, self.sentences), sum(map(len, self.sentences)), sum(map(len, ref.sentences)))
        if metric == "rougeL":
            return lcs_of_masks(ref.masks, len(ref.tokens), self.tokens), len(self.tokens), len(ref.tokens)
        n = int(metric[-1])
        return (shared(self.grams(n), ref.grams(n)), *(max(0, len(x.tokens) - n + 1) for x in (self, ref)))


def match_counts(pred, ref, metrics: Sequence[str], stem: bool = False) -> Column:
    """struct(m_k, p_k, r_k for each metric k): matches, items of the
    prediction and of the reference."""
    for m in metrics:
        if m not in NAMES:
            raise ValueError(f"unknown metric {m}")
    names = [f"{c}_{m}" for m in metrics for c in "mpr"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def run(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
        out, last = np.zeros((len(pred), len(names)), np.int64), _Text(None, stem)
        for i, (p, r) in enumerate(zip(pred, ref)):
            if r != last.text:
                last = _Text(r, stem)
            own = _Text(p, stem)
            out[i] = [x for m in metrics for x in own.counted(last, m)]
        return pd.DataFrame(out, columns=names)

    return run(F.lower(pred), F.lower(ref))


def prf(matches: Column, n_pred: Column, n_ref: Column) -> Column:
    """precision, recall, F1 as in the ROUGE reference scorer (inputs bound
    once, so an expensive ``matches`` expression is evaluated once)."""
    def from_pr(pr):
        p, r = pr["p"], pr["r"]
        f = F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))
        return F.struct(p.alias("p"), r.alias("r"), f.alias("f"))

    def from_counts(s):
        m, n_p, n_r = s["m"], s["np"], s["nr"]
        return let(F.struct(
            F.when(n_p > 0, m / n_p).otherwise(F.lit(0.0)).alias("p"),
            F.when(n_r > 0, m / n_r).otherwise(F.lit(0.0)).alias("r")), from_pr)
    return let(F.struct(matches.cast("double").alias("m"), n_pred.cast("double").alias("np"),
                        n_ref.cast("double").alias("nr")), from_counts)


def rouge_n(pred_tokens: Column, ref_tokens: Column, n: int) -> Column:
    return let(ngrams(pred_tokens, n), lambda a: let(ngrams(ref_tokens, n), lambda b: prf(
        multiset_overlap(a, b), F.size(a), F.size(b))))


def rouge_l(pred_tokens: Column, ref_tokens: Column) -> Column:
    return prf(lcs_udf(pred_tokens, ref_tokens), F.size(pred_tokens), F.size(ref_tokens))


def rouge_lsum(pred_text, ref_text) -> Column:
    """Summary-level LCS over sentences (one sentence per line)."""
    c = match_counts(pred_text, ref_text, ("rougeLsum",))
    return prf(c["m_rougeLsum"], c["p_rougeLsum"], c["r_rougeLsum"])


def rouge_lsum_tokens(pred: Column, ref: Column) -> Column:
    def total(sentences: Column) -> Column:
        return F.aggregate(sentences, F.lit(0), lambda acc, s: acc + F.size(s))

    return prf(summary_lcs_udf(ref, pred), total(pred), total(ref))


def scored(df: DataFrame, pred: str, ref: str, metrics: Sequence[str], stem: bool = False, carried: Sequence[str] = ("*",)) -> DataFrame:
    """``df``'s ``carried`` columns and a (p, r, f) struct for each metric
    (rouge1..rouge4, rougeL, rougeLsum).  What is counted leaves through a
    generator, so that it is counted once."""
    rows = df.select("*", F.inline(F.array(match_counts(pred, ref, metrics, stem))))
    out = [prf(*[F.col(f"{c}_{m}") for c in "mpr"]).alias(m) for m in metrics]
    return rows.select(*(df.columns if tuple(carried) == ("*",) else carried), *out)


def score100(f: Column, digits: int = 4) -> Column:
    """Reference reporting scale: F x 100 rounded to 4 digits."""
    return F.round(f * 100.0, digits)
