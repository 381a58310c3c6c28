"""Longest-common-subsequence kernels for ROUGE-L / ROUGE-Lsum.

LCS is inherently sequential per pair, so it runs as an Arrow-batched pandas
UDF: two token arrays in, one integer out, no shuffle.  The length uses the
bit-parallel recurrence (one big-integer add/or per token of the second text),
O(|a|·|b|/64) per pair.  Summary-level LCS needs the aligned positions, so it
walks back through a table per pair of sentences, of the tokens they share.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_masks(a) -> dict:
    """For each token of ``a`` the bits of its places."""
    masks: dict = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    return masks


def lcs_of_masks(masks: dict, n: int, b) -> int:
    """LCS length of a text of ``n`` tokens with these masks, and ``b``."""
    full = v = (1 << n) - 1
    for tok in b:
        if tok in masks:  # others change nothing
            u = v & masks[tok]
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def lcs_length(a, b) -> int:
    return lcs_of_masks(lcs_masks(a), len(a), b)


#: Tables of up to so many cells are filled in plain Python, which is faster there.
FEW_CELLS = 2048


def _lcs_table(ref, pred):
    n, m = len(ref), len(pred)
    if n * m > FEW_CELLS:
        ref, pred, table = np.asarray(ref), np.asarray(pred), np.zeros((n + 1, m + 1), np.int32)
        for i in range(n):
            # a match adds one to the corner; every other cell is the running maximum
            np.maximum.accumulate(np.maximum(table[i, 1:], np.where(pred == ref[i], table[i, :-1] + 1, 0)), out=table[i + 1, 1:])
        return table
    above = [0] * (m + 1)
    table = [above]
    for r in ref:
        row, left = [0], 0
        for j, p in enumerate(pred):
            if p == r:
                left = above[j] + 1
            elif above[j + 1] > left:
                left = above[j + 1]
            row.append(left)
        table.append(row)
        above = row
    return table


def lcs_positions(ref, pred, gaps=None) -> list[int]:
    """Indices of ``ref`` on one longest common subsequence with ``pred``
    (token numbers); of equals the walk back steps in ``ref``, as the
    published scorer does.  ``gaps[j]``: behind the j-th of ``pred``, counted
    from 1, stood tokens without a match that were left out; the walk steps
    over them as it would have, back to the first row with the same length."""
    table = _lcs_table(ref, pred)
    out = []
    i, j, came = len(ref), len(pred), True
    while i > 0 and j > 0:
        if came and gaps is not None and gaps[j]:
            while i > 0 and table[i - 1][j] == table[i][j]:
                i -= 1
            came = False
        elif ref[i - 1] == pred[j - 1]:
            out.append(i - 1)
            i -= 1
            j, came = j - 1, True
        elif table[i][j - 1] > table[i - 1][j]:
            j, came = j - 1, True
        else:
            i, came = i - 1, False
    out.reverse()
    return out


def _places(tokens) -> dict:
    out: dict = {}
    for i, t in enumerate(tokens):
        out.setdefault(t, []).append(i)
    return out


def _union(r, sentences, lists) -> set[int]:
    """Places of ``r`` on its longest common subsequences with the sentences,
    of which ``lists`` has the numbers by token."""
    union: set[int] = set()
    own = _places(r)
    for k in {k: None for t in own for k in lists.get(t, ())}:
        p, places = sentences[k]
        # tables hold what matches only: a token of the reference that isn't in
        # the prediction doesn't turn the walk, one of the prediction by its gap
        common = own.keys() & places.keys()
        some = sorted(i for t in common for i in own[t])
        met = sorted(j for t in common for j in places[t])
        gaps = [met[0] > 0, *(b - a > 1 for a, b in zip(met, [*met[1:], len(p)]))]
        union.update(some[i] for i in lcs_positions([r[i] for i in some], [p[j] for j in met], gaps))
        if len(union) == len(r):
            break
    return union


def summary_lcs_hits(ref_sents, pred_sents) -> int:
    """Union-LCS hit count over sentence lists, each hit consuming one token
    occurrence on both sides.  Equal sentences are compared once, and one that
    stands in both texts is its own longest common subsequence."""
    ref_counts = Counter(t for s in ref_sents for t in s)
    pred_counts = Counter(t for s in pred_sents for t in s)
    known = {s: set(range(len(s))) for s in map(tuple, pred_sents)}
    sentences = lists = None
    hits = 0
    for r in map(tuple, ref_sents):
        if r not in known:
            if sentences is None:
                sentences, lists = [(p, _places(p)) for p in known], {}
                for k, (_, places) in enumerate(sentences):
                    for t in places:
                        lists.setdefault(t, []).append(k)
            known[r] = _union(r, sentences, lists)
        for idx in sorted(known[r]):
            tok = r[idx]
            if ref_counts[tok] > 0 and pred_counts[tok] > 0:
                hits += 1
                ref_counts[tok] -= 1
                pred_counts[tok] -= 1
    return hits


@F.pandas_udf(T.LongType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x) if x is not None else [],
                                 list(y) if y is not None else [])
                      for x, y in zip(a, b)], dtype="int64")


@F.pandas_udf(T.LongType())
def summary_lcs_udf(ref: pd.Series, pred: pd.Series) -> pd.Series:
    def norm(x):
        return [] if x is None else [list(s) for s in x]
    return pd.Series([summary_lcs_hits(norm(r), norm(p)) for r, p in zip(ref, pred)],
                     dtype="int64")
