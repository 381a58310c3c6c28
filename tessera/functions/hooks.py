"""User callables as columns.

A hook is a plain Python function over a list of values; it runs in Arrow
batches inside tasks, next to the rows, and is shipped with the plan.  Where
no hook is given, the engine's own native expressions are used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _texts(s: pd.Series) -> list[str]:
    return ["" if t is None else t for t in s]


def length(fn: Callable[[list[str]], Sequence[int]], text: Column) -> Column:
    """Token counts by a tokenizer's batch function."""
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(fn(_texts(s))), dtype="int64")

    return run(text)


def sentence_splitter(fn: Callable[[str], Sequence[str]], text: Column) -> Column:
    """Sentences by a trained splitter."""
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([list(fn(t)) for t in _texts(s)])

    return run(text)


def pair_scorer(fn: Callable[[list[str], list[str]], Sequence[float]], source: Column, candidate: Column) -> Column:
    """Scores of (source, candidate) pairs by a model's batch function."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in fn(_texts(a), _texts(b))], dtype="float64")

    return run(source, candidate)


def candidate_generator(fn: Callable[[list[str]], Sequence[Sequence[str]]], source: Column) -> Column:
    """Generated texts of each source, best first, as an array."""
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([list(x) for x in fn(_texts(s))])

    return run(source)


def embedder(fn: Callable[[list[str]], Sequence[Sequence[float]]], text: Column) -> Column:
    """Embeddings by a model's batch function."""
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[float(v) for v in x] for x in fn(_texts(s))])

    return run(text)


def metric(fn: Callable[[str, str], float], pred: Column, ref: Column) -> Column:
    """A row's score by a user's metric."""
    return pair_scorer(lambda a, b: [fn(x, y) for x, y in zip(a, b)], pred, ref)
