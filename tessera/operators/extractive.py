"""Extractive candidates: a text's sentences ranked by centrality (U4).

A text's sentences are a graph, weighted by the cosine of their word counts;
power iteration with damping gives each sentence its share of a random walk.
The graph is never built: with the rows of N as unit word vectors, a step is
``N (N' x)`` less the walk that stays, so a text costs its words times the
number of steps, whatever the number of its sentences.  Ranks are row-local:
nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx

DAMPING, STEPS = 0.85, 30


def centrality(sentences: list[list[str]], damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """A share for each sentence (lists of words); sentences without a word in
    common with others get what damping gives to each, sums are 1 at most."""
    n = len(sentences)
    number: dict[str, int] = {}
    rows = np.repeat(np.arange(n), [len(s) for s in sentences])
    words = np.array([number.setdefault(w, len(number)) for s in sentences for w in s], np.int64)
    cells, counts = np.unique(rows * max(len(number), 1) + words, return_counts=True)
    row, word = np.divmod(cells, max(len(number), 1))
    norm = np.sqrt(np.bincount(row, counts.astype(np.float64) ** 2, n))
    weight = counts / norm[row] if len(row) else np.zeros(0)
    filled = (norm > 0).astype(np.float64)

    def step(x: np.ndarray) -> np.ndarray:
        by_word = np.bincount(word, weight * x[row], len(number))
        return np.bincount(row, weight * by_word[word], n) - filled * x

    degree = step(filled)
    out = np.where(degree > 1e-9, degree, 1.0)
    x = np.full(n, 1.0 / max(n, 1))
    for _ in range(steps):
        x = (1 - damping) / max(n, 1) + damping * step(np.where(degree > 1e-9, x / out, 0.0))
    return x


def _ranked(n_best: int, damping: float, steps: int):
    def run(batches):
        for batch in batches:
            rows, ranks, numbers, scores, texts = [], [], [], [], []
            for i, (tokens, sentences) in enumerate(zip(batch.column("_tokens").to_pylist(), batch.column("_sentences").to_pylist())):
                x = centrality(tokens, damping, steps).round(9)  # equal sentences are equal, whatever the order of sums
                for k, j in enumerate(sorted(range(len(x)), key=lambda j: (-x[j], j))[:n_best]):
                    rows.append(i)
                    ranks.append(k)
                    numbers.append(j)
                    scores.append(float(x[j]))
                    texts.append(sentences[j])
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(rows, pa.int64())), pa.array(ranks, pa.int64()), pa.array(numbers, pa.int64()),
                                              pa.array(scores, pa.float64()), pa.array(texts, pa.string())], ["_key", "cand_rank", "sentence_no", "score", "text"])

    return run


def extract(texts: DataFrame, n_best: int = 5, key: str = "doc_id", sentences: Column | str = "sentences", damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(key, cand_rank, sentence_no, score, text): the ``n_best`` most central
    sentences of each row (an array of texts), best first; of equal scores the
    earlier.  Rows without sentences, or null, give none; sentences without a
    word come last.  Repeated keys stay separate rows."""
    if n_best < 1:
        raise ValueError("at least one sentence must be asked for")
    s = F.coalesce(F.col(sentences) if isinstance(sentences, str) else sentences, F.array().cast("array<string>"))
    rows = texts.select(F.col(key).alias("_key"), s.alias("_sentences")).withColumn("_tokens", F.transform("_sentences", lambda t: F.coalesce(tx.alnum_tokens(t), F.array().cast("array<string>"))))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(_ranked(n_best, damping, steps), f"_key {kind}, cand_rank long, sentence_no long, score double, text string").withColumnRenamed("_key", key)
