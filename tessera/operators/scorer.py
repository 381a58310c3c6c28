"""A trainable pair scorer (C17): linear regression on lexical features of a
(source, candidate) pair, with MLlib; and the two-stage job that uses one
(C13): candidates, scores, the best of each sample, its metrics."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rouge as rg
from tessera.functions import text as tx
from tessera.functions.arrays import once
from tessera.operators.candidates import pick_best
from tessera.operators.evaluation import lexical_score
from tessera.operators.metrics import corpus_score
from tessera.operators.splits import seeded_hash

FEATURES = ["f_share", "f_new", "f_rouge2", "f_length"]


def features(pairs: DataFrame, source: str = "source", candidate: str = "candidate") -> DataFrame:
    """``pairs`` with the feature columns: share of the source's words that
    the candidate has, of the candidate's that the source has, bigram F1, log
    of the candidate's words."""
    bigrams = rg.rouge_n(tx.alnum_tokens(candidate), tx.alnum_tokens(source), 2)["f"]
    return pairs.select("*", once(f_share=lexical_score(F.col(source), F.col(candidate)),
                                  f_new=lexical_score(F.col(candidate), F.col(source)),
                                  f_rouge2=bigrams, f_length=F.log1p(tx.word_count(candidate).cast("double"))))


def fit_scorer(examples: DataFrame, label: str = "label", key: str = "guid", most: int | None = None, seed: int = 42,
               source: str = "source", candidate: str = "candidate") -> LinearRegressionModel:
    """Least squares on all labelled rows: sums of products, added up by task.
    Only a caller that names ``most`` gets a fit on about so many rows, chosen
    by a seeded hash of their keys."""
    n = 0 if most is None else examples.count()
    if most is not None and n > most:
        examples = examples.where(seeded_hash(key, seed) % 1_000_000 < int(1_000_000 * most / n))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(features(examples, source, candidate))
    return LinearRegression(featuresCol="_x", labelCol=label, solver="normal", regParam=1e-6).fit(rows)


def score_pairs(model: LinearRegressionModel, pairs: DataFrame, name: str = "score",
                source: str = "source", candidate: str = "candidate") -> DataFrame:
    """Scores as a native expression of the learned weights."""
    total: Column = F.lit(float(model.intercept))
    for f, w in zip(FEATURES, model.coefficients):
        total = total + F.col(f) * F.lit(float(w))
    return features(pairs, source, candidate).withColumn(name, total).drop(*FEATURES)


def predict_best(candidates: DataFrame, score: Column, key: str = "sample_id", text: str = "text",
                 gold: str = "gold", metric: str = "rouge", **options) -> tuple[DataFrame, DataFrame]:
    """(picked, metrics): the best-scored candidate of each sample and the
    corpus metrics of the picks against their golds."""
    scored = candidates.select("*", once(score=score))
    picked = pick_best(scored, key, payload=[text, gold])
    return picked, corpus_score(picked.select(F.col(text).alias("pred"), F.col(gold).alias("ref")), metric, **options)
