import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import resampling as rs
from tessera.plans import catalog


@pytest.mark.parametrize("n", [1, 5, 1023, 1024, 1025, 10_000])
def test_every_replicate_draws_n_rows(n):
    draws = rs.Draws(n, 40, 7)
    blocks = [draws.weights(b) for b in range(draws.blocks)]
    assert sum(w.shape[1] for w in blocks) == n
    assert (sum(w.sum(axis=1) for w in blocks) == n).all()
    for b in reversed(range(draws.blocks)):  # whatever was asked before
        assert np.array_equal(rs.Draws(n, 40, 7).weights(b), blocks[b])


def test_draws_are_uniform():
    draws = rs.Draws(3000, 400, 3)
    w = np.concatenate([draws.weights(b) for b in range(draws.blocks)], axis=1)
    assert abs(w.mean() - 1) < 1e-12 and abs(w.var() - (1 - 1 / 3000)) < 0.01  # binomial (n, 1/n)
    assert np.corrcoef(w[:, :1500].sum(axis=1), w[:, 1500:].sum(axis=1))[0, 1] == pytest.approx(-1)
    assert abs(w.mean(axis=0).std() - 400 ** -0.5) < 0.01


def plain(values, replicates, seed):
    draws = rs.Draws(len(values), replicates, seed)
    w = np.concatenate([draws.weights(b) for b in range(draws.blocks)], axis=1)
    return w @ np.array(values) / len(values)


def test_same_for_any_split(spark):
    rng = np.random.default_rng(1)
    x = rng.random(2500)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    want = plain(x, 60, 5)
    for parts in (1, 7):
        got = rs.bootstrap_means(df.repartition(parts, F.rand(3)), ["id"], ["x"], 60, 5).orderBy("b").collect()
        np.testing.assert_allclose([r.x for r in got], want, rtol=1e-9)
    assert [tuple(r) for r in rs.bootstrap_means(df.limit(0), ["id"], ["x"], 3).orderBy("b").collect()] == []


def test_registered_query(spark):
    """The whole query against resampling the whole score table in numpy."""
    from tessera.functions import rouge as rg
    from tessera.plans import derived

    catalog.load_all()
    sf = "/root/testdata/sf0.001"
    got = {r.metric: (r.low, r.mid, r.high) for r in catalog.QUERIES["bootstrap_rouge_exact"](spark, sf).collect()}
    keys = ("rouge1", "rouge2", "rougeL")
    rows = rg.scored(derived.doc_candidates(spark, sf), "text", "gold", keys, False).select("sample_id", "cand_rank", *[F.col(k)["f"].alias(k) for k in keys])
    rows = sorted(map(tuple, rows.collect()))
    for i, k in enumerate(keys, 2):
        means = plain([r[i] for r in rows], 200, 42)
        want = [round(float(np.quantile(means, q)) * 100, 4) for q in (0.025, 0.5, 0.975)]
        assert got[k] == pytest.approx(want, abs=2e-4)
