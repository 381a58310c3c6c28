import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.operators import extractive as ex
from tessera.plans import catalog


def dense(sentences, damping=0.85, steps=30):
    n = len(sentences)
    words = sorted({w for s in sentences for w in s})
    x = np.array([[Counter(s)[w] for w in words] for s in sentences], float).reshape(n, -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    w = x @ x.T
    np.fill_diagonal(w, 0)
    d = w.sum(axis=0)
    p = np.divide(w, d, out=np.zeros_like(w), where=d > 1e-9)
    v = np.full(n, 1 / max(n, 1))
    for _ in range(steps):
        v = (1 - damping) / n + damping * p @ v
    return v


def test_centrality_is_that_of_the_whole_graph():
    rng = random.Random(1)
    for _ in range(60):
        s = [rng.choices("abcdefghijklmnop", k=rng.randint(0, 9)) for _ in range(rng.randint(1, 25))]
        np.testing.assert_allclose(ex.centrality(s), dense(s), atol=1e-12)
    assert len(ex.centrality([])) == 0


def test_rows(spark):
    df = spark.createDataFrame([(1, ["the cat sat", "the cat ran", "a dog", "", "the cat sat"]), (2, None), (3, []), (4, ["one"]), (4, ["two"])], "doc_id long, sentences array<string>")
    got = sorted(map(tuple, ex.extract(df, 3).collect()), key=repr)
    one = [(r[1], r[2], r[4]) for r in got if r[0] == 1]
    assert one == [(0, 0, "the cat sat"), (1, 4, "the cat sat"), (2, 1, "the cat ran")]
    assert sorted(r[4] for r in got if r[0] == 4) == ["one", "two"] and not [r for r in got if r[0] in (2, 3)]
    assert ex.extract(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ex.extract(df, 0)


def rouge_2(a, b):
    def grams(t):
        t = [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
        return Counter(zip(t, t[1:]))

    x, y = grams(a), grams(b)
    m = sum((x & y).values())
    p, r = (m / sum(g.values()) if g else 0.0 for g in (x, y))
    return round(200 * p * r / (p + r), 4) if p + r else 0.0


def test_registered_run(spark):
    """The whole query against plain Python over the extracted sentences."""
    from tessera.plans import candidate_queries as cq
    from tessera.plans import derived

    catalog.load_all()
    sf = "/root/testdata/sf0.001"
    gold = {r.sample_id: r.gold for r in derived.doc_gold(spark, sf).collect()}
    by_id = {}
    for r in cq._extracted(spark, sf).collect():
        by_id.setdefault(r.sample_id, []).append((r.cand_rank, rouge_2(r.text, gold[r.sample_id])))
    got = {r.sample_id: (r.cand_rank, r.score, r.central_score) for r in catalog.QUERIES["extractive_run"](spark, sf).collect()}
    assert got.keys() == by_id.keys()
    for k, rows in by_id.items():
        rank, score = max(sorted(rows), key=lambda r: (r[1], -r[0]))
        assert got[k][0] == rank and got[k][1:] == pytest.approx((score, dict(rows)[0]), abs=2e-4)
