import itertools
import random
import re

from tessera.llm.packing import batch_rows, best_widths, pack


def test_widths_against_all_choices():
    rng = random.Random(3)
    for _ in range(30):
        grid = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 30) for _ in grid]
        for k in (1, 2, 3, 5):
            def cost(ws):
                return sum(c * min(w for w in ws if w >= g) for g, c in zip(grid, counts))
            best = min(cost((*cs, grid[-1])) for m in range(min(k, len(grid)))
                       for cs in itertools.combinations(grid[:-1], m))
            got = best_widths(grid, counts, k)
            assert len(got) <= k and cost(got) == best


def test_widths_are_optimal_over_many_lengths():
    """Against the plain programme over all beginnings."""
    rng = random.Random(4)
    for _ in range(20):
        lengths = sorted(rng.sample(range(0, 5000), rng.randint(30, 120)))
        counts = [rng.choice([1, 1, 2, 1000]) for _ in lengths]
        below = [0, *itertools.accumulate(counts)]
        n, cost = len(lengths), {(0, 0): 0}
        for k in range(1, 7):
            for j in range(1, n + 1):
                cost[k, j] = min((cost[k - 1, i] + lengths[j - 1] * (below[j] - below[i]) for i in range(j) if (k - 1, i) in cost), default=10**18)
        got = best_widths(lengths, counts, 6)
        assert sum(c * min(w for w in got if w >= g) for g, c in zip(lengths, counts)) == min(cost[k, n] for k in range(1, 7))


def test_widths_are_exact_lengths(spark):
    texts = ["w " * 129] * 6 + ["w " * 257, "w " * 1003]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted({(r.n_tokens, r.width) for r in pack(df).collect()}) == [(129, 129), (257, 257), (1003, 1003)]


def test_batches_hold_the_budget(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a b"] + [" ".join(["w"] * int(rng.paretovariate(0.8) * 5)) for _ in range(600)]
    texts += ["x " * 5000, texts[-1], texts[-1]]
    df = spark.createDataFrame([(i, t, 9, 9) for i, t in enumerate(texts)], "doc_id long, text string, bucket int, _slot int")
    packed = pack(df, buckets=5, budget=500)
    rows = packed.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    batches = {}
    for r in rows:
        assert r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert r.width >= r.n_tokens and r.pad_tokens == r.width - r.n_tokens
        batches.setdefault(r.batch_id, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert len({(r.bucket, r.width) for r in b}) == 1
        assert sorted(r.batch_slot for r in b) == list(range(len(b)))
        assert len(b) * b[0].width <= 500 or len(b) == 1
    got = batch_rows(packed, df).collect()
    assert sorted(itertools.chain(*(r["keys"] for r in got))) == list(range(len(texts)))
    assert all(texts[k] == t for r in got for k, t in zip(r["keys"], r.texts))


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
