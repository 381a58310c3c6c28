import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import augment as au
from tessera.operators import batching as bt
from tessera.operators import candidates as cd
from tessera.operators import cluster as cl
from tessera.operators import evaluation as ev
from tessera.operators import negatives as ng
from tessera.operators import splits


def test_stratified_folds_balanced(spark):
    df = spark.createDataFrame([(i, i % 7 == 0) for i in range(997)], "id long, s boolean")
    f = splits.stratified_folds(df, "id", ["s"], k=10, seed=3).collect()
    sizes = [sum(1 for r in f if r.fold == k) for k in range(10)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 997
    for flag in (True, False):
        per = [sum(1 for r in f if r.fold == k and r.s == flag) for k in range(10)]
        assert max(per) - min(per) <= 1


def test_pick_best_first_wins_and_invalid_scores(spark):
    rows = [(1, 0, "a", 5.0), (1, 1, "b", 5.0), (2, 0, "c", -1.0), (3, 0, "d", float("nan")),
            (3, 1, "e", 0.0), (4, 0, "f", 0.0)]
    df = spark.createDataFrame(rows, "sample_id long, cand_rank long, text string, score double")
    got = {r.sample_id: r.cand_rank for r in cd.pick_best(df).collect()}
    assert got == {1: 0, 3: 1, 4: 0}


def test_relative_and_binary_labels(spark):
    rows = [(1, 0, 2.0), (1, 1, 4.0), (2, 0, 0.0), (2, 1, 0.0)]
    df = spark.createDataFrame(rows, "sample_id long, cand_rank long, score double")
    rel = {(r.sample_id, r.cand_rank): r.label for r in cd.relative_labels(df).collect()}
    binl = {(r.sample_id, r.cand_rank): r.label for r in cd.relative_labels(df, binary=True).collect()}
    assert rel == {(1, 0): 0.5, (1, 1): 1.0, (2, 0): 0.0, (2, 1): 0.0}
    assert binl == {(1, 0): 0.0, (1, 1): 1.0, (2, 0): 1.0, (2, 1): 1.0}


def test_negatives_distinct_and_not_gold(spark):
    rows = [(i, f"t{i % 40}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t string")
    negs = ng.sample_negatives(df, "id", "t", 5, seed=1).collect()
    by = {}
    for r in negs:
        by.setdefault(r.id, []).append(r)
    for i, rs in by.items():
        assert len({r.j for r in rs}) == len(rs)
        assert all(r.neg_target != f"t{i % 40}" for r in rs)
    with pytest.raises(ValueError):
        ng.sample_negatives(df.limit(3), "id", "t", 5)


def slow_budget_batches(lens, budget, multiple):
    """Lengths in descending order -> batches of positions, row by row."""
    out, rest = [], list(range(len(lens)))
    while rest:
        n = 1
        while n < len(rest) and (n + 1) * lens[rest[0]] <= budget:
            n += 1
        if n < len(rest):
            n = n // multiple * multiple or n
        out.append(rest[:n])
        rest = rest[n:]
    return out


def test_budget_batches_against_row_by_row(spark):
    rng = random.Random(5)
    lens = sorted((rng.choice([0, 1, 3, 9, rng.randint(1, 140)]) for _ in range(1500)), reverse=True)
    df = spark.createDataFrame(list(enumerate(lens)), "id long, n long")
    want = slow_budget_batches([max(x, 1) for x in lens], 1024, 64)
    for shard in (100, 65536):
        got = {}
        for r in bt.token_budget_batches(df, "id", "n", 1024, 64, shard_rows=shard).collect():
            got.setdefault((r.batch_id, r.batch_pos), []).append(r.id)
        assert [sorted(v) for _, v in sorted(got.items())] == want
        assert sorted(p for _, p in got) == list(range(len(want)))
        costs = {b: len(v) * max(lens[i] for i in v) for (b, p), v in got.items()}
        assert [costs[b] for b, p in got if p == 0] == [max(costs.values())]


def slow_packs(s, t, budget):
    out, i = [], 0
    while i < len(s):
        j = i + 1
        while j < len(s) and sum(s[i:j + 1]) <= budget and sum(t[i:j + 1]) <= budget:
            j += 1
        out.append(list(range(i, j)))
        i = j
    return out


def test_packs_against_row_by_row(spark):
    rng = random.Random(9)
    for n in (1, 40, 900):
        s = [rng.choice([0, 0, 5, 150, rng.randint(1, 50)]) for _ in range(n)]
        t = [rng.choice([0, 2, rng.randint(1, 50)]) for _ in range(n)]
        df = spark.createDataFrame([(i, a, b, f"s{i}", f"t{i}") for i, (a, b) in enumerate(zip(s, t))],
                                   "id long, a long, b long, source string, target string")
        want = slow_packs(s, t, 100)
        for shard in (7, 100, 65536):
            got = {}
            for r in bt.pack_rows(df, ["id"], "a", "b", 100, shard_rows=shard).collect():
                got.setdefault(r.pack_id, []).append((r.pack_pos, r.id))
            assert [[i for _, i in sorted(v)] for _, v in sorted(got.items())] == want
    texts = bt.packed_texts(df, ["id"], "a", "b", 100).collect()
    assert sorted((r.pack_id, r.n_pairs, r.source, r.target) for r in texts) == [
        (k, len(v), " ".join(f"s{i}" for i in v), " ".join(f"t{i}" for i in v)) for k, v in enumerate(want)]


def test_chains_over_many_levels(spark):
    rng = random.Random(4)
    nxt = [i + rng.choice([1, 2, 3, 30]) for i in range(3000)]
    df = spark.createDataFrame([(i, min(e, 3000)) for i, e in enumerate(nxt)], "_o long, _next long")
    want, at = [], 0
    while at < 3000:
        want.append(at)
        at = nxt[at]
    for shard, fan in ((7, 3), (50, 2), (100, 256)):
        assert sorted(r._o for r in bt.chain_starts(df, 3000, shard, fan).collect()) == want
    # chains that never meet: every exit of a shard is another position
    apart = spark.createDataFrame([(i, min(i + 10, 500)) for i in range(500)], "_o long, _next long")
    assert sorted(r._o for r in bt.chain_starts(apart, 500, 20, 2).collect()) == list(range(0, 500, 10))


def test_packs_of_pairs_without_a_token(spark):
    df = spark.createDataFrame([(i, 0, 0) for i in range(25)], "id long, a long, b long")
    got = {}
    for r in bt.pack_rows(df, ["id"], "a", "b", 100, max_rows=10).collect():
        got.setdefault(r.pack_id, []).append(r.id)
    assert [sorted(v) for _, v in sorted(got.items())] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]


def test_trim_batch_cuts_interior_columns(spark):
    rows = [(1, 0, ["a", "p", "b", "p"]), (2, 0, ["p", "p", "c"]), (3, 1, ["p", "p"]), (4, 1, [])]
    df = spark.createDataFrame(rows, "id long, batch long, tok array<string>")
    got = {r.id: (r.tok, r.width) for r in bt.trim_batch(df, "batch", "tok", "p").collect()}
    assert got == {1: (["a", "b"], 2), 2: (["p", "c"], 2), 3: ([], 0), 4: ([], 0)}


def test_round_robin_shards_disjoint(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "doc_id")
    nopad = bt.round_robin_shards(df, "doc_id", 4, pad=False).collect()
    assert len(nopad) == 103 and len({r.doc_id for r in nopad}) == 103
    padded = bt.round_robin_shards(df, "doc_id", 4).collect()
    sizes = [sum(1 for r in padded if r.shard == k) for k in range(4)]
    assert sizes == [26, 26, 26, 26]


def test_sortish_pads_less_than_file_order(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.randint(1, 300)) for i in range(2000)], "id long, n long")
    s = bt.padding_waste(bt.sortish_batches(df, "id", "n", 8), "batch_id", "n").first().pad_tokens
    f = bt.padding_waste(bt.chunks(df, ["id"], 8, "batch_id"), "batch_id", "n").first().pad_tokens
    assert s < f


def test_components_match_union_find(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 4))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(120)], "vec_id long, embedding array<double>")
    eps = 1.2
    comp = {r.vec_id: r.cluster for r in cl.connected_components(
        df.select("vec_id"), cl.epsilon_pairs(df, eps, block_rows=30)).collect()}
    parent = list(range(120))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a
    for i in range(120):
        for j in range(i + 1, 120):
            if np.sqrt(((x[i] - x[j]) ** 2).sum()) <= eps:
                ri, rj = find(i), find(j)
                parent[max(ri, rj)] = min(ri, rj)
    for i in range(120):
        members = [j for j in range(120) if find(j) == find(i)]
        assert comp[i] == min(members)


def test_epsilon_pairs_for_any_cells_and_blocks(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(150, 3)) * .05, np.zeros((5, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))] + [(999, None)], "vec_id long, embedding array<double>")
    for eps in (0.0, 0.3, 1.0):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        want = sorted((i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= eps)
        for cell, block in ((1000, 1000), (20, 7), (3, 50)):
            got = sorted((r.id1, r.id2) for r in cl.epsilon_pairs(df, eps, block_rows=block, cell_rows=cell).collect())
            assert got == want
    assert cl.epsilon_pairs(df.limit(0), 1.0).count() == 0


def test_blind_mentions_and_entity_filter(spark):
    texts = spark.createDataFrame([(1, "flu and flu cold"), (2, "none")], "doc_id long, text string")
    ments = spark.createDataFrame([(1, 0, "flu", 0.95), (1, 1, "cold", 0.5)],
                                  "doc_id long, start long, mention string, score double")
    out = {r.doc_id: r.text for r in cl.blind_mentions(texts, ments).collect()}
    assert out == {1: "disease and disease disease", 2: "none"}
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "id1 long, id2 long")
    flags = {(r.id1, r.id2): r.has_entity for r in au.has_entity(pairs, ments).collect()}
    assert flags == {(1, 2): True, (2, 3): False}


def test_threshold_metrics_small(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.2, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    r = ev.threshold_metrics(df).first()
    assert r.f1 == pytest.approx(0.857143, abs=1e-6) and r.f1_threshold == 0.6
    assert r.accuracy == pytest.approx(0.8)
    assert r.average_precision == pytest.approx((1 + 1 + 0.75) / 3, abs=1e-6)


def test_param_grid(spark):
    combos = ev.parse_grid("num_beams=1:2 length_penalty=0.9:1.0")
    assert len(combos) == 4 and combos[0] == {"num_beams": "1", "length_penalty": "0.9"}
    g = ev.grid_frame(spark, "num_beams=1:2 length_penalty=0.9:1.0 early=true").collect()
    assert len(g) == 4 and all(r.early == 1.0 for r in g)


def test_vectors_are_copied_little_where_cells_lie_close(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 16))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    written = []
    kept = cl.cut_lineage
    monkeypatch.setattr(cl, "cut_lineage", lambda d: written.append(kept(d)) or written[-1])
    pairs = cl.epsilon_pairs(df, 1.0, block_rows=400, cell_rows=100)
    assert all(w.count() <= 1200 for w in written)  # the copies that visit cells aren't written
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = sorted((i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= 1.0)
    assert want and sorted((r.id1, r.id2) for r in pairs.collect()) == want


def test_components_write_a_forest_only(spark, monkeypatch):
    written = []
    kept = cl.cut_lineage
    monkeypatch.setattr(cl, "cut_lineage", lambda d: written.append(kept(d)) or written[-1])
    edges = spark.createDataFrame([(i, j) for i in range(40) for j in range(i)], "id1 long, id2 long").coalesce(1)
    got = cl.connected_components(spark.range(41).withColumnRenamed("id", "vec_id"), edges)
    assert {r.vec_id: r.cluster for r in got.collect()} == {**dict.fromkeys(range(40), 0), 40: 40}
    assert written[0].count() == 39
