import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster as cl
from tessera.operators import linkage as lk
from tessera.plans import catalog


def slow_ward(points, threshold):
    """Merge the nearest two clusters until none are below the threshold."""
    size, mean, out = {i: 1 for i, _ in points}, {i: np.array(v, float) for i, v in points}, []
    while len(size) > 1:
        ids = sorted(size)
        d, a, b = min((np.sqrt(2 * size[a] * size[b] / (size[a] + size[b]) * ((mean[a] - mean[b]) ** 2).sum()), a, b) for i, a in enumerate(ids) for b in ids[i + 1:])
        if d >= threshold:
            break
        mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        size[a] += size.pop(b)
        del mean[b]
        out.append((a, b, round(float(d), 6), size[a]))
    return sorted(out)


def frame(spark, points):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in points], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("seed, threshold", [(1, 1.0), (2, 2.5), (3, 100.0)])
def test_ward_is_that_of_one_merge_at_a_time(spark, seed, threshold):
    rng = np.random.default_rng(seed)
    points = [(int(1000 - 3 * i), c + rng.normal(scale=0.4, size=3)) for i, c in enumerate(np.repeat(rng.normal(scale=2, size=(9, 3)), 6, axis=0))]
    merges = lk.ward_merges(frame(spark, points), threshold)
    got = sorted((r.id1, r.id2, round(r.height, 6), r.size) for r in merges.collect())
    assert got == slow_ward(points, threshold) and got
    labels = {r.vec_id: r.cluster for r in lk.cut(frame(spark, points), merges, "height").collect()}
    up = {b: a for a, b, *_ in got}

    def top(i):
        return top(up[i]) if i in up else i

    assert labels == {i: top(i) for i, _ in points}


def test_ward_of_copies_nulls_and_nothing(spark):
    points = [(i, [0.0, 0.0]) for i in range(40)] + [(50, [0.5, 0.0]), (51, [9.0, 9.0]), (52, None)]
    df = frame(spark, points)
    merges = lk.ward_merges(df, 5.0)
    rows = merges.collect()
    assert sorted((r.id2, r.size) for r in rows if r.height == 0) == [(i, i + 1) for i in range(1, 40)]
    (last,) = [r for r in rows if r.height]
    assert (last.id1, last.id2, last.size) == (0, 50, 41) and last.height == pytest.approx(np.sqrt(80 / 41) * 0.5)
    assert {r.vec_id: r.cluster for r in lk.cut(df, merges, "height").collect()}[52] == 52
    assert lk.ward_merges(frame(spark, []), 1.0).count() == 0
    assert lk.ward_merges(frame(spark, [(1, [0.0]), (2, [3.0])]), 3.0).count() == 0  # the threshold itself doesn't merge


def slow_forest(links):
    up = {}

    def root(x):
        return root(up[x]) if x in up else x

    out = []
    for d, a, b in sorted((d, min(a, b), max(a, b)) for a, b, d in links):
        if root(a) != root(b):
            up[root(a)] = root(b)
            out.append((a, b, d))
    return out


def test_forest_and_cuts(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b), float(rng.integers(1, 30)) / 10) for a, b in rng.integers(0, 120, (400, 2)) if a != b] + [(200, 200, 0.1)]
    df = spark.createDataFrame(links, "id1 long, id2 long, distance double").repartition(6)
    want = slow_forest([x for x in links if x[0] != x[1]])
    assert sorted(map(tuple, lk.spanning_forest(df).select("id1", "id2", "distance").collect())) == sorted(want)
    steps = [tuple(r) for r in lk.dendrogram(df).orderBy("step").collect()]
    assert [s[0] for s in steps] == list(range(len(want))) and [(d, a, b) for _, a, b, d in steps] == sorted((d, a, b) for a, b, d in want)
    nodes, forest = spark.range(201).select(F.col("id").alias("vec_id")), lk.spanning_forest(df)
    for t in (0.0, 0.5, 1.5, 3.0):
        whole = cl.connected_components(nodes, df.where(F.col("distance") <= t))
        assert sorted(map(tuple, lk.cut(nodes, forest, "distance", t).collect())) == sorted(map(tuple, whole.collect()))
    assert lk.spanning_forest(df.limit(0)).count() == 0


def test_registered_ward_queries(spark):
    catalog.load_all()
    sf = "/root/testdata/sf0.01"
    points = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding is not None]
    want = slow_ward(points, 1.1)
    assert want and sorted(map(tuple, catalog.QUERIES["ward_merges"](spark, sf).collect())) == want
    joined = {b for _, b, *_ in want}
    labels = catalog.QUERIES["ward_clusters"](spark, sf).collect()
    assert {r.vec_id for r in labels if r.vec_id != r.cluster} == joined


def test_ward_measures_few_links_anew(spark, monkeypatch):
    """Links that the old distances show to be too far bring no centroids."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 12))
    points = [(i, [float(v) for v in r / np.sqrt((r * r).sum())]) for i, r in enumerate(x)]
    asked, kept = [], lk._measure
    monkeypatch.setattr(lk, "_measure", lambda pairs, *more: asked.append(pairs.count()) or kept(pairs, *more))
    merges = lk.ward_merges(frame(spark, points), 1.0)
    got = sorted((r.id1, r.id2, round(r.height, 6), r.size) for r in merges.collect())
    assert got == [tuple(r) for r in slow_ward(points, 1.0)]
    links = cl.epsilon_pairs(frame(spark, points), 1.0).count()
    assert links > 100 and sum(asked) < links / 2, (links, asked)
