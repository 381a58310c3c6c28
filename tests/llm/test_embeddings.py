import numpy as np

from tessera.llm import embeddings
from tessera.llm.embeddings import near_vectors, op5_embeddings


def slow(rows, t=0.98):
    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [i for i, (k, v, l) in enumerate(rows) if k is not None and l is not None and ok(v)]
    links = {i: set() for i in range(len(rows))}
    for dims in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == dims]
        x = np.array([rows[i][1] for i in own], np.float32).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        lab = np.array([rows[i][2] for i in own])
        for a, b in zip(*np.nonzero((x @ x.T >= t) & (lab[:, None] == lab[None, :]))):
            if a != b:
                links[own[a]].add(own[b])
    seen, low = set(), {}
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            j = todo.pop()
            if j not in group:
                group.add(j)
                todo += links[j]
        seen |= group
        for j in group:
            low[j] = min((rows[m][0] for m in group if rows[m][0] is not None), default=None)
    return sorted(((k, len(links[i]), low[i], k == low[i]) for i, (k, v, l) in enumerate(rows)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, _cell int, _n int")


def test_against_all_pairs_in_many_cells_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        centre = rng.normal(size=8)
        for _ in range(int(rng.integers(5, 90))):
            v = centre + rng.normal(size=8) * rng.choice([.02, .1, .3, .8])
            rows.append((v * rng.choice([1, 5, .01])).astype(np.float32).tolist())
    rows += [rows[0]] * 60 + [rows[1]] * 3
    rows = [(5000 - 3 * i, v, int(i % 3) if i < 500 else 1) for i, v in enumerate(rows)]
    rows += [(1, None, 1), (2, [0.0] * 8, 1), (3, [1.0, None] + [0.0] * 6, 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] + [1.0] * 7, 1),
             (6, [1.0] * 8, None), (7, [1.0] * 8, None), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (10, [], 1),
             (12, [3e38, 3e38], 1), (13, [1e-30, 1e-30], 1), (14, [-0.0, 1.0], 2), (15, [0.0, 1.0], 2), (None, [1.0, 2.0], None)]
    df = table(spark, rows)
    want = slow(rows)
    for cell, block in ((8192, 2048), (40, 16), (7, 1000)):
        assert got(near_vectors(df, cell=cell, block=block)) == want


def test_repeated_keys(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [1.0, 0.01], 1), (7, [1.0, 0.01], 1), (5, [1.0, 0.0], 2), (9, [0.0, 1.0], 1), (5, None, 1)]
    assert got(near_vectors(table(spark, rows))) == slow(rows) and len(slow(rows)) == len(rows)


def test_visits_are_narrowed_and_whole(spark):
    """Clusters on a sphere: every near pair shares a cell, in few visits."""
    rng = np.random.default_rng(8)
    points = np.concatenate([m + 0.15 * rng.normal(size=(60, 16)) for m in rng.normal(size=(30, 16))])
    x = points / np.linalg.norm(points, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, 1, v.tolist(), 1) for i, v in enumerate(x)], "_id long, _label int, _vec array<double>, _n long")
    c = embeddings.centres(df, 16, 40)
    radius = np.sqrt(2 - 2 * 0.98)
    seen = {}
    for spans in (None, embeddings.reach(df, c, 16)):
        dealt = df.mapInArrow(embeddings._visits(c, 16, radius, spans), "_id long, _label int, _vec array<double>, _n long, _cell long, _home boolean")
        cells = {}
        for r in dealt.collect():
            cells.setdefault(r._id, {})[r._cell] = r._home
        seen[spans is None] = sum(map(len, cells.values())) / len(cells)
        for a, b in np.argwhere(np.triu(x @ x.T >= 0.98, 1)):
            assert any(k in cells[b] and (home or cells[b][k]) for k, home in cells[a].items())
    assert seen[False] <= seen[True] < 20


def test_given_vectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(op5_embeddings(spark, sf)) == slow(rows)


def test_empty_and_nothing_valid(spark):
    assert near_vectors(table(spark, [])).count() == 0
    assert got(near_vectors(table(spark, [(1, None, 1), (2, [0.0], 1)]))) == [(1, 0, 1, True), (2, 0, 2, True)]
