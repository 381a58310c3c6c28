"""Hierarchies over vectors: Ward's linkage and single linkage.

Both work on the links that are shorter than a threshold, found once, and
never on all pairs after that.

*Ward.*  The distance of two clusters is ``sqrt(2 a b / (a + b))`` times that
of their centroids (a, b: their sizes), so between single vectors it is the
Euclidean distance, and merging two clusters never brings a third one closer
than the closer of the two was.  Therefore a pair of clusters below the
threshold always has a pair of members below it: the threshold links of the
vectors, carried over to clusters, hold every later candidate.  In a round all
clusters that are each other's nearest merge at once, which gives the same
hierarchy as one merge at a time; centroids and sizes are updated, and only the
links of merged clusters that may still be below the threshold, by the old
distances and sizes, are measured anew.

*Single linkage.*  Boruvka rounds over the links: every component takes its
shortest link out, components that are joined contract.  The links taken are a
minimum spanning forest, and its links up to any lower threshold give the
clusters at that threshold.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.cluster import connected_components, epsilon_pairs
from tessera.operators.ordering import global_index, rank_within
from tessera.session import Rounds


def _links_of_ends(links: DataFrame, order: list[str]) -> DataFrame:
    """(end, best): for each end of a link the first link in ``order``, which
    is the same order for both ends."""
    ends = links.select(F.explode(F.array("a", "b")).alias("end"), F.struct(*order, "a", "b").alias("link"))
    return ends.groupBy("end").agg(F.min("link").alias("best"))


# ----------------------------------- Ward -----------------------------------

def _measured(threshold: float):
    """Links with both centroids, to those below the threshold with their distance."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x, y = (batch.column(c).flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1)) for c in ("x", "y"))
            p, q = (batch.column(c).to_numpy().astype(np.float64) for c in ("p", "q"))
            d = np.sqrt(2 * p * q / (p + q) * ((x - y) ** 2).sum(axis=1)) if n else np.zeros(0)
            near = pa.array(d < threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near), pa.array(d).filter(near)], ["a", "b", "d"])

    return run


def _measure(pairs: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    one = clusters.select(F.col("id").alias("a"), F.col("size").alias("p"), F.col("centroid").alias("x"))
    two = clusters.select(F.col("id").alias("b"), F.col("size").alias("q"), F.col("centroid").alias("y"))
    kind = clusters.schema["id"].dataType.simpleString()
    return pairs.join(one, "a").join(two, "b").select("a", "b", "p", "q", "x", "y").mapInArrow(_measured(threshold), f"a {kind}, b {kind}, d double")


def _may_be_near(links: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of clusters that may be below the threshold after a
    round, of the links of their parts, which tell by themselves for most.

    The square of the distance of two clusters of P and Q vectors that were
    merged of parts x and y at heights u and v is, by Lance and Williams,
    (sum of (size x + size y) d(x, y)^2 - Q u^2 - P v^2) / (P + Q).  Parts
    without a link are as far as the threshold at least."""
    (p, q), (u, v), (k, m) = ([F.col(f"_{c}_{end}") for end in ("a", "b")] for c in ("size", "z", "k"))
    share = (F.col("_was_a") + F.col("_was_b")).cast("double")
    less = q * F.coalesce(u * u, F.lit(0.0)) + p * F.coalesce(v * v, F.lit(0.0))
    sums = links.select(F.least("_new_a", "_new_b").alias("a"), F.greatest("_new_a", "_new_b").alias("b"), share.alias("s"), (share * F.col("d") * F.col("d")).alias("sd"),
                        less.alias("less"), (m * p + k * q).cast("double").alias("all"), (p + q).alias("n"))
    sums = sums.groupBy("a", "b").agg(F.sum("s").alias("s"), F.sum("sd").alias("sd"), *[F.max(c).alias(c) for c in ("less", "all", "n")])
    far = F.when(F.col("all") > F.col("s"), (F.col("all") - F.col("s")) * threshold * threshold).otherwise(0.0)
    return sums.where(F.col("sd") + far - F.col("less") < F.col("n") * (threshold * threshold * (1 + 1e-9))).select("a", "b")


def ward_merges(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec: str = "embedding", links: DataFrame | None = None) -> DataFrame:
    """(round, id1, id2, height, size): the merges of Ward's linkage below
    ``threshold``.  A cluster is named by its smallest id; ``id1 < id2`` merge
    at ``height`` into ``id1``, which then has ``size`` vectors.

    ``links`` may give the pairs (id1, id2) nearer than the threshold.  Null
    vectors take no part; ids must be unique.  Equal vectors are one cluster
    from the start (round 0, height 0), however many they are.  Of equal
    distances the pair with the smaller ids counts as nearer.  Heights never
    fall along a cluster's merges.  Rounds go on until no link is left: each
    merges at least the nearest pair of all.  Every round's tables go to the
    shared folder.
    """
    rounds = Rounds(vectors.sparkSession)
    points = vectors.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("centroid"))
    clusters = rounds.cut(points.groupBy("centroid").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")).select("id", "size", "centroid"))
    names = clusters.where(F.col("size") > 1).select("centroid", F.col("id").alias("a"))
    copies = rank_within(points.join(names, "centroid").where(F.col("id") != F.col("a")).select("a", "id"), ["a"], ["id"], "n")
    found, k = [rounds.cut(copies.select(F.lit(0).cast("long").alias("round"), F.col("a").alias("id1"), F.col("id").alias("id2"), F.lit(0.0).alias("height"),
                              (F.col("n") + 2).alias("size")))], 1
    if links is None:  # no pair comes twice, and its distance is there
        links = epsilon_pairs(clusters, threshold, "id", "centroid").select(F.col("id1").alias("a"), F.col("id2").alias("b"), F.col("distance").alias("d"))
        if not names.isEmpty():
            for end, n in (("a", "p"), ("b", "q")):
                links = links.join(clusters.where(F.col("size") > 1).select(F.col("id").alias(end), F.col("size").alias(n)), end, "left").fillna(1, [n])
            p, q = F.col("p"), F.col("q")
            links = links.select("a", "b", (F.sqrt(2 * p * q / (p + q)) * F.col("d")).alias("d"))
        links = rounds.cut(links.where(F.col("d") < threshold))
    else:
        links = links.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()
        links = rounds.cut(_measure(links, clusters, threshold))  # of the given ones, those of the first of equal vectors
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    clusters = rounds.cut(clusters.join(ends, "id", "left_semi"))  # the others merge with nothing
    while not links.isEmpty():
        best = _links_of_ends(links, ["d"])
        # a link that is the best of both its ends
        mutual = best.groupBy("best").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2).select("best.a", "best.b", "best.d")
        mutual = rounds.cut(mutual)
        one = clusters.select(F.col("id").alias("a"), F.col("size").alias("p"), F.col("centroid").alias("x"))
        two = clusters.select(F.col("id").alias("b"), F.col("size").alias("q"), F.col("centroid").alias("y"))
        mean = F.zip_with("x", "y", lambda u, v: (u * F.col("p") + v * F.col("q")) / (F.col("p") + F.col("q")))
        merged = rounds.cut(mutual.join(one, "a").join(two, "b").select("a", "b", "d", (F.col("p") + F.col("q")).alias("size"), mean.alias("centroid")))
        found.append(merged.select(F.lit(k).cast("long").alias("round"), F.col("a").alias("id1"), F.col("b").alias("id2"), F.col("d").alias("height"), "size"))
        moved = merged.select("d", "size", F.inline(F.array(F.struct(F.col("a").alias("old"), F.col("a").alias("new")), F.struct(F.col("b").alias("old"), F.col("a").alias("new")))))
        # of each cluster before the round: what it is now, the sizes before and now, the height of its merge and how many merged
        ends = rounds.cut(clusters.select(F.col("id").alias("old"), F.col("size").alias("was")).join(moved, "old", "left").select(
            "old", F.coalesce("new", "old").alias("new"), "was", F.coalesce("size", "was").alias("size"), F.col("d").alias("z"),
            F.when(F.col("new").isNull(), 1).otherwise(2).alias("k")))
        clusters = rounds.cut(clusters.join(moved.select(F.col("old").alias("id")), "id", "left_anti")
                                       .unionByName(merged.select(F.col("a").alias("id"), "size", "centroid")))
        for end in ("a", "b"):
            links = links.join(ends.select(F.col("old").alias(end), *[F.col(c).alias(f"_{c}_{end}") for c in ends.columns if c != "old"]), end)
        links = rounds.cut(links.where(F.col("_new_a") != F.col("_new_b")))
        same = (F.col("_k_a") == 1) & (F.col("_k_b") == 1)
        again = _measure(_may_be_near(links.where(~same), threshold), clusters, threshold)
        links = rounds.cut(links.where(same).select("a", "b", "d").unionByName(again))
        k += 1
    return rounds.close(reduce(DataFrame.unionByName, found))


def cut(vectors: DataFrame, merges: DataFrame, height: Column | str, below: float | None = None, id_col: str = "vec_id") -> DataFrame:
    """(id, cluster): the clusters of the merges of at most a height (all of
    them without one), each named by its smallest id."""
    kept = merges if below is None else merges.where((F.col(height) if isinstance(height, str) else height) <= below)
    return connected_components(vectors.select(id_col), kept.select("id1", "id2"), id_col)


# ------------------------------- single linkage -------------------------------

def _local_forest(batches):
    """The shortest spanning forest of a partition's links: a link that closes
    a cycle as its longest is in no shortest forest of all links."""
    rows: list[tuple] = []
    types = None
    for batch in batches:
        types = batch.schema
        rows += zip(*(batch.column(c).to_pylist() for c in ("distance", "id1", "id2")))
        if len(rows) > 1 << 20:
            rows = _kruskal(rows)
    if rows:
        d, a, b = map(list, zip(*_kruskal(rows)))
        yield pa.RecordBatch.from_arrays([pa.array(a, types.field("id1").type), pa.array(b, types.field("id2").type), pa.array(d, pa.float64())], ["id1", "id2", "distance"])


def _kruskal(rows: list[tuple]) -> list[tuple]:
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    kept = []
    for d, a, b in sorted(rows):
        x, y = root(a), root(b)
        if x != y:
            up[x] = y
            kept.append((d, a, b))
    return kept


def spanning_forest(links: DataFrame) -> DataFrame:
    """The links (id1 < id2, distance) of the shortest spanning forest; of
    equal distances that with the smaller ids counts as shorter, so that there
    is one such forest.  Each partition first drops what closes a cycle."""
    rounds = Rounds(links.sparkSession)
    kind = links.schema["id1"].dataType.simpleString()
    links = links.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "distance").where(F.col("id1") != F.col("id2"))
    left = rounds.cut(links.mapInArrow(_local_forest, f"id1 {kind}, id2 {kind}, distance double").withColumns({"a": F.col("id1"), "b": F.col("id2")}))
    found = []
    while not left.isEmpty():
        best = _links_of_ends(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", "id1", "id2"), ["distance", "id1", "id2"])
        taken = rounds.cut(best.select("best.*").distinct())
        found.append(taken.select("id1", "id2", "distance"))
        names = connected_components(taken.select(F.explode(F.array("a", "b")).alias("id")), taken.select(F.col("a").alias("id1"), F.col("b").alias("id2")), "id")
        names = rounds.cut(names)
        for end in ("a", "b"):
            left = left.join(names.withColumnsRenamed({"id": end, "cluster": f"_{end}"}), end)
        left = left.where(F.col("_a") != F.col("_b")).select("id1", "id2", "distance", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        left = rounds.cut(left.groupBy("a", "b").agg(F.min(F.struct("distance", "id1", "id2")).alias("l")).select("l.id1", "l.id2", "l.distance", "a", "b"))
    return rounds.close(reduce(DataFrame.unionByName, found, left.select("id1", "id2", "distance")))


def dendrogram(links: DataFrame) -> DataFrame:
    """(step, id1, id2, distance): the merges of single linkage over the given
    links in the order in which they happen; ``cut`` gives the clusters of any
    height.  The step is a position over range partitions, not a window."""
    return global_index(spanning_forest(links), ["distance", "id1", "id2"], "step").select("step", "id1", "id2", "distance")
