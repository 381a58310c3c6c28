"""Distance histogram, threshold pairs, single-linkage components."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cluster as cl
from tessera.operators import linkage as lk
from tessera.plans.catalog import register
from tessera.sources.tables import spread, table

EPS = 1.1

_DIST = """WITH d AS (
  SELECT a.vec_id AS id1, b.vec_id AS id2,
         sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
              lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"""


def _emb(spark, sf):
    return spread(table(spark, sf, "embeddings", ["vec_id", "embedding"]), "vec_id")


@register("distance_histogram", "J7 A16", _DIST + f"""
SELECT CAST(floor(distance * 20.0) AS BIGINT) AS bin, count(*) AS n FROM d WHERE distance <= {EPS} GROUP BY ALL""")
def distance_histogram(spark, sf):
    return cl.distance_histogram(_emb(spark, sf), EPS, width=0.05)


@register("epsilon_pairs", "J7", _DIST + f"""
SELECT id1, id2, round(distance, 6) AS distance FROM d WHERE distance <= {EPS}""")
def epsilon_pairs(spark, sf):
    p = cl.epsilon_pairs(_emb(spark, sf), EPS)
    return p.select("id1", "id2", F.round("distance", 6).alias("distance"))


_CC_SQL = f"""WITH RECURSIVE d AS (
  SELECT a.vec_id AS id1, b.vec_id AS id2,
         sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
              lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
e AS (SELECT id1 AS s, id2 AS t FROM d WHERE distance <= {EPS} UNION ALL SELECT id2, id1 FROM d WHERE distance <= {EPS}),
r(v, lab) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.t, r.lab FROM r JOIN e ON e.s = r.v)
SELECT v AS vec_id, min(lab) AS cluster FROM r GROUP BY v"""


@register("cluster_components", "C15 J7", _CC_SQL)
def cluster_components(spark, sf):
    emb = _emb(spark, sf)
    return cl.connected_components(emb.select("vec_id"), cl.epsilon_pairs(emb, EPS).select("id1", "id2"))


@register("cluster_size_profile", "C15", _CC_SQL.replace(
    "SELECT v AS vec_id, min(lab) AS cluster FROM r GROUP BY v",
    """, c AS (SELECT v, min(lab) AS cluster FROM r GROUP BY v),
s AS (SELECT cluster, count(*) AS size FROM c GROUP BY cluster)
SELECT size, count(*) AS n_clusters FROM s GROUP BY size"""))
def cluster_size_profile(spark, sf):
    comp = cluster_components(spark, sf)
    return cl.cluster_sizes(comp).groupBy("size").agg(F.count(F.lit(1)).alias("n_clusters"))


@register("ward_merges", "C15 Ward")
def ward_merges(spark, sf):
    """Merges of Ward's linkage below EPS."""
    return lk.ward_merges(_emb(spark, sf), EPS).select("id1", "id2", F.round("height", 6).alias("height"), "size")


@register("ward_clusters", "C15 Ward")
def ward_clusters(spark, sf):
    emb = _emb(spark, sf)
    return lk.cut(emb, lk.ward_merges(emb, EPS), "height")


@register("dendrogram_merges", "C15 J7 dendrogram", _DIST.replace("WITH d", "WITH RECURSIVE d") + f""",
e AS (SELECT id1, id2, distance, row_number() OVER (ORDER BY distance, id1, id2) AS k FROM d WHERE distance <= {EPS}),
r(k, v) AS (SELECT k, id1 FROM e UNION
  SELECT r.k, CASE WHEN f.id1 = r.v THEN f.id2 ELSE f.id1 END FROM r JOIN e f ON f.k < r.k AND (f.id1 = r.v OR f.id2 = r.v))
SELECT row_number() OVER (ORDER BY e.k) - 1 AS step, id1, id2, round(distance, 6) AS distance
FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = e.k AND r.v = e.id2)""")
def dendrogram_merges(spark, sf):
    """Merges of single linkage up to EPS, in their order."""
    return lk.dendrogram(cl.epsilon_pairs(_emb(spark, sf), EPS)).select("step", "id1", "id2", F.round("distance", 6).alias("distance"))


CUTS = (0.7, 0.9, EPS)


@register("dendrogram_cuts", "C15 dendrogram", _DIST.replace("WITH d", "WITH RECURSIVE d") + f""",
c AS (SELECT CAST(unnest([{', '.join(map(str, CUTS))}]) AS DOUBLE) AS threshold),
e AS (SELECT threshold, id1 AS s, id2 AS t FROM d JOIN c ON distance <= threshold UNION ALL SELECT threshold, id2, id1 FROM d JOIN c ON distance <= threshold),
r(threshold, v, lab) AS (SELECT threshold, vec_id, vec_id FROM embeddings, c UNION
  SELECT r.threshold, e.t, r.lab FROM r JOIN e ON e.threshold = r.threshold AND e.s = r.v)
SELECT threshold, v AS vec_id, min(lab) AS cluster FROM r GROUP BY ALL""")
def dendrogram_cuts(spark, sf):
    """The clusters at three thresholds, from one forest."""
    from functools import reduce

    from tessera.session import cut_lineage
    emb = _emb(spark, sf)
    forest = cut_lineage(lk.spanning_forest(cl.epsilon_pairs(emb, EPS)))
    cuts = [lk.cut(emb, forest, "distance", t).select(F.lit(t).alias("threshold"), "vec_id", "cluster") for t in CUTS]
    return reduce(lambda a, b: a.unionByName(b), cuts)
