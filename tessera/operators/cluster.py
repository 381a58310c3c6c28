"""Embedding distances, threshold pairs, single-linkage components and
entity blinding (J7 A16 C15 C16 P13 K7).

Threshold pairs are exact: vectors are dealt to the cells of pivots, those
near a border visit the cell behind it, and cells are compared in blocks of
bounded size with numpy; only pairs within the threshold leave a task.
Components are found by contraction of the threshold edges: a forest for each
partition, then star contraction, with the edges checkpointed to the shared
checkpoint folder each round (lineage stays short; a lost executor recomputes
one round), and one task once few edges are left.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import global_index
from tessera.session import Rounds, cut_lineage


#: Vectors a cell is meant to hold, most of either side in a task, and most
#: cells (pivots are broadcast).  Where cells lie close, a vector visits half of
#: them, and its cell is copied for each block of visitors: wide ones copy
#: little.  A task compares its rows tile by tile.
CELL, BLOCK, TILE, MOST_CELLS = 1 << 14, 1 << 15, 2048, 2048


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _visits(pivots: np.ndarray, eps: float):
    """For every vector its home (the nearest pivot's cell) and the lower
    cells it visits: those whose border with its home is within ``eps``."""
    gaps = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)) if len(pivots) <= 256 else None

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo:lo + 512]
                x = _matrix(part["_v"])
                d2 = np.maximum(0, (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T)
                home = d2.argmin(axis=1)
                gap = gaps[home] if gaps is not None else np.sqrt(((pivots[home][:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
                border = d2 - d2.min(axis=1, keepdims=True) <= 2 * gap * eps + 1e-6
                near = border & (np.arange(len(pivots)) < home[:, None])
                near[np.arange(len(x)), home] = True
                row, cell = np.nonzero(near)
                out = part.iloc[row].copy()
                out["_cell"], out["_home"] = cell.astype(np.int64), cell == home[row]
                yield out

    return run


def epsilon_pairs(df: DataFrame, eps: float, id_col: str = "vec_id", vec: str = "embedding",
                  block_rows: int = BLOCK, cell_rows: int = CELL) -> DataFrame:
    """All pairs (id1 < id2) with distance <= eps, exact.

    A vector lives in the cell of its nearest pivot.  If two vectors within
    ``eps`` have different homes, the border between these cells (the plane
    halfway between the pivots) separates them, so each is within ``eps`` of
    it; the one with the higher cell visits the other's.  How many cells a
    vector visits depends on the space around it, not on the number of rows.
    Home rows and visitors of a cell are cut into blocks of bounded size;
    every block of home rows meets those after it and every block of visitors.
    Null vectors have no pair; all vectors must have one length.
    """
    rows = cut_lineage(df.select(F.col(id_col).alias("_id"), F.col(vec).alias("_v")).where(F.col("_v").isNotNull()))
    n = rows.count()
    first = rows.orderBy(F.xxhash64("_id"), "_id").limit(max(1, min(MOST_CELLS, math.ceil(n / cell_rows)))).collect()
    if not first:
        return rows.select(F.col("_id").alias("id1"), F.col("_id").alias("id2"), F.lit(0.0).alias("distance"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.mapInPandas(_visits(_matrix([r["_v"] for r in first]), eps), f"{kinds}, _cell long, _home boolean")
    blocks = [F.greatest(F.ceil(F.count_if(c) / block_rows), F.lit(1)).cast("int").alias(k) for k, c in (("_homes", F.col("_home")), ("_visitors", ~F.col("_home")))]
    sizes = cut_lineage(dealt.groupBy("_cell").agg(*blocks))  # a row per cell; dealt again below, which is cheaper than to keep the copies
    dealt = dealt.join(F.broadcast(sizes), "_cell", "left").fillna(1, ["_homes", "_visitors"])
    at = F.pmod(F.xxhash64("_id"), F.when(F.col("_home"), F.col("_homes")).otherwise(F.col("_visitors"))).cast("int")
    dealt = dealt.withColumn("_block", at)
    # a place: block of home rows, and the one that it meets: of home rows (from 0) or of visitors (from -1 down)
    at, homes = F.col("_block"), F.sequence(F.lit(0), F.col("_homes") - 1)
    before = F.transform(F.filter(homes, lambda i: i <= at), lambda i: F.struct(i.alias("_bi"), at.alias("_bj")))
    after = F.transform(F.filter(homes, lambda j: j > at), lambda j: F.struct(at.alias("_bi"), j.alias("_bj")))
    guests = F.transform(F.sequence(F.lit(0), F.col("_visitors") - 1), lambda j: F.struct(at.alias("_bi"), (-1 - j).alias("_bj")))
    visits = F.transform(homes, lambda i: F.struct(i.alias("_bi"), (-1 - at).alias("_bj")))
    places = F.when(F.col("_home"), F.concat(before, after, guests)).otherwise(visits)
    spread = dealt.select("_id", "_v", "_cell", "_home", "_block", F.inline(places))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["_bi"].iloc[0]), int(pdf["_bj"].iloc[0])
        ids, x = pdf["_id"].to_numpy(), _matrix(pdf["_v"])
        home, blk = pdf["_home"].to_numpy(bool), pdf["_block"].to_numpy()
        a = np.flatnonzero(home & (blk == bi))
        b = np.flatnonzero(~home if bj < 0 else home & (blk == bj))
        sq, most = (x * x).sum(axis=1), eps * eps + 1e-6 * (1 + eps * eps)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for lo in range(0, len(a), TILE):
            for at in range(lo if bi == bj else 0, len(b), TILE):
                r, c = a[lo:lo + TILE], b[at:at + TILE]
                close = sq[r][:, None] + sq[c][None, :] - 2 * x[r] @ x[c].T <= most
                if bi == bj and lo == at:
                    close = np.triu(close, 1)
                i, j = np.nonzero(close)
                for k in range(0, len(i), 8192):
                    p, q = r[i[k:k + 8192]], c[j[k:k + 8192]]
                    d = np.sqrt(((x[p] - x[q]) ** 2).sum(axis=1))
                    found.append((p[d <= eps], q[d <= eps], d[d <= eps]))
        p, q, d = map(np.concatenate, zip(*found))
        p, q = ids[p], ids[q]
        return pd.DataFrame({"id1": np.minimum(p, q), "id2": np.maximum(p, q), "distance": d})

    return spread.groupBy("_cell", "_bi", "_bj").applyInPandas(near, "id1 long, id2 long, distance double")


def distance_histogram(df: DataFrame, eps: float, id_col: str = "vec_id", vec: str = "embedding",
                       width: float = 0.05) -> DataFrame:
    """Counts of the pairwise Euclidean distances up to ``eps`` per bin
    floor(d / width), over the exact threshold pairs."""
    scale = 1.0 / width
    return epsilon_pairs(df, eps, id_col, vec).groupBy(F.floor(F.col("distance") * scale).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def _edge_state(edges: DataFrame) -> tuple:
    """Row count and an order-free digest of an edge table (two scalars)."""
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


#: Edges up to this number (16 MB) are contracted by one task.
FEW_EDGES = 1 << 20


def _forest(batches):
    """A spanning forest of the edges, as (vertex, smallest vertex of its tree)."""
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        below = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(below, kind), pa.array(map(root, below), kind)], ["a", "b"])


def connected_components(vertices: DataFrame, edges: DataFrame, id_col: str = "vec_id", few: int = FEW_EDGES) -> DataFrame:
    """Label = smallest vertex id of the component (single linkage at the
    edge threshold).

    The edges of each partition become a spanning forest first, so that no
    other edge is written.  Up to ``few`` of these are contracted by one task;
    more are rewritten by
    alternating large-star and small-star steps until they are few or stop
    changing, with no round limit (the number of rounds grows with the
    logarithm of the graph).  Each round's edges go to the shared checkpoint
    folder.  Isolated vertices are their own component.  Joins on a hub vertex
    are plain equi-joins on shuffled sides, which AQE splits when skewed.
    """
    kind = edges.schema["id1"].dataType.simpleString()
    e = edges.select(F.greatest("id1", "id2").alias("a"), F.least("id1", "id2").alias("b")).where(F.col("a") != F.col("b"))
    e = cut_lineage(e.mapInArrow(_forest, f"a {kind}, b {kind}"))
    state = _edge_state(e)
    rounds = Rounds(edges.sparkSession) if state[0] > few else None
    while state[0] > few:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, "a").where(F.col("b") > F.col("a"))
                     .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = rounds.cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _edge_state(e)
        if state == before:
            break
    if rounds:
        e = rounds.close(e)
    if 0 < state[0] <= few:
        e = e.coalesce(1).mapInArrow(_forest, f"a {kind}, b {kind}")
    v = vertices.select(F.col(id_col)).distinct()
    return v.join(e.select(F.col("a").alias(id_col), F.col("b").alias("_root")), id_col, "left").select(
        id_col, F.coalesce("_root", id_col).alias("cluster"))


def cluster_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def blind_mentions(texts: DataFrame, mentions: DataFrame, key: str = "doc_id", text: str = "text",
                   mention: str = "mention", order: str = "start", token: str = "disease") -> DataFrame:
    """Replace every occurrence of each mention, sequentially in order of
    first mention, by ``token``.  Distinct mentions are grouped per document
    (bounded by the document's own) and folded with ``aggregate``."""
    once = mentions.groupBy(key, F.col(mention).alias("_w")).agg(F.min(order).alias("_at"))
    per = once.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "_w"))).alias("_m"))
    j = texts.join(per, key, "left")
    blinded = F.aggregate(F.coalesce(F.col("_m"), F.array().cast(per.schema["_m"].dataType)), F.col(text),
                          lambda acc, m: F.replace(acc, m["_w"], F.lit(token)))
    return j.withColumn(text, blinded).drop("_m")


def cluster_sections(components: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The lines of a text export as rows (cluster_no from 1, kind, key, line):
    a header "Cluster n", the members in key order, a blank line.  Sorted by
    (cluster_no, kind, key) they are the file; no cluster is held in one row."""
    numbers = global_index(components.select("cluster").distinct(), ["cluster"], "_n")
    numbers = numbers.select("cluster", (F.col("_n") + 1).alias("cluster_no"))
    ends = F.array(F.struct(F.lit(0).alias("kind"), F.concat(F.lit("Cluster "), F.col("cluster_no").cast("string")).alias("line")),
                   F.struct(F.lit(2).alias("kind"), F.lit("").alias("line")))
    frame = numbers.select("cluster_no", F.inline(ends)).select("cluster_no", "kind", F.lit(None).cast(components.schema[key].dataType).alias(key), "line")
    members = components.join(numbers, "cluster").join(texts.select(key, F.col(text).alias("line")), key)
    return frame.unionByName(members.select("cluster_no", F.lit(1).alias("kind"), key, "line"))
