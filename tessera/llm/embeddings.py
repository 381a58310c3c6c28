"""Embedding near-duplicates: spherical k-means cells, blocked cosines.

Vectors are compared only inside cells, and yet no link is lost.  A pair with
cosine ``t`` or more is at most ``r = sqrt(2 - 2t)`` apart on the unit sphere,
so if two such vectors have different home cells, the one of the cell with the
larger number lies within ``r`` of the hyperplane between the two centres; it
visits the other's cell, unless the distances from the centres show that
no vector of that cell can be within ``r``.  The visit rule holds for any
centres, therefore a rough k-means (fitted on a bounded sample) costs time at
most, never links.

Equal vectors are one entry with a number of copies.  A cell of any size is
cut into blocks, a task multiplies two blocks of bounded size, and passes on
sums of links and a spanning star per local component, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import cut_lineage, read, sliced
from tessera.operators.cluster import connected_components

#: Vectors of a label that a cell is meant to hold, and most cells; with more
#: vectors the cells grow, and are compared in more blocks.
CELL, MOST_CELLS = 8192, 4096
#: The k-means sees at most about this many vectors for each cell, in so many parts at most.
SAMPLE_PER_CELL, SAMPLE_PARTS = 64, 16
#: Up to so many cells, a table of distances from all centres narrows the visits.
PIVOTS = 512
BLOCK = 2048


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def centres(vectors: DataFrame, dims: int, cells: int, rounds: int = 4) -> np.ndarray:
    """Centres of spherical k-means over at most ``cells * SAMPLE_PER_CELL``
    vectors (fewer than that are all used), chosen by a hash of their ids.
    Rounds run over the sample in Spark; the driver gets sums for each cell."""
    n = vectors.count()
    if cells == 1 or not n:
        return np.zeros((min(n, 1), dims))
    share = min(1.0, cells * SAMPLE_PER_CELL / n)
    ranked = vectors.withColumn("_h", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)))
    sample = cut_lineage(ranked.where(F.col("_h") < int(share * (1 << 30)) + 1).coalesce(SAMPLE_PARTS))
    first = sample.orderBy("_h", "_id").limit(cells).select("_vec").collect()
    c = _unit(np.array([r["_vec"] for r in first], np.float64))
    for _ in range(rounds):
        def sums(batches, c=c):
            total, seen = np.zeros(c.shape), np.zeros(len(c), bool)
            for batch in batches:
                x = _unit(_matrix(batch.column(0), dims)) if batch.num_rows else np.zeros((0, dims))
                home = (x @ c.T).argmax(axis=1)
                np.add.at(total, home, x)
                seen[home] = True
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([seen.tobytes()])], ["total", "seen"])

        total, seen = np.zeros(c.shape), np.zeros(len(c), bool)
        for r in sample.select("_vec").mapInArrow(sliced(sums), "total binary, seen binary").toLocalIterator():  # a row for each of few parts
            total += np.frombuffer(r["total"]).reshape(c.shape)
            seen |= np.frombuffer(r["seen"], bool)
        c = _unit(np.where(seen[:, None] & (np.abs(total).max(axis=1, keepdims=True) > 0), total, c))
    return c


def _home(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosines with all centres, home cells, and distances from all centres."""
    sims = x @ c.T
    return sims, sims.argmax(axis=1), np.sqrt(np.maximum(0, 2 - 2 * sims))


def reach(vectors: DataFrame, c: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray] | None:
    """For each cell the least and greatest distance of its vectors from every
    centre; none for one cell, or so many that the table would be large."""
    if not 1 < len(c) <= PIVOTS:
        return None

    def span(batches):
        low, high = np.full((len(c), len(c)), np.inf), np.full((len(c), len(c)), -np.inf)
        for batch in batches:
            if batch.num_rows:
                _, home, d = _home(_unit(_matrix(batch.column(0), dims)), c)
                np.minimum.at(low, home, d)
                np.maximum.at(high, home, d)
        at = np.flatnonzero(np.isfinite(low[:, 0]))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([x.tobytes() for x in low[at]], pa.binary()), pa.array([x.tobytes() for x in high[at]], pa.binary())],
                                         ["cell", "low", "high"])

    def joined(table: pa.Table) -> pa.Table:
        low = np.min([np.frombuffer(x) for x in table["low"].to_pylist()], axis=0)
        high = np.max([np.frombuffer(x) for x in table["high"].to_pylist()], axis=0)
        return pa.table({"cell": table["cell"].slice(0, 1), "low": pa.array([low.tobytes()]), "high": pa.array([high.tobytes()])})

    low, high = np.full((len(c), len(c)), np.inf), np.full((len(c), len(c)), -np.inf)
    found = vectors.select("_vec").mapInArrow(sliced(span), "cell long, low binary, high binary")
    for r in found.groupBy("cell").applyInArrow(joined, "cell long, low binary, high binary").toLocalIterator():  # a row for each cell
        low[r["cell"]], high[r["cell"]] = np.frombuffer(r["low"]), np.frombuffer(r["high"])
    return low, high


def _visits(c: np.ndarray, dims: int, radius: float, spans: tuple[np.ndarray, np.ndarray] | None):
    """For every vector its home cell, and the lower cells that it visits:
    those whose border with its home is within ``radius``, and that have
    vectors as far from every centre as it is, give or take ``radius``."""
    gaps = np.sqrt(np.maximum(0, ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))) if len(c) <= 512 else None

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = _unit(_matrix(part.column("_vec"), dims))
                sims, home, d = _home(x, c)
                gap = gaps[home] if gaps is not None else np.sqrt(np.maximum(0, 2 - 2 * c[home] @ c.T))
                near = (sims.max(axis=1, keepdims=True) - sims <= radius * gap + 1e-9) & (np.arange(len(c)) < home[:, None])
                if spans is not None:
                    row, cell = np.nonzero(near)
                    near[row, cell] = ((d[row] >= spans[0][cell] - radius - 1e-9) & (d[row] <= spans[1][cell] + radius + 1e-9)).all(axis=1)
                near[np.arange(len(x)), home] = True
                row, cell = np.nonzero(near)
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int64)), pa.array(cell == home[row])],
                                                 [*out.schema.names, "_cell", "_home"])

    return run


def _linked(threshold: float, dims: int):
    """Links between the home rows of one block and the rows of another."""
    def stars(adj: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray):
        """(first, other) for each further member of a component."""
        left_a, left_b = adj.any(axis=1), adj.any(axis=0)
        for i in np.flatnonzero(left_a):
            if not left_a[i]:
                continue
            new_a, all_a, all_b = np.array([i]), [i], []
            left_a[i] = False
            while len(new_a):
                new_b = np.flatnonzero(adj[new_a].any(axis=0) & left_b)
                left_b[new_b] = False
                all_b.extend(new_b)
                new_a = np.flatnonzero(adj[:, new_b].any(axis=1) & left_a)
                left_a[new_a] = False
                all_a.extend(new_a)
            for x in {*ids_a[all_a].tolist(), *ids_b[all_b].tolist()} - {ids_a[i]}:
                yield ids_a[i], x

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["_bi"].iloc[0]), int(pdf["_bj"].iloc[0])
        ids, copies = pdf["_id"].to_numpy(), pdf["_n"].to_numpy(np.int64)
        home, blk = pdf["_home"].to_numpy(bool), pdf["_block"].to_numpy()
        x = np.stack(pdf["_vec"].to_numpy()).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        a = np.flatnonzero(home & (blk == bi))
        b = np.flatnonzero((blk == bj) & (~home | (bi <= bj)))
        if not len(a) or not len(b):
            return pd.DataFrame({"id1": [], "id2": [], "links": []})
        adj = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= threshold
        if bi == bj:
            adj &= ~(home[b][None, :] & (a[:, None] >= b[None, :]))  # each pair of home rows once, no row with itself
        of_a, of_b = adj @ copies[b], copies[a] @ adj
        hit_a, hit_b = of_a > 0, of_b > 0
        pairs = list(stars(adj, ids[a], ids[b]))
        return pd.DataFrame({
            "id1": np.concatenate([ids[a][hit_a], ids[b][hit_b], np.array([p for p, _ in pairs], np.int64)]),
            "id2": pd.array([None] * int(hit_a.sum() + hit_b.sum()) + [q for _, q in pairs], "Int64"),
            "links": np.concatenate([of_a[hit_a], of_b[hit_b], np.zeros(len(pairs), np.int64)])})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vec: str = "embedding",
                 label: str = "label", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``key``, n_links, component_id, kept of every row.

    Two rows are linked if their labels are equal and not null and the cosine
    of their vectors, in double precision, is ``threshold`` or more.  Null and
    zero vectors, vectors with null or non-finite components and rows without
    a key link with nothing and are kept; vectors of different lengths aren't
    compared.  Equal vectors of a label are linked.  Rows that repeat a key
    are vectors of their own, each with its links and component (equal ones
    are copies); all rows with the smallest key of a component are kept.  An
    empty table gives an empty result; other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    v = F.col(vec)
    valid = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    valid = valid & F.col(label).isNotNull() & F.col(key).isNotNull()
    rows = vectors.select(F.col(key).alias("_id"), F.col(label).alias("_label"), v.alias("_vec"), valid.alias("_valid"))
    # -0.0 and 0.0 are one value in a grouping and in a join
    classes = rows.where("_valid").groupBy("_label", "_vec").agg(F.min("_id").alias("_key"), F.count(F.lit(1)).alias("_n"))
    classes = cut_lineage(classes.withColumns({"_dims": F.size("_vec"), "_id": F.monotonically_increasing_id()}))
    sizes = classes.groupBy("_dims", "_label").agg(F.count(F.lit(1)).alias("n")).groupBy("_dims").agg(F.max("n").alias("n"))
    found = None
    for r in sorted(sizes.collect()):  # a row for each length of vectors
        own = classes.where(F.col("_dims") == r["_dims"]).select("_label", "_vec", "_id", "_n")
        cells = max(1, min(MOST_CELLS, math.ceil(r["n"] / cell)))
        links = _compared(own, centres(own, r["_dims"], cells), r["_dims"], threshold, block)
        found = links if found is None else found.unionByName(links)
    if found is None:
        linked = classes.select("_id", F.lit(0).cast("long").alias("_links"), F.col("_key").alias("_low"))
    else:
        found = cut_lineage(found)
        sums = found.where(F.col("id2").isNull()).groupBy(F.col("id1").alias("_id")).agg(F.sum("links").alias("_sum"))
        groups = connected_components(classes.select("_id"), found.where(F.col("id2").isNotNull()).select("id1", "id2"), "_id")
        groups = cut_lineage(groups.join(classes.select("_id", "_key", "_n"), "_id"))
        low = groups.groupBy("cluster").agg(F.min("_key").alias("_low"))
        linked = groups.join(low, "cluster").join(sums, "_id", "left").select(
            "_id", (F.coalesce("_sum", F.lit(0)) + F.col("_n") - 1).cast("long").alias("_links"), "_low")
    of = classes.select("_label", "_vec", "_id").join(linked, "_id").drop("_id")
    out = rows.where("_valid").join(of, ["_label", "_vec"]).select("_id", "_links", "_low")
    out = out.unionByName(rows.where(~F.col("_valid")).select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_low")))
    return out.select(F.col("_id").alias(key), F.col("_links").alias("n_links"), F.col("_low").alias("component_id"),
                      F.col("_id").eqNullSafe(F.col("_low")).alias("kept"))


def _compared(classes: DataFrame, c: np.ndarray, dims: int, threshold: float, block: int) -> DataFrame:
    """id1, id2, links over vectors of one length: sums of links (id2 null)
    and spanning links."""
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-9
    schema = ", ".join(f"{n} {k}" for n, k in kinds.items())
    dealt = classes.mapInArrow(sliced(_visits(c, dims, radius, reach(classes, c, dims))), f"{schema}, _cell long, _home boolean")
    dealt = cut_lineage(dealt)
    sizes = dealt.groupBy("_label", "_cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = dealt.join(sizes, ["_label", "_cell"]).withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    at, all_blocks = F.col("_block"), F.sequence(F.lit(0), F.col("_blocks") - 1)
    # a row is the left side of (its block, any block) if at home, and the right side of (any block, its block)
    as_left = F.transform(all_blocks, lambda j: F.struct(at.alias("_bi"), j.alias("_bj")))
    as_right = F.transform(all_blocks, lambda i: F.struct(i.alias("_bi"), at.alias("_bj")))
    upper = F.filter(as_right, lambda p: p["_bi"] <= p["_bj"])
    places = F.when(F.col("_home"), F.array_union(as_left, upper)).otherwise(as_right)
    spread = dealt.select("*", F.inline(places)).drop("_blocks")
    return spread.groupBy("_label", "_cell", "_bi", "_bj").applyInPandas(_linked(threshold, dims), "id1 long, id2 long, links long")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.a),
c AS (SELECT a AS vec_id, min(low) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""
