"""Packing into optimal length buckets.

The lengths of all texts form one global histogram.  Dynamic programming over
it chooses the bucket widths that minimise the padding of the whole corpus;
inside each bucket, batches hold as many rows as fit the token budget when
each row is padded to the bucket's width.

The histogram of exact lengths is the only thing brought to the driver.  A
corpus of ``w`` words has at most ``sqrt(2 w) + 1`` different lengths (d of
them sum to d (d - 1) / 2 at least), and the programme takes time in proportion
to them: a bucket's cost is a line in the width that ends it, and the lower
hull of the lines gives the best beginning for every end in one sweep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import cut_lineage, read, slots, words_of

def best_widths(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Widths of at most ``buckets`` buckets with the least sum of width x
    rows, over ascending ``lengths``.  Exact; of equal solutions the one with
    the fewest buckets, then the smallest lower bounds, is taken."""
    if not lengths:
        return []
    n, below = len(lengths), [0]
    for c in counts:
        below.append(below[-1] + c)
    cost, cut = [[0] + [None] * n], []
    for _ in range(min(buckets, n)):
        last, now, at = cost[-1], [None] * (n + 1), [0] * (n + 1)
        hull: list[int] = []  # beginnings i whose line last[i] - below[i] * width is lowest somewhere
        best = 0
        for j in range(1, n + 1):
            if (c := last[j - 1]) is not None:
                i = j - 1
                while len(hull) > 1:
                    a, b = hull[-2], hull[-1]
                    # the new line crosses a's no later than b's does
                    if (c - last[a]) * (below[b] - below[a]) > (last[b] - last[a]) * (below[i] - below[a]):
                        break
                    hull.pop()
                hull.append(i)
                best = min(best, len(hull) - 1)
            if not hull:
                continue
            w = lengths[j - 1]
            while best + 1 < len(hull) and last[hull[best + 1]] - below[hull[best + 1]] * w < last[hull[best]] - below[hull[best]] * w:
                best += 1
            at[j] = hull[best]
            now[j] = last[at[j]] + w * (below[j] - below[at[j]])
        cost.append(now)
        cut.append(at)
    k = min((i for i in range(1, len(cost)) if cost[i][n] is not None), key=lambda i: (cost[i][n], i))
    widths, j = [], n
    while k:
        widths.append(int(lengths[j - 1]))
        j, k = cut[k - 1][j], k - 1
    return widths[::-1]


def pack(docs: DataFrame, buckets: int = 8, budget: int = 16384, key: str = "doc_id", text: str = "text",
         length: Column | None = None) -> DataFrame:
    """``key``, n_tokens, bucket, width, batch_id, batch_slot, pad_tokens.

    ``length`` is the length of a row (default: words of its text, 0 for null
    and empty texts).  A batch holds ``budget // width`` rows, at least one,
    so a text beyond the budget is alone.  Batches are numbered without gaps,
    rows lie in them by key; rows with equal keys lie next to each other.  An
    empty table gives an empty result; other columns are not read.
    """
    if buckets < 1 or budget < 1:
        raise ValueError("buckets and budget must be positive")
    n = F.size(words_of(F.col(text))) if length is None else F.coalesce(length, F.lit(0))
    rows = cut_lineage(docs.select(F.col(key), n.cast("long").alias("n_tokens")))
    found = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow()  # the different lengths
    hist = sorted(zip(found["n_tokens"].to_pylist(), found["n"].to_pylist()))
    widths = best_widths([g for g, _ in hist], [c for _, c in hist], buckets)
    low, first, bucket, width, per, offset = -1, 0, F.lit(0), F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(0).cast("long")
    for b, w in enumerate(widths):  # at most ``buckets`` branches
        fits, here = F.col("n_tokens") > low, max(1, budget // max(w, 1))
        bucket, width = F.when(fits, b).otherwise(bucket), F.when(fits, F.lit(w).cast("long")).otherwise(width)
        per, offset = F.when(fits, F.lit(here).cast("long")).otherwise(per), F.when(fits, F.lit(first).cast("long")).otherwise(offset)
        first += -(-sum(c for g, c in hist if low < g <= w) // here)
        low = w
    placed = slots(rows.select(key, "n_tokens", bucket.cast("int").alias("bucket")), "bucket", [key], "_slot")
    return placed.select(
        key, "n_tokens", "bucket", width.alias("width"),
        (offset + F.floor(F.col("_slot") / per)).cast("long").alias("batch_id"),
        (F.col("_slot") % per).cast("int").alias("batch_slot"),
        (width - F.col("n_tokens")).cast("long").alias("pad_tokens"))


def batch_rows(packed: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each batch: batch_id, width and its texts in order.  Keys
    must be unique.  A batch has at most the budget's words, or one text."""
    rows = packed.join(docs.select(F.col(key), F.col(text).alias("_text")), key)
    rows = rows.groupBy("batch_id", "width").agg(F.sort_array(F.collect_list(F.struct("batch_slot", key, "_text"))).alias("_rows"))
    return rows.select("batch_id", "width", F.transform("_rows", lambda r: r[key]).alias("keys"),
                       F.transform("_rows", lambda r: r["_text"]).alias("texts"))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n FROM documents),
h AS (SELECT n AS w, count(*) AS c, row_number() OVER (ORDER BY n) AS j FROM d GROUP BY n),
b AS (SELECT j, w, sum(c) OVER (ORDER BY j) AS below FROM h),
dp(k, j, below, cost, widths) AS (
  SELECT 0, CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT x.k + 1, x.j, x.b_below, x.cost, x.widths FROM (
    SELECT dp.k, b.j, b.below AS b_below, dp.cost + b.w * (b.below - dp.below) AS cost, list_append(dp.widths, b.w) AS widths,
           row_number() OVER (PARTITION BY b.j ORDER BY dp.cost + b.w * (b.below - dp.below), dp.j) AS r
    FROM dp JOIN b ON b.j > dp.j WHERE dp.k < 8) x WHERE x.r = 1),
best AS (SELECT widths FROM dp WHERE j = (SELECT max(j) FROM b) ORDER BY cost, k LIMIT 1),
bk AS (SELECT unnest(widths) AS width, generate_subscripts(widths, 1) - 1 AS bucket FROM best),
a AS (SELECT doc_id, n, bucket, width, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS slot,
             greatest(1, 16384 // greatest(width, 1)) AS per
      FROM (SELECT d.*, bk.bucket, bk.width, row_number() OVER (PARTITION BY d.doc_id ORDER BY bk.width) AS r FROM d JOIN bk ON bk.width >= d.n) WHERE r = 1),
o AS (SELECT bucket, sum(nb) OVER (ORDER BY bucket) - nb AS first FROM (
  SELECT bucket, CAST(ceil(count(*) / any_value(per)) AS BIGINT) AS nb FROM a GROUP BY bucket))
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(bucket AS INT) AS bucket, CAST(width AS BIGINT) AS width,
       CAST(first + slot // per AS BIGINT) AS batch_id, CAST(slot % per AS INT) AS batch_slot, CAST(width - n AS BIGINT) AS pad_tokens
FROM a JOIN o USING (bucket)"""
