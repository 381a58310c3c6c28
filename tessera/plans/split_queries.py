"""Stratified folds / splits, hold-out views, shuffles, minify."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import splits
from tessera.plans import derived
from tessera.plans import sqltext as sq
from tessera.plans.catalog import register
from tessera.sources.tables import table

_KFOLD_SQL = f"""WITH l AS (SELECT doc_id, quality, toxic, {sq.seeded_hash('doc_id', 42)} AS h FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY h, doc_id) - 1 AS rn FROM l),
s AS (SELECT quality, toxic, count(*) AS n FROM l GROUP BY ALL),
o AS (SELECT quality, toxic, coalesce(sum(n) OVER (ORDER BY quality, toxic
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s),
f AS (SELECT r.doc_id, r.quality, r.toxic, CAST((o.off + r.rn) % 10 AS BIGINT) AS fold
      FROM r JOIN o USING (quality, toxic))"""


def _folds(spark, sf):
    return splits.stratified_folds(table(spark, sf, "labels", ["doc_id", "quality", "toxic"]),
                                   "doc_id", ["quality", "toxic"], k=10, seed=42)


@register("stratified_kfold", "W5", _KFOLD_SQL + "\nSELECT * FROM f")
def stratified_kfold(spark, sf):
    return _folds(spark, sf)


@register("fold_sizes", "W5 A1", _KFOLD_SQL + """
SELECT fold, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_quality, CAST(sum(toxic) AS BIGINT) AS n_toxic FROM f GROUP BY fold""")
def fold_sizes(spark, sf):
    return _folds(spark, sf).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("n_quality"),
        F.sum("toxic").cast("long").alias("n_toxic"))


@register("fold_train_view", "X4 X1", _KFOLD_SQL + """
SELECT doc_id, fold, CASE WHEN fold % 10 = 9 THEN 'test' ELSE 'train' END AS part FROM f""")
def fold_train_view(spark, sf):
    return _folds(spark, sf).select("doc_id", "fold", splits.holdout_split("fold", 10, 9).alias("part"))


@register("stratified_split", "W6", f"""
WITH d AS (SELECT doc_id, lang, source, {sq.seeded_hash('doc_id', 7)} AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) - 1 AS rn,
             count(*) OVER (PARTITION BY lang, source) AS n FROM d)
SELECT doc_id, lang, source, CASE WHEN rn < round(0.5 * n) THEN 'train' ELSE 'val' END AS split FROM r""")
def stratified_split(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "lang", "source"])
    return splits.stratified_split(docs, "doc_id", ["lang", "source"], frac=0.5, seed=7)


@register("shuffle_order", "T6", f"""
SELECT doc_id, row_number() OVER (ORDER BY {sq.seeded_hash('doc_id', 42)}, doc_id) - 1 AS shuffle_pos
FROM documents""")
def shuffle_order(spark, sf):
    return splits.shuffle_positions(table(spark, sf, "documents", ["doc_id"]), "doc_id", 42)


@register("minify", "T2", """
SELECT doc_id, source, pos FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
  FROM documents) WHERE pos < 3""")
def minify(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "source"])
    return splits.first_n_per_group(docs, ["source"], ["doc_id"], 3)
