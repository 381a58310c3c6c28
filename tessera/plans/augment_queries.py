"""Symmetric pairs, duplicate mining funnel, fold extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.arrays import once
from tessera.operators import augment as au
from tessera.operators import splits
from tessera.operators.cluster import blind_mentions as blind
from tessera.plans import derived
from tessera.plans import sqltext as sq
from tessera.plans.catalog import register
from tessera.plans.split_queries import _KFOLD_SQL, _folds


@register("symmetric_pairs", "P9 X1", sq.with_(sq.PAIRS_CONV) + """
SELECT conv_id, turn, CAST(0 AS BIGINT) AS mirrored, source, target FROM pairs_conv
UNION ALL SELECT conv_id, turn, CAST(1 AS BIGINT), target, source FROM pairs_conv""")
def symmetric_pairs(spark, sf):
    return au.symmetric_pairs(derived.pairs_conv(spark, sf), ["conv_id", "turn"])


def _dups(spark, sf):
    """Pairs of documents that share their first line, and of each line with
    itself and the next one (id2 < 0): duplicates of one and more sentences.
    Words and sentences are taken once per line, and for the documents only
    where they are paired."""
    docs = derived.documents(spark, sf).select("doc_id", tx.first_line("text").alias("_first"), F.lower("text").alias("t"))
    stars = au.star_pairs(docs, "doc_id", F.col("_first"), ["t"])
    stars = stars.select("id1", "id2", F.inline(F.array(au.pair_words("t_1", "t_2"))))
    lines = derived.documents(spark, sf).select("doc_id", au.line_words(F.lower("text")).alias("_l"))
    two = F.transform("_l", lambda x, i: F.struct(x.alias("a"), F.get(F.col("_l"), i + 1)["w"].alias("w")))
    lines = lines.select("doc_id", F.posexplode(F.filter(two, lambda p: p["w"].isNotNull())).alias("i", "p"))
    runs = lines.select(
        F.col("doc_id").alias("id1"), (-1 - F.col("i")).cast("long").alias("id2"),
        F.col("p.a.w").alias("w_1"), F.array_union("p.a.w", "p.w").alias("w_2"), F.col("p.a.n").alias("n_1"), F.col("p.a.n_next").alias("n_2"))
    pairs = stars.select("id1", "id2", "w_1", "w_2", "n_1", "n_2").unionByName(runs)
    dup = au.jaccard_at_least(F.col("w_1"), F.col("w_2"), 1, 2).cast("long")
    return pairs.select("id1", "id2", F.col("n_1").alias("num_sent_1"), F.col("n_2").alias("num_sent_2"), once(is_duplicate=dup))


_DUP_SQL = f"""WITH fl AS (SELECT doc_id, text, ({sq.lines('text')})[1] AS k, {sq.lines('text')} AS l FROM documents),
rep AS (SELECT k, min(doc_id) AS rep FROM fl WHERE k IS NOT NULL GROUP BY k),
dp AS (SELECT r.rep AS id1, f.doc_id AS id2, r1.text AS q1, f.text AS q2
       FROM fl f JOIN rep r USING (k) JOIN fl r1 ON r1.doc_id = r.rep WHERE f.doc_id <> r.rep
       UNION ALL SELECT doc_id, -i, l[i], l[i] || ' ' || l[i + 1]
       FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM fl)),
ws AS (SELECT *, list_distinct({sq.ws_tokens('lower(q1)')}) AS a, list_distinct({sq.ws_tokens('lower(q2)')}) AS b FROM dp),
dups AS (SELECT id1, id2, q1, q2,
       CAST(len(list_intersect(a, b)) * 2 >= (len(a) + len(b) - len(list_intersect(a, b)))
            AND (len(a) + len(b) - len(list_intersect(a, b))) > 0 AS BIGINT) AS is_duplicate FROM ws),
st AS (SELECT *, len({sq.sentences('q1')}) AS n1, len({sq.sentences('q2')}) AS n2 FROM dups)"""


@register("duplicate_pairs", "P8", _DUP_SQL + "\nSELECT id1, id2, is_duplicate FROM dups")
def duplicate_pairs(spark, sf):
    return _dups(spark, sf).select("id1", "id2", "is_duplicate")


@register("mine_augmentation", "C2 F1 F2 F3 P6 P7 P8", _DUP_SQL + """
SELECT id1, id2, n1 AS num_sent_1, n2 AS num_sent_2, abs(n1 - n2) AS sent_diff,
       CASE WHEN n1 < n2 THEN id2 ELSE id1 END AS source_id,
       CASE WHEN n1 < n2 THEN id1 ELSE id2 END AS target_id
FROM st WHERE is_duplicate = 1 AND abs(n1 - n2) >= 1 AND (n1 = 1 OR n2 = 1)""")
def mine_augmentation(spark, sf):
    m = au.mine(_dups(spark, sf))
    return m.select("id1", "id2", "num_sent_1", "num_sent_2", "sent_diff",
                    F.when(F.col("_swapped"), F.col("id2")).otherwise(F.col("id1")).alias("source_id"),
                    F.when(F.col("_swapped"), F.col("id1")).otherwise(F.col("id2")).alias("target_id"))


@register("mine_augmentation_multi", "C2 F1 F2 P6 P7 P8", _DUP_SQL + """
SELECT id1, id2, n1 AS num_sent_1, n2 AS num_sent_2, abs(n1 - n2) AS sent_diff,
       CASE WHEN n1 < n2 THEN id2 ELSE id1 END AS source_id,
       CASE WHEN n1 < n2 THEN id1 ELSE id2 END AS target_id
FROM st WHERE is_duplicate = 1 AND abs(n1 - n2) >= 1""")
def mine_augmentation_multi(spark, sf):
    """Same miner with the single-sentence condition switched off."""
    m = au.mine(_dups(spark, sf), require_single=False)
    return m.select("id1", "id2", "num_sent_1", "num_sent_2", "sent_diff",
                    F.when(F.col("_swapped"), F.col("id2")).otherwise(F.col("id1")).alias("source_id"),
                    F.when(F.col("_swapped"), F.col("id1")).otherwise(F.col("id2")).alias("target_id"))


@register("hard_pairs", "F4", _DUP_SQL + """
SELECT id1, id2, abs(n1 - n2) AS sent_diff FROM st
WHERE is_duplicate = 1 AND abs(n1 - n2) >= 3 AND (n1 = 1 OR n2 = 1)""")
def hard_pairs(spark, sf):
    return au.mine(_dups(spark, sf), min_diff=3).select("id1", "id2", "sent_diff")


@register("funnel_counts", "A14", _DUP_SQL + """
SELECT count(*) AS n_read, CAST(count_if(is_duplicate = 1) AS BIGINT) AS n_duplicate,
       CAST(count_if(is_duplicate = 1 AND abs(n1 - n2) >= 1) AS BIGINT) AS n_sent_diff,
       CAST(count_if(is_duplicate = 1 AND abs(n1 - n2) >= 1 AND (n1 = 1 OR n2 = 1)) AS BIGINT) AS n_one_sentence
FROM st""")
def funnel_counts(spark, sf):
    return au.funnel_counts(_dups(spark, sf))


_EXT_SQL = _KFOLD_SQL + ", " + _DUP_SQL.replace("WITH ", "", 1) + """,
ext AS (SELECT id1, id2 FROM st WHERE is_duplicate = 1 AND abs(n1 - n2) >= 1 AND (n1 = 1 OR n2 = 1))"""


@register("extend_folds", "C3 J9 X1", _EXT_SQL + """,
tot AS (SELECT count(*) AS n FROM f), e AS (SELECT count(*) AS n FROM ext)
SELECT fold, tot.n - count(*) AS n_base_train, e.n AS n_extension, tot.n - count(*) + e.n AS n_train
FROM f, tot, e GROUP BY fold, tot.n, e.n""")
def extend_folds(spark, sf):
    return splits.fold_train_sizes(_folds(spark, sf), au.mine(_dups(spark, sf)), k=10)


@register("extended_fold_rows", "C3 J9 X1 T6", _EXT_SQL + f""",
tr AS (SELECT CAST(doc_id AS VARCHAR) AS id, FALSE AS extension, {sq.seeded_hash("('0-' || doc_id)", 42)} AS h FROM f WHERE fold <> 0
       UNION ALL SELECT id1 || ':' || id2, TRUE, {sq.seeded_hash("('1-' || id1 || ':' || id2)", 42)} FROM ext),
held AS (SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS pos FROM f WHERE fold = 0)
SELECT 'train' AS part, row_number() OVER (ORDER BY h, extension, id) - 1 AS pos, id, extension FROM tr
UNION ALL SELECT 'val', pos, id, FALSE FROM held UNION ALL SELECT 'test', pos, id, FALSE FROM held""")
def extended_fold_rows(spark, sf):
    """Fold 0 with the mined pairs; ids are text, a pair's is ``id1:id2``."""
    mined = au.mine(_dups(spark, sf)).select(F.concat_ws(":", "id1", "id2").alias("doc_id"))
    folds = _folds(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string"))
    return splits.extended_fold(folds, mined, 0, "doc_id")


# mentions: the words of ten and more letters of each text, scored by a hash
_MENTIONS = f"""m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[a-z]{{10,}}')) AS mention FROM documents),
ms AS (SELECT doc_id, mention, ({sq.seeded_hash('mention', 5)} % 1000) / 1000.0::DOUBLE AS score FROM m)"""


def _mentions(spark, sf):
    m = derived.documents(spark, sf).select("doc_id", F.explode(F.array_distinct(
        F.regexp_extract_all("text", F.lit("[a-z]{10,}"), F.lit(0)))).alias("mention"))
    return m.withColumn("score", (splits.seeded_hash("mention", 5) % 1000) / F.lit(1000.0))


@register("entity_filter", "F5", _DUP_SQL + ", " + _MENTIONS + """,
hit AS (SELECT DISTINCT doc_id FROM ms WHERE score > 0.99)
SELECT id1, id2, id1 IN (SELECT doc_id FROM hit) OR id2 IN (SELECT doc_id FROM hit) AS has_entity FROM dups WHERE id2 >= 0""")
def entity_filter(spark, sf):
    pairs = _dups(spark, sf).where(F.col("id2") >= 0).select("id1", "id2")
    return au.has_entity(pairs, _mentions(spark, sf), threshold=0.99)


@register("blind_mentions", "P13", "WITH " + _MENTIONS + """,
g AS (SELECT doc_id, list(mention ORDER BY mention) AS ms FROM ms WHERE score > 0.5 GROUP BY doc_id)
SELECT doc_id, CASE WHEN ms IS NULL THEN text ELSE list_reduce(list_prepend(text, ms), lambda t, x: replace(t, x, 'disease')) END AS text
FROM documents LEFT JOIN g USING (doc_id)""")
def blind_mentions(spark, sf):
    m = _mentions(spark, sf).where(F.col("score") > 0.5)
    return blind(derived.documents(spark, sf), m, order="mention")
