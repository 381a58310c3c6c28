"""Batching, sharding, chunking, padding and packing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import batching as bt
from tessera.plans import derived
from tessera.plans import sqltext as sq
from tessera.plans.catalog import register
from tessera.session import cut_lineage

_NW = f"""WITH d AS (SELECT doc_id, len({sq.ws_tokens('text')}) AS n_words FROM documents)"""


def _nw(spark, sf):
    """Ids and lengths, written once: ordering samples its input first."""
    return cut_lineage(derived.documents(spark, sf).select("doc_id", tx.word_count("text").alias("n_words")))


@register("length_batches", "W8", _NW + """
SELECT doc_id, n_words, (row_number() OVER (ORDER BY n_words DESC, doc_id) - 1) // 8 AS batch_id FROM d""")
def length_batches(spark, sf):
    return bt.length_batches(_nw(spark, sf), "doc_id", "n_words", 8)


@register("sortish_batches", "W9 T8", _NW + f""",
p AS (SELECT doc_id, n_words, (row_number() OVER (ORDER BY {sq.seeded_hash('doc_id', 42)}, doc_id) - 1) // 400 AS chunk FROM d),
r AS (SELECT doc_id, n_words, (chunk * 400 + row_number() OVER (PARTITION BY chunk ORDER BY n_words DESC, doc_id) - 1) // 8 AS batch_id FROM p),
b AS (SELECT batch_id, max(n_words) AS mx FROM r GROUP BY batch_id),
lead AS (SELECT batch_id FROM b ORDER BY mx DESC, batch_id LIMIT 1),
o AS (SELECT batch_id, row_number() OVER (ORDER BY {sq.seeded_hash('batch_id', 43)}, batch_id) AS batch_pos
      FROM b WHERE batch_id NOT IN (SELECT batch_id FROM lead)
      UNION ALL SELECT batch_id, 0 FROM lead)
SELECT doc_id, n_words, batch_id, batch_pos FROM r JOIN o USING (batch_id)""")
def sortish_batches(spark, sf):
    return bt.sortish_batches(_nw(spark, sf), "doc_id", "n_words", 8, seed=42)


@register("padding_waste", "A15 W8", _NW + """,
s AS (SELECT n_words, (row_number() OVER (ORDER BY n_words DESC, doc_id) - 1) // 8 AS b FROM d),
f AS (SELECT n_words, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS b FROM d),
ws AS (SELECT b, max(n_words) * count(*) - sum(n_words) AS w FROM s GROUP BY b),
wf AS (SELECT b, max(n_words) * count(*) - sum(n_words) AS w FROM f GROUP BY b)
SELECT 'length_sorted' AS scheme, count(*) AS n_batches, CAST(sum(w) AS BIGINT) AS pad_tokens FROM ws
UNION ALL SELECT 'file_order', count(*), CAST(sum(w) AS BIGINT) FROM wf""")
def padding_waste(spark, sf):
    nw = _nw(spark, sf)
    a = bt.padding_waste(bt.length_batches(nw, "doc_id", "n_words", 8), "batch_id", "n_words")
    b = bt.padding_waste(bt.chunks(nw, ["doc_id"], 8, "batch_id"), "batch_id", "n_words")
    return a.select(F.lit("length_sorted").alias("scheme"), "*").unionByName(
        b.select(F.lit("file_order").alias("scheme"), "*"))


@register("round_robin_shards", "W11", """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents),
n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, o % 4 AS shard, CAST(0 AS BIGINT) AS is_padding FROM o
UNION ALL
SELECT doc_id, (o + n) % 4, CAST(1 AS BIGINT) FROM o, n WHERE o < ((n + 3) // 4) * 4 - n""")
def round_robin_shards(spark, sf):
    return bt.round_robin_shards(derived.documents(spark, sf, ("doc_id",)), "doc_id", 4)


@register("chunks", "W13", """
SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS chunk_id FROM documents""")
def chunks(spark, sf):
    return bt.chunks(derived.documents(spark, sf, ("doc_id",)), ["doc_id"], 16)


_GT = sq.with_(sq.DOC_LINES, sq.DOC_GOLD) + f""", gt AS (
  SELECT sample_id, {sq.alnum_tokens('gold')} AS tok FROM doc_gold)"""


@register("truncate_pad", "P15 P16 P17", _GT + """,
tp AS (SELECT sample_id, tok[1:8] AS t FROM gt),
pd AS (SELECT sample_id, CASE WHEN len(t) < 8 THEN list_concat(t, list_transform(range(8 - len(t)), lambda x: '<pad>')) ELSE t END AS p FROM tp)
SELECT sample_id, array_to_string(p, ' ') AS input_tokens,
       array_to_string(list_concat(['<s>'], p[1:len(p) - 1]), ' ') AS decoder_tokens FROM pd""")
def truncate_pad(spark, sf):
    g = derived.doc_gold(spark, sf).select("sample_id", tx.alnum_tokens("gold").alias("tok"))
    p = bt.pad_to(bt.truncate(F.col("tok"), 8), 8, "<pad>")
    return g.select("sample_id", F.array_join(p, " ").alias("input_tokens"),
                    F.array_join(bt.shift_right(p, "<s>"), " ").alias("decoder_tokens"))


_TRIM = _GT + """,
b AS (SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN tok ELSE list_concat(['<pad>', '<pad>'], tok) END AS tok,
             (row_number() OVER (ORDER BY len(tok) DESC, sample_id) - 1) // 8 AS batch_id FROM gt),
c AS (SELECT batch_id, sample_id, generate_subscripts(tok, 1) AS i, unnest(tok) AS t FROM b),
k AS (SELECT batch_id, list_sort(list(DISTINCT i)) AS kept FROM c WHERE t <> '<pad>' GROUP BY batch_id)"""


@register("trim_batch", "F8 W8 P16", _TRIM + """
SELECT sample_id, batch_id, CAST(coalesce(len(kept), 0) AS BIGINT) AS width,
       coalesce(array_to_string(list_transform(kept, lambda i: coalesce(tok[i], '<pad>')), ' '), '') AS tokens
FROM b LEFT JOIN k USING (batch_id)""")
def trim_batch(spark, sf):
    """Batches of eight by length; two of three rows are padded on the left,
    so a batch without a row that starts at once has all-pad columns in front."""
    g = cut_lineage(derived.doc_gold(spark, sf).select("sample_id", tx.alnum_tokens("gold").alias("tok")))
    batched = bt.length_batches(g.withColumn("n", F.size("tok")), "sample_id", "n", 8)
    left = F.concat(F.array(F.lit("<pad>"), F.lit("<pad>")), F.col("tok"))
    padded = batched.withColumn("tok", F.when(F.col("sample_id") % 3 == 0, F.col("tok")).otherwise(left))
    return bt.trim_batch(padded, "batch_id", "tok", "<pad>").select(
        "sample_id", "batch_id", "width", F.array_join("tok", " ").alias("tokens"))


@register("token_budget_batches", "W10 T8", "WITH RECURSIVE " + _NW.replace("WITH ", "", 1) + f""",
o AS (SELECT doc_id, least(n_words, 142) AS n_tokens,
             row_number() OVER (ORDER BY least(n_words, 142) DESC, doc_id) - 1 AS o FROM d),
f AS (SELECT *, greatest(1024 // greatest(n_tokens, 1), 1) AS fits, count(*) OVER () AS n FROM o),
x AS (SELECT *, CASE WHEN o + fits >= n THEN n ELSE o + greatest((fits // 64) * 64, fits % 64) END AS nxt FROM f),
s(o, nxt) AS (SELECT o, nxt FROM x WHERE o = 0 UNION ALL SELECT x.o, x.nxt FROM s JOIN x ON x.o = s.nxt),
b AS (SELECT o, nxt, row_number() OVER (ORDER BY o) - 1 AS batch_id FROM s),
r AS (SELECT x.doc_id, x.n_tokens, b.batch_id FROM x JOIN b ON x.o >= b.o AND x.o < b.nxt),
c AS (SELECT batch_id, max(n_tokens) * count(*) AS cost FROM r GROUP BY batch_id),
l AS (SELECT batch_id FROM c ORDER BY cost DESC, batch_id LIMIT 1),
p AS (SELECT batch_id, row_number() OVER (ORDER BY CASE WHEN batch_id IN (SELECT batch_id FROM l) THEN -1
             ELSE {sq.seeded_hash('batch_id', 42)} END, batch_id) - 1 AS batch_pos FROM c)
SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, batch_id, batch_pos FROM r JOIN p USING (batch_id)""")
def token_budget_batches(spark, sf):
    d = _nw(spark, sf).withColumn("n_tokens", F.least(F.col("n_words"), F.lit(142)).cast("long"))
    return bt.token_budget_batches(d.select("doc_id", "n_tokens"), "doc_id", "n_tokens", max_tokens=1024)


_PACKS = "WITH RECURSIVE " + sq.PAIRS_CONV + f""",
o AS (SELECT source, target, len({sq.ws_tokens('source')}) AS sl, len({sq.ws_tokens('target')}) AS tl,
             row_number() OVER (ORDER BY conv_id, turn) - 1 AS o FROM pairs_conv),
c AS (SELECT *, sum(sl) OVER w AS ss, sum(tl) OVER w AS ts FROM o WINDOW w AS (ORDER BY o)),
x AS (SELECT a.o, greatest(a.o + 1, least(
        (SELECT count(*) FROM c b WHERE b.ss <= a.ss - a.sl + 128), (SELECT count(*) FROM c b WHERE b.ts <= a.ts - a.tl + 128))) AS nxt FROM c a),
s(o, nxt) AS (SELECT o, nxt FROM x WHERE o = 0 UNION ALL SELECT x.o, x.nxt FROM s JOIN x ON x.o = s.nxt),
k AS (SELECT o AS first_ord, nxt, row_number() OVER (ORDER BY o) - 1 AS pack_id FROM s),
m AS (SELECT k.pack_id, k.first_ord, c.* FROM k JOIN c ON c.o >= k.first_ord AND c.o < k.nxt)"""


def _pairs(spark, sf):
    return derived.pairs_conv(spark, sf).select(
        "conv_id", "turn", "source", "target", tx.word_count("source").alias("sl"), tx.word_count("target").alias("tl"))


@register("pack_pairs", "W12 C18", _PACKS + """
SELECT pack_id, first_ord, count(*) AS n_pairs, CAST(sum(sl) AS BIGINT) AS src_tokens, CAST(sum(tl) AS BIGINT) AS tgt_tokens
FROM m GROUP BY pack_id, first_ord""")
def pack_pairs(spark, sf):
    return bt.pack_pairs(_pairs(spark, sf).drop("source", "target"), ["conv_id", "turn"], "sl", "tl", max_tokens=128)


@register("packed_texts", "W12 C18", _PACKS + """
SELECT pack_id, count(*) AS n_pairs, string_agg(source, ' ' ORDER BY o) AS source, string_agg(target, ' ' ORDER BY o) AS target
FROM m GROUP BY pack_id""")
def packed_texts(spark, sf):
    return bt.packed_texts(_pairs(spark, sf), ["conv_id", "turn"], "sl", "tl", max_tokens=128)
