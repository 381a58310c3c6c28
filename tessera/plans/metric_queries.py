"""Corpus ROUGE / BLEU, bootstrap intervals, ROUGE-Lsum, stemmed ROUGE,
first-word agreement, score-time normalisation (B1-B5 B9 A10 T4 P19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import metrics as mt
from tessera.plans import derived
from tessera.plans import sqltext as sq
from tessera.plans.catalog import register

R = 6
_KEYS = ["sample_id", "cand_rank"]
_ALL = sq.with_(sq.DOC_LINES, sq.DOC_CANDS)


def _pairs(spark, sf):
    """Every candidate against its gold."""
    return derived.doc_candidates(spark, sf).select(
        *_KEYS, F.col("text").alias("pred"), F.col("gold").alias("ref"))


@register("corpus_rouge", "B4", _ALL + ", " + sq.rouge_n_ctes("doc_cands", _KEYS, "text", "gold", 1, "r1")
          + ", " + sq.rouge_n_ctes("doc_cands", _KEYS, "text", "gold", 2, "r2") + f""",
lt AS (SELECT sample_id, cand_rank, {sq.alnum_tokens('text')} AS pt, {sq.alnum_tokens('gold')} AS rt FROM doc_cands),
l AS (SELECT len(pt) AS np, len(rt) AS nr, {sq.lcs_len('pt', 'rt')} AS m FROM lt)
SELECT 'rouge1' AS metric, round(avg({sq.f1('m', 'np', 'nr')}) * 100, 4) AS value FROM r1
UNION ALL SELECT 'rouge2', round(avg({sq.f1('m', 'np', 'nr')}) * 100, 4) FROM r2
UNION ALL SELECT 'rougeL', round(avg({sq.f1('m', 'np', 'nr')}) * 100, 4) FROM l""")
def corpus_rouge(spark, sf):
    return mt.corpus_rouge(_pairs(spark, sf), stem=False)


def _bleu_sql() -> str:
    parts = [sq.ngram_match_ctes("doc_cands", _KEYS, sq.tokens_13a("text"), sq.tokens_13a("gold"), n, f"b{n}")
             for n in range(1, 5)]
    sums = ", ".join(f"sum(b{n}.m) AS m{n}, sum(greatest(b{n}.np, 0)) AS t{n}" for n in range(1, 5))
    joins = " ".join(f"JOIN b{n} USING (sample_id, cand_rank)" for n in range(2, 5))
    zs = []
    logs = []
    for n in range(1, 5):
        zs.append(f"(CASE WHEN m{n} = 0 THEN 1 ELSE 0 END)")
        z = " + ".join(zs)
        p = (f"(CASE WHEN t{n} = 0 THEN 0.0 WHEN m{n} = 0 THEN 100.0 / (pow(2.0, {z}) * t{n}) "
             f"ELSE 100.0 * m{n} / t{n} END)")
        logs.append(f"(CASE WHEN {p} > 0 THEN ln({p}) ELSE -9999999999.0 END)")
    bp = ("(CASE WHEN sys_len >= ref_len THEN 1.0 WHEN sys_len > 0 THEN exp(1.0 - ref_len / sys_len) "
          "ELSE 0.0 END)")
    return (_ALL + ", " + ", ".join(parts) + f""",
s AS (SELECT CAST(sum(b1.np) AS BIGINT) AS sys_len, CAST(sum(b1.nr) AS BIGINT) AS ref_len, {sums}
      FROM b1 {joins}),
s2 AS (SELECT sys_len, ref_len, {', '.join(f'CAST(m{n} AS BIGINT) AS m{n}, CAST(t{n} AS BIGINT) AS t{n}' for n in range(1, 5))} FROM s)
SELECT *, round({bp} * exp(({' + '.join(logs)}) / 4), 4) AS bleu, round({bp}, {R}) AS bp,
       round(sys_len / ref_len, {R}) AS ratio FROM s2""")


@register("corpus_bleu", "B5", _bleu_sql())
def corpus_bleu(spark, sf):
    return mt.corpus_bleu(_pairs(spark, sf))


_REPLICATES = 200


@register("bootstrap_rouge", "B4", _ALL + ", " + sq.rouge_n_ctes("doc_cands", _KEYS, "text", "gold", 1, "r1")
          + ", " + sq.rouge_n_ctes("doc_cands", _KEYS, "text", "gold", 2, "r2") + f""",
lt AS (SELECT sample_id, cand_rank, {sq.alnum_tokens('text')} AS pt, {sq.alnum_tokens('gold')} AS rt FROM doc_cands),
l AS (SELECT sample_id, cand_rank, len(pt) AS np, len(rt) AS nr, {sq.lcs_len('pt', 'rt')} AS m FROM lt),
f AS (SELECT {sq.seeded_hash("(sample_id || '-' || cand_rank)", 42)} % {mt.PRIME} AS h, {sq.f1('r1.m', 'r1.np', 'r1.nr')} AS a,
             {sq.f1('r2.m', 'r2.np', 'r2.nr')} AS b, {sq.f1('l.m', 'l.np', 'l.nr')} AS c
      FROM r1 JOIN r2 USING (sample_id, cand_rank) JOIN l USING (sample_id, cand_rank)),
g AS (SELECT range AS i, 1 + {sq.seeded_hash("('a' || range)", 42)} % {mt.PRIME - 1} AS x,
             {sq.seeded_hash("('c' || range)", 42)} % {mt.PRIME} AS y FROM range(1, {_REPLICATES + 1})),
w AS (SELECT i, a, b, c, len(list_filter({list(mt.POISSON)}, lambda t: t <= ((h * x + y) % {mt.PRIME}) / {mt.PRIME}.0::DOUBLE)) AS w FROM f, g),
s AS (SELECT i, sum(a * w) / sum(w) AS a, sum(b * w) / sum(w) AS b, sum(c * w) / sum(w) AS c FROM w GROUP BY i)
""" + " UNION ALL ".join(f"""SELECT '{name}' AS metric, round(quantile_cont({col}, 0.025) * 100, 4) AS low,
  round(quantile_cont({col}, 0.5) * 100, 4) AS mid, round(quantile_cont({col}, 0.975) * 100, 4) AS high FROM s"""
                        for name, col in (("rouge1", "a"), ("rouge2", "b"), ("rougeL", "c"))))
def bootstrap_rouge(spark, sf):
    p = _pairs(spark, sf).withColumn("key", F.concat_ws("-", *_KEYS))
    return mt.bootstrap_rouge(p, "key", replicates=_REPLICATES, seed=42, stem=False)


@register("bootstrap_rouge_exact", "B4 multinomial")
def bootstrap_rouge_exact(spark, sf):
    """Percentiles of the corpus scores over exact resamples of all pairs."""
    from tessera.operators import resampling
    return resampling.bootstrap_rouge(_pairs(spark, sf), _KEYS, replicates=_REPLICATES, seed=42, stem=False)


@register("rouge_lsum_scores", "B3 P6 P12")
def rouge_lsum_scores(spark, sf):
    """Every document's whole text against its gold line."""
    from tessera.functions import rouge as rg
    s = rg.rouge_lsum(F.col("source"), F.col("gold"))
    return derived.doc_gold(spark, sf).select("sample_id", F.inline(F.array(s))).select(
        "sample_id", F.round("p", R).alias("rlsum_p"), F.round("r", R).alias("rlsum_r"), F.round("f", R).alias("rlsum_f"))


@register("rouge_stemmed", "B1 stemmed")
def rouge_stemmed(spark, sf):
    """Stemmed ROUGE-1/2 per candidate; each document's lines are tokenised
    and stemmed once (before candidates fan out), not once per candidate."""
    from tessera.functions import rouge as rg
    from tessera.functions.stem import stem_nested_udf
    docs = derived.documents(spark, sf).select(
        F.col("doc_id").alias("sample_id"),
        F.transform(tx.non_empty_lines("text"), lambda l: tx.alnum_tokens(l)).alias("_toks"))
    docs = docs.where(F.size("_toks") > 0).select("sample_id", stem_nested_udf("_toks").alias("_st"))
    c = docs.select("sample_id", F.get(F.col("_st"), 0).alias("rt"),
                    F.posexplode(F.slice(F.col("_st"), 2, F.greatest(F.size("_st") - 1, F.lit(1))))
                     .alias("cand_rank", "pt")).withColumn("cand_rank", F.col("cand_rank").cast("long"))
    r1, r2 = rg.rouge_n(F.col("pt"), F.col("rt"), 1), rg.rouge_n(F.col("pt"), F.col("rt"), 2)
    return c.select(*_KEYS, F.round(r1["f"], R).alias("r1_f"), F.round(r2["f"], R).alias("r2_f"))


_FW = _ALL + f""", fw AS (SELECT {sq.first_word('gold')} AS g, {sq.first_word('text')} AS p FROM doc_cands)"""


def _first_words(spark, sf):
    t = _pairs(spark, sf)
    return t.select(tx.first_word("ref").alias("g"), tx.first_word("pred").alias("p"))


@register("first_word_agreement", "A10 T4", _FW + """
SELECT CASE WHEN g = p THEN g ELSE g || '=' || p END AS key,
       CAST(g = p AS BIGINT) AS correct, count(*) AS n
FROM fw GROUP BY ALL""")
def first_word_agreement(spark, sf):
    fw = _first_words(spark, sf)
    key = F.when(F.col("g") == F.col("p"), F.col("g")).otherwise(F.concat_ws("=", "g", "p"))
    return fw.groupBy(key.alias("key"), (F.col("g") == F.col("p")).cast("long").alias("correct")) \
             .agg(F.count(F.lit(1)).alias("n"))


@register("first_word_accuracy", "A10", _FW + f"""
SELECT count(*) AS n, CAST(sum(CAST(g = p AS INT)) AS BIGINT) AS n_correct,
       round(avg(CAST(g = p AS DOUBLE)), {R}) AS accuracy FROM fw""")
def first_word_accuracy(spark, sf):
    fw = _first_words(spark, sf)
    ok = (F.col("g") == F.col("p"))
    return fw.agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("long")).alias("n_correct"),
                  F.round(F.avg(ok.cast("double")), R).alias("accuracy"))


@register("normalize_text", "P19", f"""
SELECT doc_id, {sq.normalize('text')} AS text_norm FROM documents""")
def normalize_text(spark, sf):
    return derived.documents(spark, sf).select("doc_id", tx.normalize_text("text").alias("text_norm"))


@register("generated_length", "A12 P15", _ALL + f""", g AS (SELECT {sq.ws_tokens('text')} AS t FROM doc_cands)
SELECT 'gen_len' AS metric, round(avg(len(list_filter(t[1:20], lambda x: x <> 'a'))), 1) AS value FROM g""")
def generated_length(spark, sf):
    """The mean length of generated texts cut to twenty tokens, without a
    token that stands for padding."""
    from tessera.operators import batching as bt
    rows = derived.doc_candidates(spark, sf).select(bt.truncate(tx.ws_tokens("text"), 20).alias("t"))
    return mt.mean_length(rows, "t", pad="a").select(F.lit("gen_len").alias("metric"), F.col("gen_len").alias("value"))
