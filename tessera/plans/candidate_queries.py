"""Candidate numbering, ROUGE per candidate, oracle selection, spread,
relative / binary labels, reranker inputs (W1 B1 B2 C8 A5 A6 W2 W3 W7 C5 C6 C7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rouge as rg
from tessera.functions import text as tx
from tessera.operators import candidates as cd
from tessera.operators import extractive as ex
from tessera.plans import derived
from tessera.plans import sqltext as sq
from tessera.plans.catalog import register

R = 6
_BASE = sq.with_(sq.DOC_LINES, sq.DOC_CANDS)
_KEYS = ["sample_id", "cand_rank"]


@register("candidate_ids", "W1 W13", sq.with_(sq.DOC_LINES) + """
SELECT doc_id, line_no, (o // 5) AS sample_id, (o % 5) AS cand_rank FROM (
  SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS o FROM doc_lines)""")
def candidate_ids(spark, sf):
    return cd.number_flat_candidates(cd.materialize(derived.doc_lines(spark, sf), ["doc_id", "line_no"]),
                                     ["doc_id", "line_no"], per_sample=5)


@register("top1_candidate", "W1", sq.with_(sq.DOC_LINES) + """
SELECT doc_id, line_no, o // 5 AS sample_id FROM (
  SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS o FROM doc_lines)
WHERE o % 5 = 0""")
def top1_candidate(spark, sf):
    return candidate_ids(spark, sf).where(F.col("cand_rank") == 0).drop("cand_rank")


def _rouge_query_sql(n: int) -> str:
    p = "(CASE WHEN np > 0 THEN m / np ELSE 0.0 END)"
    r = "(CASE WHEN nr > 0 THEN m / nr ELSE 0.0 END)"
    return (_BASE + ", " + sq.rouge_n_ctes("doc_cands", _KEYS, "text", "gold", n, "rn") + f"""
SELECT sample_id, cand_rank, round({p}, {R}) AS r{n}_p, round({r}, {R}) AS r{n}_r,
       round({sq.f1('m', 'np', 'nr')}, {R}) AS r{n}_f
FROM rn""")


def _rouge_n_frame(spark, sf, n):
    c = derived.doc_candidate_tokens(spark, sf)
    return _rounded(c, rg.rouge_n(F.col("pt"), F.col("rt"), n), f"r{n}")


def _rounded(c, score, name):
    """The three parts of one score, computed once per row."""
    return c.select(*_KEYS, F.inline(F.array(score))).select(
        *_KEYS, *[F.round(x, R).alias(f"{name}_{x}") for x in ("p", "r", "f")])


@register("rouge1_scores", "B1", _rouge_query_sql(1))
def rouge1_scores(spark, sf):
    return _rouge_n_frame(spark, sf, 1)


@register("rouge2_scores", "B1", _rouge_query_sql(2))
def rouge2_scores(spark, sf):
    return _rouge_n_frame(spark, sf, 2)


_RL_SQL = _BASE + f""", t AS (SELECT sample_id, cand_rank, {sq.alnum_tokens('text')} AS pt,
                  {sq.alnum_tokens('gold')} AS rt FROM doc_cands),
l AS (SELECT sample_id, cand_rank, len(pt) AS np, len(rt) AS nr, {sq.lcs_len('pt', 'rt')} AS m FROM t)"""


@register("rouge_l_scores", "B2", _RL_SQL + f"""
SELECT sample_id, cand_rank, round(CASE WHEN np > 0 THEN m / np ELSE 0.0 END, {R}) AS rl_p,
       round(CASE WHEN nr > 0 THEN m / nr ELSE 0.0 END, {R}) AS rl_r,
       round({sq.f1('m', 'np', 'nr')}, {R}) AS rl_f FROM l""")
def rouge_l_scores(spark, sf):
    c = derived.doc_candidate_tokens(spark, sf)
    return _rounded(c, rg.rouge_l(F.col("pt"), F.col("rt")), "rl")


def _scored(spark, sf, metric="rouge2", stem=False):
    return cd.score_candidates(derived.doc_candidates(spark, sf), metric, stem=stem)


_R2_SCORED = _BASE + ", " + sq.rouge_n_ctes("doc_cands", _KEYS, "text", "gold", 2, "rn") + f""",
s AS (SELECT sample_id, cand_rank, c.text, round(100 * {sq.f1('m', 'np', 'nr')}, 4) AS score
      FROM rn JOIN doc_cands c USING (sample_id, cand_rank))"""


@register("select_best", "C8 J3 A6 T1", _R2_SCORED + """
SELECT sample_id, cand_rank, text, score FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_rank) AS k FROM s)
WHERE k = 1""")
def select_best(spark, sf):
    return cd.pick_best(_scored(spark, sf), payload=["text"])


@register("candidate_spread", "A5 W7", _R2_SCORED + """,
per AS (SELECT sample_id, count(*) AS n, var_samp(score) AS v, max(score) AS best FROM s GROUP BY sample_id),
sec AS (SELECT sample_id, score AS second FROM (
  SELECT sample_id, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC) AS k FROM s) WHERE k = 2),
x AS (SELECT v, sqrt(v) AS sd, best - second AS gap FROM per JOIN sec USING (sample_id) WHERE n >= 2)
SELECT count(*) AS n_ids,
  round(avg(v), 6) AS mean_var, round(min(v), 6) AS min_var, round(max(v), 6) AS max_var,
  round(avg(sd), 6) AS mean_std_dev, round(min(sd), 6) AS min_std_dev, round(max(sd), 6) AS max_std_dev,
  round(avg(gap), 6) AS mean_dist_12, round(min(gap), 6) AS min_dist_12, round(max(gap), 6) AS max_dist_12
FROM x""")
def candidate_spread(spark, sf):
    return cd.score_spread(cd.materialize(_scored(spark, sf), [*_KEYS, "score"]))


_RL_SCORED = _RL_SQL + f""",
s AS (SELECT sample_id, cand_rank, round(100 * {sq.f1('m', 'np', 'nr')}, 4) AS score FROM l),
mx AS (SELECT sample_id, max(score) AS mx FROM s GROUP BY sample_id)"""


@register("relative_labels", "C5 C7 W2", _RL_SCORED + """
SELECT sample_id, cand_rank, score, CASE WHEN mx = 0 THEN 0.0 ELSE score / mx END AS label
FROM s JOIN mx USING (sample_id)""")
def relative_labels(spark, sf):
    s = cd.materialize(_scored(spark, sf, "rougeL"), [*_KEYS, "score"])
    return cd.relative_labels(s)


@register("binary_labels", "C5 W3", _RL_SCORED + """
SELECT sample_id, cand_rank, score, CAST(CASE WHEN score = mx THEN 1.0 ELSE 0.0 END AS DOUBLE) AS label
FROM s JOIN mx USING (sample_id)""")
def binary_labels(spark, sf):
    s = cd.materialize(_scored(spark, sf, "rougeL"), [*_KEYS, "score"])
    return cd.relative_labels(s, binary=True)


def _extracted(spark, sf):
    """The five most central sentences of every document."""
    docs = derived.documents(spark, sf).select(F.col("doc_id").alias("sample_id"), tx.sentences("text").alias("sentences"))
    return ex.extract(docs, 5, "sample_id")


_SENT_SQL = f"""se AS (SELECT doc_id AS id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS j FROM (SELECT doc_id, {sq.sentences('text')} AS l FROM documents)),
tk AS (SELECT id, j, unnest({sq.alnum_tokens('text')}) AS w FROM se),
tc AS (SELECT id, j, w, CAST(count(*) AS DOUBLE) AS c FROM tk GROUP BY ALL),
tn AS (SELECT id, j, w, c / sqrt(sum(c * c) OVER (PARTITION BY id, j)) AS x FROM tc),
lk AS (SELECT a.id, a.j AS i, b.j, sum(a.x * b.x) AS s FROM tn a JOIN tn b ON a.id = b.id AND a.w = b.w AND a.j <> b.j GROUP BY ALL),
dg AS (SELECT id, i, sum(s) AS d FROM lk GROUP BY ALL),
nd AS (SELECT id, count(*) AS n FROM se GROUP BY id),
x0 AS (SELECT id, j, 1.0 / n AS x FROM se JOIN nd USING (id)),
""" + ",\n".join(f"""x{k + 1} AS (SELECT se.id, se.j, {1 - ex.DAMPING} / n + {ex.DAMPING} * coalesce(v, 0.0) AS x FROM se JOIN nd USING (id)
  LEFT JOIN (SELECT lk.id, lk.j, sum(s * x / d) AS v FROM lk JOIN x{k} p ON p.id = lk.id AND p.j = lk.i JOIN dg ON dg.id = lk.id AND dg.i = lk.i GROUP BY ALL) u USING (id, j))"""
                          for k in range(ex.STEPS)) + f""",
rk AS (SELECT id AS sample_id, row_number() OVER (PARTITION BY id ORDER BY round(x, 9) DESC, j) - 1 AS cand_rank, j AS sentence_no, round(x, 9) AS score FROM x{ex.STEPS})"""


@register("extractive_candidates", "U4 W1 D6", "WITH " + _SENT_SQL + f"""
SELECT sample_id, cand_rank, sentence_no, round(score, {R}) AS score FROM rk WHERE cand_rank < 5""")
def extractive_candidates(spark, sf):
    return _extracted(spark, sf).select("sample_id", "cand_rank", "sentence_no", F.round("score", R).alias("score"))


@register("extractive_run", "U4 C8 C9 B1")
def extractive_run(spark, sf):
    """Central sentences as candidates: of each document the one nearest to
    its first line by ROUGE-2, beside what centrality alone would take."""
    gold = derived.doc_gold(spark, sf).select("sample_id", "gold")
    scored = cd.score_candidates(cd.attach_gold(_extracted(spark, sf).withColumnRenamed("score", "central"), gold), "rouge2", stem=False)
    scored = cd.materialize(scored, [*_KEYS, "central", "score"])
    first = scored.where(F.col("cand_rank") == 0).select("sample_id", F.col("score").alias("central_score"))
    return cd.pick_best(scored, payload=()).join(first, "sample_id").select("sample_id", "cand_rank", "score", "central_score")


@register("rerank_inputs", "C6 J2", _BASE + f""", g AS (
  SELECT doc_id AS sample_id, {sq.strip('text')} AS source FROM documents)
SELECT c.sample_id, c.cand_rank, g.source, c.text AS candidate, CAST(0.0 AS DOUBLE) AS label
FROM doc_cands c JOIN g USING (sample_id)""")
def rerank_inputs(spark, sf):
    c = derived.doc_candidates(spark, sf, with_source=True)
    return c.select(*_KEYS, tx.strip("source").alias("source"), F.col("text").alias("candidate"),
                    F.lit(0.0).alias("label"))
