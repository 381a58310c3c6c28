"""Rerank, scorer evaluation, threshold metrics, fold roll-up, leaderboard,
negative sampling (U3 C9 C10 A7-A9 A17 A4 C11 J8 T5 J6 C4 F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rouge as rg
from tessera.functions import text as tx
from tessera.functions.arrays import once
from tessera.operators import candidates as cd
from tessera.operators import evaluation as ev
from tessera.operators import negatives as ng
from tessera.operators import splits
from tessera.operators.ordering import global_index
from tessera.operators.scorer import fit_scorer, predict_best, score_pairs
from tessera.plans import derived
from tessera.plans import sqltext as sq
from tessera.plans.catalog import register
from tessera.session import cut_lineage
from tessera.sources.tables import table

R = 6
_KEYS = ["sample_id", "cand_rank"]
_BASE = sq.with_(sq.DOC_LINES, sq.DOC_CANDS)


def _lex_sql(src: str, cand: str) -> str:
    s = f"list_distinct({sq.ws_tokens(f'lower({src})')})"
    c = f"list_distinct({sq.ws_tokens(f'lower({cand})')})"
    return f"round(coalesce(len(list_intersect({c}, {s})) / nullif(len({s}), 0), 0.0), {R})"


def _lex_scored(spark, sf):
    docs = derived.documents(spark, sf).select(
        F.col("doc_id").alias("sample_id"),
        F.array_distinct(tx.lower_ws_tokens("text")).alias("_sw"),
        tx.non_empty_lines("text").alias("_lines"))
    c = docs.select("sample_id", "_sw", F.get(F.col("_lines"), 0).alias("gold"),
                    F.posexplode(F.slice(F.col("_lines"), 2, F.greatest(F.size("_lines") - 1, F.lit(1))))
                     .alias("cand_rank", "text")).withColumn("cand_rank", F.col("cand_rank").cast("long"))
    return c.select("sample_id", "cand_rank", "text", "gold", once(score=ev.lexical_share(F.col("_sw"), "text")))


_LEX = _BASE + f""", lex AS (
  SELECT c.sample_id, c.cand_rank, c.text, c.gold, {_lex_sql('d.text', 'c.text')} AS score
  FROM doc_cands c JOIN documents d ON d.doc_id = c.sample_id)"""


@register("rerank", "U3 C9 A6 T1", _LEX + """
SELECT sample_id, cand_rank, text, score FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_rank) AS k FROM lex)
WHERE k = 1""")
def rerank(spark, sf):
    return ev.rerank(_lex_scored(spark, sf))


@register("evaluate_scorer", "C10 A7 A8 A9 W2", _LEX + f""",
t AS (SELECT sample_id, cand_rank, score, {sq.alnum_tokens('text')} AS pt, {sq.alnum_tokens('gold')} AS rt FROM lex),
l AS (SELECT sample_id, cand_rank, score, len(pt) AS np, len(rt) AS nr, {sq.lcs_len('pt', 'rt')} AS m FROM t),
s AS (SELECT sample_id, cand_rank, score, round(100 * {sq.f1('m', 'np', 'nr')}, 4) AS rl FROM l),
mx AS (SELECT sample_id, max(rl) AS mx FROM s GROUP BY sample_id),
ex AS (SELECT s.sample_id, s.cand_rank, s.score, CASE WHEN mx = 0 THEN 0.0 ELSE rl / mx END AS label
       FROM s JOIN mx USING (sample_id)),
ch AS (SELECT sample_id, label AS chosen FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_rank) AS k FROM ex) WHERE k = 1),
b AS (SELECT sample_id, max(label) AS best FROM ex GROUP BY sample_id),
cr AS (SELECT rl FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_rank) AS k FROM s) WHERE k = 1)
SELECT (SELECT count(*) FROM b) AS n_ids, (SELECT round(avg(rl), 4) FROM cr) AS chosen_rouge_l,
       (SELECT count(*) FROM b JOIN ch USING (sample_id) WHERE chosen = best AND best > 0) AS num_best_target,
       (SELECT round(avg(pow(score - label, 2)), {R}) FROM ex) AS mse""")
def evaluate_scorer(spark, sf):
    s = _lex_scored(spark, sf)
    s = cd.score_candidates(s.withColumnRenamed("score", "lex"), "rougeL", name="rl", stem=False)
    s = cd.materialize(s, [*_KEYS, "lex", "rl"])
    ex = cd.relative_labels(s, score="rl").select(*_KEYS, F.col("lex").alias("score"), "label", "rl")
    return ev.evaluate_scorer(cd.materialize(ex, [*_KEYS, "score", "label", "rl"]), chosen={"rl": "chosen_rouge_l"})


_TTR = f"""WITH d AS (SELECT l.doc_id, l.quality AS label,
  round(len(list_distinct({sq.ws_tokens('lower(d.text)')})) / len({sq.ws_tokens('d.text')}), {R}) AS score
  FROM labels l JOIN documents d USING (doc_id))"""


@register("threshold_metrics", "A17", _TTR + f""",
g AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM d GROUP BY score),
tot AS (SELECT sum(pos) AS npos, sum(pos) + sum(neg) AS ntot FROM g),
c AS (SELECT score AS t, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g
      WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT c.t, pos, tp / (tp + fp) AS p, tp / npos AS r, (tp + (ntot - npos) - fp) / ntot AS acc FROM c, tot),
m2 AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM m),
bf AS (SELECT f1, p, r, t FROM m2 ORDER BY f1 DESC, t DESC LIMIT 1)
SELECT round(greatest((SELECT max(acc) FROM m2), (SELECT (ntot - npos) / ntot FROM tot)), {R}) AS accuracy,
       round(bf.f1, {R}) AS f1, round(bf.p, {R}) AS precision, round(bf.r, {R}) AS recall,
       round(bf.t, {R}) AS f1_threshold,
       round((SELECT sum(pos / (SELECT npos FROM tot) * p) FROM m2), {R}) AS average_precision
FROM bf""")
def threshold_metrics(spark, sf):
    lab = table(spark, sf, "labels", ["doc_id", "quality"])
    docs = derived.documents(spark, sf)
    d = lab.join(docs, "doc_id").select(
        F.col("quality").alias("label"),
        F.round(F.size(F.array_distinct(tx.lower_ws_tokens("text"))) / F.size(tx.ws_tokens("text")), R)
         .alias("score"))
    return ev.threshold_metrics(d)


def _doc_folds_sql() -> str:
    return f"""dl AS (SELECT doc_id, lang, {sq.seeded_hash('doc_id', 42)} AS h FROM documents),
dr AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) - 1 AS rn FROM dl),
ds AS (SELECT lang, count(*) AS n FROM dl GROUP BY lang),
dof AS (SELECT lang, coalesce(sum(n) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ds),
dfold AS (SELECT doc_id, CAST((off + rn) % 5 AS BIGINT) AS fold FROM dr JOIN dof USING (lang))"""


@register("aggregate_runs", "C11 A4 W5 B4", _BASE + """, """
          + sq.rouge_n_ctes("doc_cands", _KEYS, "text", "gold", 1, "r1") + ", "
          + sq.rouge_n_ctes("doc_cands", _KEYS, "text", "gold", 2, "r2") + ", " + _doc_folds_sql() + f""",
runs AS (
  SELECT fold, 'rouge1' AS metric, round(avg({sq.f1('m', 'np', 'nr')}) * 100, 4) AS value
  FROM r1 JOIN dfold ON dfold.doc_id = r1.sample_id GROUP BY fold
  UNION ALL
  SELECT fold, 'rouge2', round(avg({sq.f1('m', 'np', 'nr')}) * 100, 4)
  FROM r2 JOIN dfold ON dfold.doc_id = r2.sample_id GROUP BY fold)
SELECT metric, round(avg(value), {R}) AS mean, round(stddev_pop(value), {R}) AS std,
       round(min(value), {R}) AS min, round(max(value), {R}) AS max, count(*) AS n
FROM runs GROUP BY metric""")
def aggregate_runs(spark, sf):
    return ev.aggregate_runs(fold_scores(spark, sf))


def fold_scores(spark, sf):
    """(fold, metric, value): the mean scores of each fold's documents."""
    folds = splits.stratified_folds(table(spark, sf, "documents", ["doc_id", "lang"]), "doc_id",
                                    ["lang"], k=5, seed=42).select(F.col("doc_id").alias("sample_id"), "fold")
    c = derived.doc_candidate_tokens(spark, sf)
    pt, rt = F.col("pt"), F.col("rt")
    sc = c.select("sample_id", rg.rouge_n(pt, rt, 1)["f"].alias("rouge1"), rg.rouge_n(pt, rt, 2)["f"].alias("rouge2"))
    per_fold = sc.join(folds, "sample_id").groupBy("fold").agg(
        F.round(F.avg("rouge1") * 100, 4).alias("rouge1"), F.round(F.avg("rouge2") * 100, 4).alias("rouge2"))
    return per_fold.select("fold", F.inline(F.array(
        F.struct(F.lit("rouge1").alias("metric"), F.col("rouge1").alias("value")),
        F.struct(F.lit("rouge2").alias("metric"), F.col("rouge2").alias("value")))))


GRID = "max_rank=1:3:5 min_words=0:5"


def _leaderboard_sql() -> str:
    combos = ev.parse_grid(GRID)
    sel = []
    for c in combos:
        mr, mw = int(c["max_rank"]), int(c["min_words"])
        sel.append(f"SELECT CAST({mr} AS DOUBLE) AS max_rank, CAST({mw} AS DOUBLE) AS min_words, round(avg(coalesce(b_{mr}_{mw}, 0.0)), {R}) AS score FROM per")
    cols = ", ".join(
        f"max(CASE WHEN cand_rank < {int(c['max_rank'])} AND nw >= {int(c['min_words'])} THEN score END) "
        f"AS b_{int(c['max_rank'])}_{int(c['min_words'])}" for c in combos)
    return (_BASE + ", " + sq.rouge_n_ctes("doc_cands", _KEYS, "text", "gold", 2, "rn") + f""",
s AS (SELECT sample_id, cand_rank, round(100 * {sq.f1('m', 'np', 'nr')}, 4) AS score,
             len({sq.ws_tokens('c.text')}) AS nw FROM rn JOIN doc_cands c USING (sample_id, cand_rank)),
per AS (SELECT sample_id, {cols} FROM s GROUP BY sample_id),
res AS ({' UNION ALL '.join(sel)})
SELECT max_rank, min_words, score,
       row_number() OVER (ORDER BY score DESC, max_rank, min_words) AS rank FROM res""")


@register("leaderboard", "J8 T5 P20", _leaderboard_sql())
def leaderboard(spark, sf):
    combos = ev.parse_grid(GRID)
    s = cd.score_candidates(derived.doc_candidates(spark, sf), "rouge2", stem=False)
    s = s.withColumn("nw", tx.word_count("text"))
    aggs = [F.max(F.when((F.col("cand_rank") < int(c["max_rank"])) & (F.col("nw") >= int(c["min_words"])),
                         F.col("score"))).alias(f"b{i}") for i, c in enumerate(combos)]
    per = s.groupBy("sample_id").agg(*aggs)
    means = per.agg(*[F.round(F.avg(F.coalesce(F.col(f"b{i}"), F.lit(0.0))), R).alias(f"b{i}")
                      for i in range(len(combos))])
    rows = F.inline(F.array(*[F.struct(
        ev.typed_value(F.lit(c["max_rank"])).alias("max_rank"),
        ev.typed_value(F.lit(c["min_words"])).alias("min_words"),
        F.col(f"b{i}").alias("score")) for i, c in enumerate(combos)]))
    return ev.leaderboard(means.select(rows), ["score"], ["max_rank", "min_words"])


_NEG_SQL = sq.with_(sq.DOC_LINES, sq.DOC_GOLD) + f""", pool AS (
  SELECT sample_id, gold, row_number() OVER (ORDER BY sample_id) - 1 AS pos FROM doc_gold),
n AS (SELECT count(*) AS n FROM pool),
q AS (SELECT p.sample_id, p.gold, r.j,
             ({sq.seeded_hash('p.sample_id', 42)} % n + r.j * (1 + {sq.seeded_hash('p.sample_id', 43)} % (n // 3))) % n AS idx
      FROM pool p, n, (SELECT range AS j FROM range(3)) r),
negs AS (SELECT q.sample_id, q.j, pool.sample_id AS neg_id FROM q JOIN pool ON pool.pos = q.idx
         WHERE pool.gold <> q.gold)"""


@register("negative_sampling", "J6 T7 F7", _NEG_SQL + "\nSELECT sample_id, j, neg_id FROM negs")
def negative_sampling(spark, sf):
    gold = cut_lineage(derived.doc_gold(spark, sf).select("sample_id", "gold"))
    return ng.sample_negatives(gold, "sample_id", "gold", 3, 42).select(
        "sample_id", "j", F.col("neg_key").alias("neg_id"))


def _neg_part(name: str, rest: str) -> str:
    return f"""{name}p AS (SELECT sample_id, gold, row_number() OVER (ORDER BY sample_id) - 1 AS pos FROM doc_gold
  WHERE {sq.seeded_hash('sample_id', 7)} % 10 {rest}),
{name}n AS (SELECT count(*) AS n FROM {name}p),
{name}q AS (SELECT p.sample_id, p.gold, r.j,
             ({sq.seeded_hash('p.sample_id', 42)} % n + r.j * (1 + {sq.seeded_hash('p.sample_id', 43)} % (n // 3))) % n AS idx
      FROM {name}p p, {name}n, (SELECT range AS j FROM range(3)) r),
{name} AS (SELECT sample_id AS guid, sample_id AS cand_id, CAST(1.0 AS DOUBLE) AS label FROM {name}p
  UNION ALL SELECT q.sample_id, p.sample_id, 0.0 FROM {name}q q JOIN {name}p p ON p.pos = q.idx WHERE p.gold <> q.gold)"""


@register("gold_examples", "C4 X1 J6", sq.with_(sq.DOC_LINES, sq.DOC_GOLD) + f""",
{_neg_part('train', '<> 9')}, {_neg_part('test', '= 9')}
SELECT 'train' AS part, * FROM train UNION ALL SELECT 'test', * FROM test""")
def gold_examples(spark, sf):
    """One part in ten is held out; negatives are drawn inside each part."""
    gold = derived.doc_gold(spark, sf)
    held = splits.seeded_hash("sample_id", 7) % 10 == 9
    ex = ng.split_examples({"train": gold.where(~held), "test": gold.where(held)}, "sample_id", "source", "gold", 3, 42)
    return ex.select("part", "guid", F.col("cand_key").alias("cand_id"), "label")


def _scored_part(name: str) -> str:
    return (f"{name}s AS (SELECT {name}.*, p.gold AS a, q.gold AS b FROM {name} JOIN doc_gold p ON p.sample_id = cand_id JOIN doc_gold q ON q.sample_id = guid), "
            + sq.rouge_n_ctes(f"{name}s", ["guid", "cand_id", "label"], "a", "b", 1, f"{name}f"))


@register("gold_examples_scored", "C4 B8 B1", sq.with_(sq.DOC_LINES, sq.DOC_GOLD) + f""",
{_neg_part('train', '<> 9')}, {_neg_part('test', '= 9')}, {_scored_part('train')}, {_scored_part('test')},
al AS (SELECT 'train' AS part, * FROM trainf UNION ALL SELECT 'test', * FROM testf)
SELECT part, guid, cand_id, round(CASE WHEN label = 1 THEN 1.0 ELSE {sq.f1('m', 'np', 'nr')} END, {R}) AS label FROM al""")
def gold_examples_scored(spark, sf):
    """The labelled gold examples; a negative's label is its ROUGE-1 against
    the gold text over that text's with itself."""
    gold = derived.doc_gold(spark, sf)
    held = splits.seeded_hash("sample_id", 7) % 10 == 9

    def rouge_1(a, b):
        return rg.rouge_n(tx.alnum_tokens(a), tx.alnum_tokens(b), 1)["f"]

    ex = ng.split_examples({"train": gold.where(~held), "test": gold.where(held)}, "sample_id", "source", "gold", 3, 42, rouge_1)
    return ex.select("part", "guid", F.col("cand_key").alias("cand_id"), F.round("label", R).alias("label"))


@register("cv_labels", "C12 C5 W2 W3 X4", _BASE + f""",
t AS (SELECT sample_id, cand_rank, {sq.alnum_tokens('text')} AS pt, {sq.alnum_tokens('gold')} AS rt FROM doc_cands),
l AS (SELECT sample_id, cand_rank, len(pt) AS np, len(rt) AS nr, {sq.lcs_len('pt', 'rt')} AS m FROM t),
s AS (SELECT sample_id, cand_rank, round(100 * {sq.f1('m', 'np', 'nr')}, 4) AS score FROM l),
mx AS (SELECT sample_id, max(score) AS mx FROM s GROUP BY sample_id), {_doc_folds_sql()}
SELECT fold, CASE WHEN fold = 4 THEN 'test' ELSE 'train' END AS part, sample_id, cand_rank,
       CASE WHEN mx = 0 THEN 0.0 ELSE score / mx END AS relative_label, CAST(CASE WHEN score = mx THEN 1.0 ELSE 0.0 END AS DOUBLE) AS binary_label
FROM s JOIN mx USING (sample_id) JOIN dfold ON dfold.doc_id = sample_id""")
def cv_labels(spark, sf):
    """The candidates of all folds with both kinds of labels, scored once; the
    last fold is the test part."""
    s = cd.score_candidates(derived.doc_candidates(spark, sf), "rougeL", stem=False)
    s = cd.materialize(s, [*_KEYS, "score"])
    both = cd.relative_labels(cd.relative_labels(s, name="relative_label"), name="binary_label", binary=True)
    folds = splits.stratified_folds(table(spark, sf, "documents", ["doc_id", "lang"]), "doc_id", ["lang"], k=5, seed=42)
    both = both.join(folds.select(F.col("doc_id").alias("sample_id"), "fold"), "sample_id")
    return both.select("fold", splits.holdout_split("fold", 5, 4).alias("part"), *_KEYS, "relative_label", "binary_label")


@register("observed_run", "A13 A14 C8", _BASE + ", " + sq.rouge_n_ctes("doc_cands", _KEYS, "text", "gold", 2, "rn") + f""",
s AS (SELECT sample_id, round(100 * {sq.f1('m', 'np', 'nr')}, 4) AS score FROM rn),
b AS (SELECT sample_id, max(score) AS score FROM s GROUP BY sample_id)
SELECT 'n_candidates' AS metric, CAST(count(*) AS DOUBLE) AS value FROM s
UNION ALL SELECT 'n_some', CAST(count(*) AS DOUBLE) FROM s WHERE score > 0
UNION ALL SELECT 'best_rouge2', round(avg(score), 4) FROM b UNION ALL SELECT 'n_obs', CAST(count(*) AS DOUBLE) FROM b
UNION ALL SELECT 'took_time', 1.0""")
def observed_run(spark, sf):
    """The best candidates written in one pass, and the run's metrics beside
    them: counts and score come from observations on the written plan."""
    import time

    from tessera.operators import metrics as mt
    from tessera.session import Rounds
    scored, seen = mt.observed(cd.score_candidates(derived.doc_candidates(spark, sf), "rouge2", stem=False), "candidates",
                               n_candidates=F.count(F.lit(1)), n_some=F.count_if(F.col("score") > 0))
    best, kept = mt.observed(cd.pick_best(scored, payload=()), "best", n=F.count(F.lit(1)), score=F.avg("score"))
    files, start = Rounds(spark), time.time()
    best.write.parquet(f"{files.folder}/best")
    took, counts, run = time.time() - start, seen.get, kept.get
    scores = spark.createDataFrame([("n_candidates", float(counts["n_candidates"])), ("n_some", float(counts["n_some"])),
                                    ("best_rouge2", round(run["score"] or 0.0, 4))], "metric string, value double")
    result = mt.run_result(scores, run["n"], took)
    # what a clock says can't be compared: that it ran is told
    clock = F.col("metric").isin("runtime", "seconds_per_sample")
    result = result.where(F.col("metric") != "seconds_per_sample").select(
        F.when(clock, "took_time").otherwise(F.col("metric")).alias("metric"), F.when(clock, (F.col("value") > 0).cast("double")).otherwise(F.col("value")).alias("value"))
    return files.close(result)


@register("prediction_examples", "C5 W2 W4", _BASE + f""",
t AS (SELECT sample_id, cand_rank, text, {sq.alnum_tokens('text')} AS pt, {sq.alnum_tokens('gold')} AS rt FROM doc_cands),
l AS (SELECT sample_id, cand_rank, text, len(pt) AS np, len(rt) AS nr, {sq.lcs_len('pt', 'rt')} AS m FROM t),
s AS (SELECT sample_id, cand_rank, text, round(100 * {sq.f1('m', 'np', 'nr')}, 4) AS score FROM l),
mx AS (SELECT sample_id, max(score) AS mx, row_number() OVER (ORDER BY sample_id) - 1 AS guid FROM s GROUP BY sample_id)
SELECT guid, CASE WHEN {sq.seeded_hash('sample_id', 7)} % 10 = 9 THEN 'test' ELSE 'train' END AS part,
       cand_rank, text AS candidate, CASE WHEN mx = 0 THEN 0.0 ELSE score / mx END AS label
FROM s JOIN mx USING (sample_id)""")
def prediction_examples(spark, sf):
    """Labelled candidates; the examples of a sample share a consecutive id."""
    s = cd.score_candidates(derived.doc_candidates(spark, sf), "rougeL", stem=False).select(*_KEYS, "text", "score")
    ex = cd.relative_labels(cd.materialize(s, [*_KEYS, "text", "score"]))
    ids = global_index(ex.select("sample_id").distinct(), ["sample_id"], "guid")
    part = F.when(splits.seeded_hash("sample_id", 7) % 10 == 9, F.lit("test")).otherwise(F.lit("train"))
    return ex.join(ids, "sample_id").select("guid", part.alias("part"), "cand_rank", F.col("text").alias("candidate"), "label")


@register("prediction_run", "C13 C6 C9 B4", _LEX + """,
pk AS (SELECT sample_id, 0 AS cand_rank, text, gold FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_rank) AS k FROM lex) WHERE k = 1), """
          + sq.rouge_n_ctes("pk", _KEYS, "text", "gold", 1, "r1") + ", " + sq.rouge_n_ctes("pk", _KEYS, "text", "gold", 2, "r2") + f""",
pl AS (SELECT len(pt) AS np, len(rt) AS nr, {sq.lcs_len('pt', 'rt')} AS m
       FROM (SELECT {sq.alnum_tokens('text')} AS pt, {sq.alnum_tokens('gold')} AS rt FROM pk))
SELECT 'rouge1' AS metric, round(avg({sq.f1('m', 'np', 'nr')}) * 100, 4) AS value FROM r1
UNION ALL SELECT 'rouge2', round(avg({sq.f1('m', 'np', 'nr')}) * 100, 4) FROM r2
UNION ALL SELECT 'rougeL', round(avg({sq.f1('m', 'np', 'nr')}) * 100, 4) FROM pl""")
def prediction_run(spark, sf):
    """Candidates of every document, the best by the lexical scorer, ROUGE of
    the picks: the two-stage job from end to end."""
    c = _lex_scored(spark, sf).withColumnRenamed("score", "lex")
    return predict_best(c, F.col("lex"), stem=False)[1]


@register("trained_scorer", "C17 C4 A8")
def trained_scorer(spark, sf):
    """A scorer fitted on the train part of the labelled gold examples and
    measured on the test part: rows, mean squared error, pairs in order."""
    gold = derived.doc_gold(spark, sf)
    held = splits.seeded_hash("sample_id", 7) % 10 == 9
    ex = cut_lineage(ng.split_examples({"train": gold.where(~held), "test": gold.where(held)}, "sample_id", "source", "gold", 3, 42))
    model = fit_scorer(ex.where(F.col("part") == "train"))
    out = score_pairs(model, ex.where(F.col("part") == "test"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(F.col("score") - F.col("label"), 2)), 4).alias("mse"),
                   F.round(F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")), 4).alias("accuracy"))
