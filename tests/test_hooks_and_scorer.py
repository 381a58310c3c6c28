import pytest
from pyspark.sql import functions as F

from tessera.functions import hooks
from tessera.operators import metrics as mt
from tessera.operators.candidates import attach_gold, score_candidates
from tessera.operators.scorer import fit_scorer, predict_best, score_pairs


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(1, "One two. Three!", "one"), (2, None, "x y")], "id long, a string, b string")


def test_each_hook(texts):
    got = {r.id: r for r in texts.select(
        "id", hooks.length(lambda ts: [len(t.split()) for t in ts], F.col("a")).alias("n"),
        hooks.sentence_splitter(lambda t: t.split(". "), F.col("a")).alias("s"),
        hooks.pair_scorer(lambda a, b: [len(x) - len(y) for x, y in zip(a, b)], F.col("a"), F.col("b")).alias("p"),
        hooks.candidate_generator(lambda ts: [[t.upper(), t.lower()] for t in ts], F.col("a")).alias("c"),
        hooks.embedder(lambda ts: [[len(t), 1] for t in ts], F.col("a")).alias("e"),
        hooks.metric(lambda x, y: float(x == y), F.col("a"), F.col("b")).alias("m")).collect()}
    assert (got[1].n, got[1].s, got[1].p, got[1].c, got[1].e, got[1].m) == (
        3, ["One two", "Three!"], 12.0, ["ONE TWO. THREE!", "one two. three!"], [15.0, 1.0], 0.0)
    assert (got[2].n, got[2].s, got[2].p) == (0, [""], -3.0)


def test_scorer_learns_a_linear_label(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, " ".join(words), " ".join(words[: i % 8 + 1]), (i % 8 + 1) / 8.0) for i in range(64)]
    ex = spark.createDataFrame(rows, "guid long, source string, candidate string, label double")
    model = fit_scorer(ex)
    out = score_pairs(model, ex).agg(F.max(F.abs(F.col("score") - F.col("label"))).alias("e")).first().e
    assert out < 0.01
    assert fit_scorer(ex, most=40).coefficients.size == 4


def test_scorer_is_fitted_on_all_rows(spark):
    """Over a million rows, of which a share by the hash of their keys would be
    all with the label 0: the mean of the fit is that of all labels."""
    from tessera.operators.splits import seeded_hash

    keys = spark.range(1_000_200).select(F.col("id").alias("guid"), (seeded_hash("id", 42) % 1_000_000 >= 999_800).alias("rare"))
    ex = keys.select("guid", F.lit("a b").alias("source"), F.lit("a").alias("candidate"), F.when(F.col("rare"), 1e6).otherwise(0.0).alias("label"))
    want = ex.agg(F.avg("label")).first()[0]
    got = score_pairs(fit_scorer(ex), spark.createDataFrame([("a b", "a")], "source string, candidate string")).first().score
    assert want > 0 and abs(got - want) < 1e-6 * want


def test_predict_best_and_metrics(spark):
    rows = [(1, 0, "a b c", "a b c"), (1, 1, "x", "a b c"), (2, 0, "q", "d e"), (2, 1, "d e", "d e")]
    df = spark.createDataFrame(rows, "sample_id long, cand_rank long, text string, gold string")
    picked, metrics = predict_best(df, F.length("text").cast("double"))
    assert {r.sample_id: r.text for r in picked.collect()} == {1: "a b c", 2: "d e"}
    assert {r.metric: r.value for r in metrics.collect()} == {"rouge1": 100.0, "rouge2": 100.0, "rougeL": 100.0}
    runs = {r.metric: r.value for r in mt.run_result(metrics, 2, 3.0).collect()}
    assert runs["n_obs"] == 2 and runs["seconds_per_sample"] == 1.5


def test_metric_dispatch_triple_and_raw(spark):
    df = spark.createDataFrame([("a b", "a b c d"), ("x", "x")], "pred string, ref string")
    t = mt.corpus_rouge(df, keys=("rouge1",), triple=True).first()
    assert (t.precision, t.recall, t.value) == (100.0, 75.0, 83.3333)
    raw = mt.raw_rouge(df, keys=("rouge1", "rougeLsum")).collect()
    assert sorted((round(r.rouge1.p, 4), round(r.rouge1.r, 4)) for r in raw) == [(1.0, 0.5), (1.0, 1.0)]
    assert mt.corpus_score(df, "bleu").first().sys_len == 3
    assert mt.corpus_score(df, "rouge2").first().metric == "rouge2"
    with pytest.raises(ValueError):
        score_candidates(df.withColumnsRenamed({"pred": "text", "ref": "gold"}), "other")


def test_attach_gold_reports_a_missing_id(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b")], "sample_id long, text string")
    g = spark.createDataFrame([(1, "g")], "sample_id long, gold string")
    assert attach_gold(c, g).count() == 1
    with pytest.raises(Exception, match="no gold for id 2"):
        attach_gold(c, g, on_missing="error").collect()


def test_mean_length(spark):
    df = spark.createDataFrame([(["a", "<pad>"],), (["a", "b", "c"],)], "t array<string>")
    assert mt.mean_length(df, "t", "<pad>").first().gen_len == 2.0


def test_bleu_of_normalised_texts(spark):
    df = spark.createDataFrame([("\u201ea\u201d b\u200b c \u0219i d", '"a" b c si d')], "pred string, ref string")
    assert mt.corpus_bleu(df, normalize=True).first().bleu == 100.0 > mt.corpus_bleu(df).first().bleu
