"""Values worked out by hand over small files and frames."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import metrics as mt
from tessera.operators import profile
from tessera.sources.text import numbered_lines, parallel_pairs


@pytest.fixture
def files(tmpdir_path):
    def write(name, lines):
        p = os.path.join(tmpdir_path, name)
        with open(p, "w") as f:
            f.write("\n".join(lines) + "\n")
        return p
    return (write("val.source", ["the cat sat", "a b", "The cats possibly dying"]),
            write("val.target", ["the cat sat down", "b a", "the cat possible die"]))


def pairs(spark, files):
    return parallel_pairs(spark, *files).withColumnsRenamed({"source": "pred", "target": "ref"})


def test_corpus_rouge(spark, files):
    two = pairs(spark, files).where("pair_id < 2")
    got = {r.metric: r.value for r in mt.corpus_rouge(two, stem=False).collect()}
    # unigrams (2 * 3/4) / (1 + 3/4) and 1; bigrams (2 * 2/3) / (5/3) and 0; subsequences 6/7 and 1/2
    assert got == {"rouge1": 92.8571, "rouge2": 40.0, "rougeL": 67.8571}


def test_stems_match_in_stemmed_rouge(spark, files):
    last = pairs(spark, files).where("pair_id = 2")
    assert {r.metric: r.value for r in mt.corpus_rouge(last).collect()} == {"rouge1": 100.0, "rouge2": 100.0, "rougeL": 100.0}
    assert mt.corpus_rouge(last, keys=("rouge1",), stem=False).first().value == 25.0


def test_bleu_whitespace_no_smoothing(spark):
    df = spark.createDataFrame([("a b c d e", "a b c d f")], "pred string, ref string")
    r = mt.corpus_bleu(df, smooth="none", tokenizer="whitespace").first()
    assert (r.m1, r.m2, r.m3, r.m4, r.t1, r.t4) == (4, 3, 2, 1, 5, 2)
    assert r.bleu == 66.874  # 100 * (4/5 * 3/4 * 2/3 * 1/2) ** 0.25


def test_13a_tokens(spark):
    from tessera.functions.bleu import tokens_13a
    df = spark.createDataFrame([('He said, "1,000.5 - it\'s 3-4 &amp; {x}~[y]^_`@/!"',)], "t string")
    assert df.select(tokens_13a("t").alias("t")).first().t == (
        'He said , " 1,000.5 - it\'s 3 - 4 & { x } ~ [ y ] ^ _ ` @ / ! "').split()


def test_overlap_and_length_profiles(spark):
    df = spark.createDataFrame([(0, "what is flu", "what flu"), (1, "a b c d", "a x"), (2, "q", "z z y")], "pair_id long, source string, target string")
    scores = profile.target_source_overlap(df, ["pair_id"], rounded=False)
    p = profile.numeric_profile(scores, "overlap", {"q50": .5, "q75": .75}, prefix="o").first()
    assert (p.n, p.mean_o, p.q50, p.q75) == (3, 0.5, 0.5, 0.75)
    top = profile.top_k(profile.new_word_frequency(df), "n", "word", 2).collect()
    assert len(top) == 2


def test_word_counts_of_lines(spark, files):
    lines = numbered_lines(spark, files[0]).select(tx.word_count("text").alias("n"))
    p = profile.numeric_profile(lines, "n", {"q50": .5}, prefix="w").first()
    assert (p.min_w, p.max_w, p.mean_w, p.q50) == (2, 4, 3.0, 3.0)
