"""What is dear is done once: rows of the bootstrap, equal sentences, texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as ar
from tessera.functions import lcs
from tessera.functions import rouge as rg
from tessera.functions import text as tx
from tessera.operators import resampling as rs

TEXTS = ["The cat sat. The cat ran!  A dog sat", "a dog sat on. The. the cat", "", "  \x1c ", None, "Ünder .x\x01y? z\u0085 W", "cat " * 50, "one\n\n two. two"]


def test_bootstrap_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def dear(i):
        seen.add(1)
        return float(i % 7)

    n = 3000
    rows = spark.range(n, numPartitions=3).select("id", dear("id").alias("x"))
    rs.bootstrap_means(rows, ["id"], ["x"], 5).collect()
    assert seen.value == n


def test_equal_sentences_are_not_compared(monkeypatch):
    calls, walk = [], lcs.lcs_positions
    monkeypatch.setattr(lcs, "lcs_positions", lambda *a: calls.append(1) or walk(*a))
    same = [["a"], ["b", "c"]] * 500
    assert lcs.summary_lcs_hits(same, same) == 1500 and not calls
    assert lcs.summary_lcs_hits([["a", "x"], ["y", "b"]] * 50, same) == 100 and len(calls) == 2


def test_walk_without_unmatched_tokens_is_the_same():
    rnd = random.Random(3)
    for _ in range(1500):
        r, p = ([rnd.choice("abcd" + extra) for _ in range(rnd.randrange(1, 14))] for extra in ("x", "yz"))
        whole = set(lcs.lcs_positions(r, p))
        places = lcs._places(p)
        got = lcs._union(r, [(p, places)], {t: [0] for t in places})
        assert got == whole


@pytest.mark.parametrize("stem", [False, True])
def test_counts_of_texts_are_those_of_token_columns(spark, stem):
    from tessera.functions.stem import stem_nested_udf, stem_tokens_udf
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate((p, r) for r in TEXTS for p in TEXTS)], "id int, p string, r string").coalesce(1)
    got = {r.id: r for r in rg.scored(df, "p", "r", ("rouge1", "rouge2", "rougeL", "rougeLsum"), stem, ("id",)).collect()}
    nested = {c: F.filter(F.transform(tx.sentences(c), lambda s: tx.alnum_tokens(s)), lambda t: F.size(t) > 0) for c in "pr"}
    t = df.select("id", *[(stem_tokens_udf(tx.alnum_tokens(c)) if stem else tx.alnum_tokens(c)).alias(c) for c in "pr"],
                  *[(stem_nested_udf(nested[c]) if stem else nested[c]).alias(f"s{c}") for c in "pr"])
    p, r = F.col("p"), F.col("r")
    want = t.select("id", rg.rouge_n(p, r, 1).alias("rouge1"), rg.rouge_n(p, r, 2).alias("rouge2"), rg.rouge_l(p, r).alias("rougeL"),
                    rg.rouge_lsum_tokens(F.col("sp"), F.col("sr")).alias("rougeLsum")).collect()
    assert len(want) == len(TEXTS) ** 2 and all(got[w.id] == w for w in want)


def test_ngrams_of_a_long_text(spark):
    words = [str(i % 97) for i in range(30_000)]
    df = spark.createDataFrame([(words,), (["a", "b"],)], "t array<string>")
    long, short = (r.g for r in df.select(ar.ngrams(F.col("t"), 3).alias("g")).collect())
    assert Counter(long) == Counter(map(" ".join, zip(words, words[1:], words[2:]))) and short == []


def test_first_line(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, "\n \n\t x y \n z", "\n", "a"]], "t string")
    assert all(r.a == r.b for r in df.select(tx.first_line("t").alias("a"), F.get(tx.non_empty_lines("t"), 0).alias("b")).collect())


ODD = [*TEXTS, "a 3.5, b-c 7-8 &quot;x&quot; &amp;lt; {y} ~z <skipped> u-\nv", "1.2.3 .,. 4-, é ü,x.9 -\n- \x1c", "A-1 a_b (c) [d] 100% !"]


def test_bleu_of_texts_is_that_of_token_columns(spark):
    from tessera.functions import bleu as bl
    from tessera.operators import metrics as mt
    df = spark.createDataFrame([(h, r) for r in ODD for h in ODD], "pred string, ref string").coalesce(1)
    alike = df.select("pred", bl.tokens_13a("pred").alias("t")).collect()
    assert all(r.t == (None if r.pred is None else bl.python_tokens_13a(r.pred)) for r in alike)
    for name, tok in (("13a", bl.tokens_13a), ("whitespace", tx.ws_tokens)):
        got = df.select("*", F.inline(F.array(bl.bleu_stats("pred", "ref", name)))).collect()
        t = df.select(tok("pred").alias("h"), tok("ref").alias("r"))
        grams = [(ar.ngrams(F.col("h"), n), ar.ngrams(F.col("r"), n)) for n in range(1, 5)]
        want = t.select(F.size("h").alias("sys_len"), F.size("r").alias("ref_len"), *[ar.multiset_overlap(a, b).alias(f"m{n}") for n, (a, b) in enumerate(grams, 1)],
                        *[F.greatest(F.size("h") - (n - 1), F.lit(0)).alias(f"t{n}") for n in range(1, 5)]).collect()
        assert [tuple(r)[2:] for r in got] == [tuple(r) for r in want]
    plan = mt.corpus_bleu(df)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "transform" not in plan  # one UDF, nothing per n-gram


def test_words_and_sentences_of_lines_and_pairs(spark):
    from tessera.operators import augment as au
    texts = [*[t for t in ODD if t], "A b. c\n\n d a! \nb\n. \x01\n\x01 x\ny.\x01 z? ", "q\x01\nr", "\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", au.line_words(F.lower("t")).alias("l"), tx.non_empty_lines(F.lower("t")).alias("x")).collect()
    lines = [x for r in rows for x in r.x]
    n = {r.t: r.n for r in spark.createDataFrame([(t,) for r in rows for t in [*r.x, *map(" ".join, zip(r.x, r.x[1:]))]], "t string").select("t", tx.sentence_count("t").alias("n")).collect()}
    assert lines
    for r in rows:
        assert [l.n for l in r.l] == [n[x] for x in r.x]
        assert [l.n_next for l in r.l] == [*[n[f"{a} {b}"] for a, b in zip(r.x, r.x[1:])], *[None] * bool(r.x)]
        number = {}
        assert [set(l.w) for l in r.l] == [{number.setdefault(w, len(number)) for w in x.split()} for x in r.x]
    pairs = spark.createDataFrame([(a, b) for a in texts[:6] for b in texts[:6]], "a string, b string").coalesce(1)
    for r in pairs.select("*", au.pair_words(F.lower("a"), F.lower("b")).alias("s")).collect():
        a, b = set(r.a.lower().split()), set(r.b.lower().split())
        assert (len(r.s.w_1), len(r.s.w_2), len({*r.s.w_1} & {*r.s.w_2})) == (len(a), len(b), len(a & b))
        assert r.s.n_1 == sum(bool(x.strip()) for x in tx.python_sentences(r.a)) and len(r.s.w_2) == len({*r.s.w_2})


def test_vectors_move_texts_once(spark):
    """Against plain Python, with ids that repeat or are null."""
    from math import log, sqrt

    from tessera.operators import sparse
    rnd = random.Random(5)
    docs = [(rnd.choice([None, *range(25)]), " ".join(rnd.choice(["Ab", "b", "C c", "d\x1c", "é", f"w{rnd.randrange(60)}"]) for _ in range(rnd.randrange(9)))) for _ in range(60)] + [(99, None), (98, " ")]
    got = {r.id: r.vector for r in sparse.tfidf(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), bits=5).collect()}
    hashed = {r.w: r.t for r in spark.createDataFrame([(w,) for _, t in docs for w in (t or "").lower().split()], "w string").select("w", sparse.bucket(F.col("w"), 5).alias("t")).collect()}
    of = {}
    for i, t in docs:
        for w in (t or "").lower().split():
            of.setdefault(i, Counter())[hashed[w]] += 1
    n, total = Counter(t for c in of.values() for t in c), len(of.keys() - {None})
    assert got.keys() == of.keys()
    for i, c in of.items():
        want = sorted((n[t], t, k * (log((1 + total) / (1 + n[t])) + 1)) for t, k in c.items())
        norm = sqrt(sum(w * w for *_, w in want))
        assert [(v.n, v.term) for v in got[i]] == [w[:2] for w in want]
        assert [v.weight for v in got[i]] == pytest.approx([w / norm for *_, w in want])
    plan = sparse.tfidf(spark.createDataFrame(docs, "doc_id long, text string"), bits=5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # behind the counts nothing is shuffled
