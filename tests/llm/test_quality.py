import math
import random
import re

from pyspark.sql import functions as F

from tessera.llm.quality import BASE, RULES, estimate, keep_good, op6_quality, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_base(text):
    text = text or ""
    w = WORD.findall(text)
    win = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = {}
    for x in win:
        n[x] = n.get(x, 0) + 1
    hit = {i + j for i, x in enumerate(win) if n[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def slow_em(counts, n_rules, rounds=25):
    pats = {c: [c // 3 ** j % 3 - 1 for j in range(n_rules)] for c in counts}
    share, good, bad = 0.9, [0.01] * n_rules, [0.3] * n_rules

    def post(v):
        lg = math.log(share) + sum(math.log(r if x < 0 else 1 - r) for x, r in zip(v, good) if x)
        lb = math.log(1 - share) + sum(math.log(r if x < 0 else 1 - r) for x, r in zip(v, bad) if x)
        return 1 / (1 + math.exp(min(lb - lg, 700)))

    for _ in range(rounds):
        g = {c: post(v) for c, v in pats.items()}
        def rate(j, w, a, b):
            return ((sum(w(c) for c, v in pats.items() if v[j] < 0) + a) / (sum(w(c) for c, v in pats.items() if v[j]) + a + b))
        new_good = [rate(j, lambda c: counts[c] * g[c], .1, 9.9) for j in range(n_rules)]
        new_bad = [rate(j, lambda c: counts[c] * (1 - g[c]), 3., 7.) for j in range(n_rules)]
        n, ng = sum(counts.values()), sum(counts[c] * g[c] for c in counts)
        share, good, bad = (ng + 9) / (n + 10), new_good, new_bad
    return {c: post(v) for c, v in pats.items()}


def sample():
    rng = random.Random(11)
    words = ["alpha", "be", "gamma,", "d", "épsilon", "ZETA", "eta.", "#x", "|", "!!"]
    texts = [None, "", " \n \t", "a", "a\n\na\n a\nb", "\x1f \x1f"]
    for _ in range(150):
        n = rng.choice([3, 7, 8, 9, 30, 120])
        t = [rng.choice(words) + rng.choice([" ", " ", "\n", "\t"]) for _ in range(n)]
        if rng.random() < .5:
            i = rng.randrange(n)
            t += t[i:i + rng.choice([7, 8, 9, 20])] * rng.randint(1, 4)
        texts.append("".join(t))
    return texts + [" ".join("the cat is very old".split() * 4000), texts[-1], texts[-1]]


def test_figures_and_verdicts_against_plain_python(spark):
    texts = sample()
    df = spark.createDataFrame([(i, t, 5, 5.0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, p_good double")
    got = {r.doc_id: r for r in quality(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = slow_base(t)
        assert tuple(got[i][c] for c in BASE) == want, t
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert got[i].kept == (not got[i].base_failed and got[i].p_good >= 0.5)
    left = keep_good(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_estimation_against_plain_python(spark):
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        is_bad = rng.random() < .2
        v = [0 if rng.random() < .2 else (-1 if rng.random() < (.35 if is_bad else .01) else 1) for _ in RULES]
        c = sum((x + 1) * 3 ** j for j, x in enumerate(v))
        counts[c] = counts.get(c, 0) + 1
    rows = spark.createDataFrame([(c,) for c, n in counts.items() for _ in range(n)], "_code long")
    got = {r._code: r.p_good for r in estimate(rows).collect()}
    want = slow_em(counts, len(RULES))
    assert got.keys() == want.keys()
    assert max(abs(got[c] - want[c]) for c in want) < 1e-9


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = op6_quality(spark, sf).join(labels, "doc_id").select("kept", "quality", "base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1 and not r.base_failed], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_empty(spark):
    assert quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string").select("doc_id", F.upper("text").alias("text"))
    plan = quality(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
