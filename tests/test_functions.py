import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import arrays as ar
from tessera.functions import text as tx
from tessera.functions.lcs import lcs_length, lcs_positions, summary_lcs_hits
from tessera.functions.stem import porter, stem_token


def _dp_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def test_bit_parallel_lcs_matches_dp():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 90))]
        assert lcs_length(a, b) == _dp_lcs(a, b)
        pos = lcs_positions(np.array(a), np.array(b))
        assert len(pos) == _dp_lcs(a, b) and _dp_lcs([a[i] for i in pos], b) == len(pos)


def test_lcs_walk_steps_in_the_reference_on_ties():
    assert lcs_positions(np.array(["a", "b"]), np.array(["b", "a"])) == [0]
    assert lcs_positions(np.array(list("abc")), np.array(list("cab"))) == [0, 1]


def test_summary_lcs_against_full_tables():
    rng = random.Random(3)
    for _ in range(200):
        ref, pred = [[[rng.choice("abcdef") for _ in range(rng.randint(0, 8))] for _ in range(rng.randint(0, 3))] for _ in range(2)]
        left, right = Counter(t for s in ref for t in s), Counter(t for s in pred for t in s)
        hits = 0
        for r in ref:
            union = set()
            for p in pred:
                if r and p:
                    union.update(lcs_positions(np.array(r), np.array(p)))
            for i in sorted(union):
                if left[r[i]] > 0 and right[r[i]] > 0:
                    hits += 1
                    left[r[i]] -= 1
                    right[r[i]] -= 1
        assert summary_lcs_hits(ref, pred) == hits


def test_summary_lcs_by_hand():
    # union over both sentences: w1 w2 from the first, w1 w3 w5 from the second
    ref, pred = ["w1 w2 w3 w4 w5".split()], ["w1 w2 w6 w7 w8".split(), "w1 w3 w8 w9 w5".split()]
    assert summary_lcs_hits(ref, pred) == 4
    # a hit uses up one occurrence on each side
    assert summary_lcs_hits([["a"], ["a"]], [["a"]]) == 1
    assert summary_lcs_hits([], [["a"]]) == 0 and summary_lcs_hits([["a"]], [[]]) == 0


def test_summary_lcs_single_sentence_equals_lcs():
    a, b = "the cat sat on the mat".split(), "a cat on a mat".split()
    assert summary_lcs_hits([a], [b]) == lcs_length(a, b)


def test_porter_known_words():
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop",
             "generalizations": "gener", "effective": "effect", "happy": "happi"}
    # the extended rules: logi, bli, y after a consonant only, short -ies, irregular forms
    pairs |= {"pathology": "patholog", "biology": "biolog", "enjoy": "enjoy", "dying": "die", "dies": "die",
              "possibly": "possibl", "skies": "sky", "ties": "tie", "died": "die", "cried": "cri", "hopefully": "hope",
              "treatments": "treatment", "radiology": "radiolog", "say": "say", "by": "by", "controlled": "control",
              "succeed": "succeed", "news": "news", "geologically": "geolog", "falling": "fall", "agreed": "agre"}
    for w, s in pairs.items():
        assert porter(w) == s, w
    assert stem_token("cats") == "cat" and stem_token("was") == "was"


def test_multiset_overlap_matches_counter(spark):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        a = [rng.choice("abcdef") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcdef") for _ in range(rng.randint(0, 12))]
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "id long, a array<string>, b array<string>")
    got = {r.id: r.m for r in df.select("id", ar.multiset_overlap(F.col("a"), F.col("b")).alias("m")).collect()}
    for i, a, b in rows:
        ca, cb = Counter(a), Counter(b)
        assert got[i] == sum(min(ca[k], cb[k]) for k in ca)


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (["x"],)], "t array<string>")
    got = [r.g for r in df.select(ar.ngrams(F.col("t"), 2).alias("g")).collect()]
    assert got == [["a b", "b c"], [], []]


def test_text_rules_match_python(spark):
    texts = ["  hello\tworld  ", "　x  y\n", "", "a​b c", "End. Next! Last? no"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(tx.ws_tokens("t").alias("w"), tx.strip("t").alias("s"),
                     tx.clean_text("t").alias("c"), tx.first_word("t").alias("f"),
                     tx.sentence_count("t").alias("n")).collect()
    for t, r in zip(texts, rows):
        assert r.w == t.split()
        assert r.s == t.strip()
        assert r.c == t.replace("\n", " ").strip()
        assert r.f == (t.split()[0].lower() if t.split() else None)
    assert rows[4].n == 4 and rows[2].n == 0


def test_alnum_tokens(spark):
    df = spark.createDataFrame([("Héllo, WORLD-42 über",)], "t string")
    assert df.select(tx.alnum_tokens("t").alias("a")).first().a == ["h", "llo", "world", "42", "ber"]
