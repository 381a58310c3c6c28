import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm.ppm import Table, lm_scores, op9_ppm

FIELDS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def is_out(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2


def slow(rows, order):
    train = [lower(t) for k, t in rows if not is_out(k)]
    c = Counter(w for t in train for w in re.findall(r"[^\x20\x09-\x0D]+", t))
    c[None] = len(train)
    if not train:
        del c[None]
    n, v = sum(c.values()), len(c)
    trie = defaultdict(Counter)
    for t in train:
        b = [255] * order + list(t.encode()) + [255]
        for i in range(order, len(b)):
            for j in range(order + 1):
                trie[tuple(b[i - j:i])][b[i]] += 1

    def symbol(context, s):
        p, out = 0.0, set()
        for j in range(order, -1, -1):
            seen = trie.get(tuple(context[len(context) - j:]))
            if not seen:
                continue
            left = {x: m for x, m in seen.items() if x not in out}
            total = sum(left.values()) + len(left)
            if s in left:
                return p + math.log10(left[s] / total)
            if total:
                p += math.log10(len(left) / total)
            out |= set(seen)
        return p - math.log10(256 - len(out))

    res = []
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None]
        b = [255] * order + list(lower(t).encode()) + [255]
        res.append((k, is_out(k), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w),
                    sum(symbol(b[i - order:i], b[i]) for i in range(order, len(b)))))
    return sorted(res, key=repr)


def check(df, rows, order, **more):
    got = sorted((tuple(r) for r in lm_scores(df, order=order, **more).select(*FIELDS).collect()), key=repr)
    want = slow(rows, order)
    assert sorted(x[:5] for x in map(lambda r: tuple(map(repr, r)), got)) == sorted(x[:5] for x in map(lambda r: tuple(map(repr, r)), want))
    key = lambda r: (repr(r[0]), round(r[5], 4))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def sample():
    rng = random.Random(6)
    words = ["the", "The", "cat", "école", "sat.", "x" * 40, "\x00", "日本"] + [f"w{i}" for i in range(40)]
    rows = [(i, "".join(rng.choice(words) + rng.choice(" \n\t ") for _ in range(rng.randint(0, 40)))) for i in range(80)]
    return rows + [(200, None), (201, ""), (202, " \t"), (None, "the cat"), (5, rows[5][1]), (5, rows[5][1]), (203, "ÿþ\x7f"), (12, "Qq" * 300), (204, "the cat " * 3000)]


def test_against_plain_python(spark):
    rows = sample()
    df = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "doc_id long, text string, n int, key int, score double").repartition(3)
    for order in (0, 1, 4):
        check(df, rows, order)
    check(df, rows, 2, share=20)


def test_strings_beyond_the_broadcast(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for order, most in ((4, 60), (3, 0), (0, 5), (5, 700)):
        check(df, rows, order, most=most)


def test_no_training_and_empty(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    keys = [k for k in range(100) if is_out(k)][:3]
    rows = [(k, "a b") for k in keys]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 3)


def test_bounded_trie_is_a_distribution(spark):
    rows = sample()
    from tessera.llm.ppm import _texts, fit, gathered
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trie = fit(gathered(_texts(df, "text", F.col("doc_id")), 3), 3, most=60)
    assert all(len(n) <= 60 for n in trie.n)
    for context in (b"the", b"\xff\xff\xff", b"zzz", b"w1 ", b"at."):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10 ** trie.scores(keys)).sum() == pytest.approx(1, abs=1e-9)


def test_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000, dtype=np.uint64))
    t = Table(keys[::2])
    assert t.find(keys).tolist() == [i // 2 if i % 2 == 0 else -1 for i in range(len(keys))]


def test_held_out_texts_are_likelier_than_by_words(spark):
    rows = op9_ppm(spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert len(rows) > 1000 and sum(r.score for r in rows) > sum(r.base_score for r in rows)
