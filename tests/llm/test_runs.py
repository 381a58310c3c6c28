import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import runs as R


def slow(w, least=24, times=3):
    """All runs of a list, by comparing the words of every distance."""
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)  # periods come in rising order
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_texts(seed, how_many):
    rng = random.Random(seed)
    for _ in range(how_many):
        out = []
        while len(out) < rng.randint(0, 220):
            kind, letters = rng.random(), rng.choice(["ab", "abc", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
            if kind < 0.45:
                unit = rng.choices(letters, k=rng.randint(1, rng.choice([2, 5, 12, 40])))
                out += (unit * 40)[:rng.randint(1, rng.choice([30, 60, 130]))]
            elif kind < 0.6 and out:
                a = rng.randrange(len(out))
                out += out[a:a + rng.randint(1, 40)]
            else:
                out += rng.choices(letters, k=rng.randint(1, 30))
        yield out


def test_trees_against_all_distances():
    texts = [*some_texts(1, 1500), ["a"] * 300, list("ab") * 100, list("aab") * 50 + list("b") * 60, [], ["a"], ["a"] * 23, ["a"] * 24]
    want = [slow(t) for t in texts]
    assert sum(map(len, want)) > 1000
    numbered = [[1 + ord(c) - 97 for c in t] for t in texts]
    assert [sorted(f, key=lambda r: (r[0], r[2])) for f in R.runs_of(numbered)] == want
    assert R.of_texts([[c.encode() for c in t] for t in texts]) == want


def test_common_extensions():
    rng = random.Random(5)
    texts = [[rng.randint(1, 3) for _ in range(rng.randint(1, 80))] for _ in range(60)]
    forest = R.Forest(texts)
    base = 0
    for t in texts:
        n = len(t)
        pairs = [(i, j) for i in range(n) for j in range(n + 1) if i != j]
        got = forest.common(np.array([base + i for i, _ in pairs]), np.array([base + j for _, j in pairs])) if pairs else []
        for (i, j), c in zip(pairs, got):
            k = 0
            while max(i, j) + k < n and t[i + k] == t[j + k]:
                k += 1
            assert c == k
        order = sorted(range(n), key=lambda i: [*t[i:], 0])
        assert order == sorted(range(n), key=lambda i: forest.rank[base + i])
        last = sorted(range(n), key=lambda i: [*t[i:], 9])
        assert last == sorted(range(n), key=lambda i: forest.opposite[base + i])
        base += n + 1


def test_long_periods_and_small_forests(monkeypatch):
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        unit = [str(rng.randint(0, 400)) for _ in range(rng.randint(100, 400))]
        texts.append([str(rng.randint(0, 9)) for _ in range(rng.randint(0, 90))] + (unit * 4)[:rng.randint(2, 4) * len(unit)] + unit[:50])
    want = [slow(t) for t in texts]
    assert sum(map(len, want)) > 20
    given = [[w.encode() for w in t] for t in texts]
    assert R.of_texts(given) == want
    monkeypatch.setattr(R, "FOREST", 500)
    assert R.of_texts(given) == want


def test_nothing_repeats_nothing_is_built(monkeypatch):
    monkeypatch.setattr(R, "Forest", None)
    assert R.of_texts([[str(i).encode() for i in range(5000)], [], [b"a"] * 10]) == [[], [], []]


def split(text):
    return (text or "").encode().split()


def changed(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(words):
    found = slow(words)
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return (len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_whole_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *digest(changed(r.doc_id, split(r.text)))) for r in docs if len(r.text or "") < 30_000)
    got = {r.doc_id: tuple(r) for r in R.op11_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs) and [got[w[0]] for w in want] == want
    assert sum(w[1] > 0 for w in want) > 5


def test_rows(spark):
    texts = [None, "", " \n ", "a " * 30, "a " * 30, " x \x85y " * 20, "é\x0bü\x0c" * 24, "one two three", "w " * 50_000]
    df = spark.createDataFrame([(i % 4, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, runs long, _key string")
    got = sorted(map(tuple, R.digests(df).collect()), key=repr)
    small = [(i % 4, *digest(split(t))) for i, t in enumerate(texts[:-1])]
    long = hashlib.sha256(b"0,50000,1\n").hexdigest()
    assert got == sorted([*small, (0, 1, 0, 50_000, 1, 50_000_000, long, hashlib.sha256(b"w").hexdigest())], key=repr)
    spans = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in R.runs(df.limit(8)).collect())
    assert (3, 30, [(0, 30, 1)], "a") in spans and (0, 0, [], "") in spans
    assert R.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("key", [None, 10, 3])
def test_made_periodic(spark, key):
    words = [str(i) for i in range(57)]
    df = spark.createDataFrame([(k, " ".join(words)) for k in range(200)], "k int, t string")
    for r in df.select("k", R.made_periodic(F.col("k"), F.col("t")).alias("t")).collect():
        assert r.t.split() == changed(r.k, words)
