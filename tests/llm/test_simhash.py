import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm.simhash import fingerprint, keep_one, near_duplicates, near_links, word_runs


def slow_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def slow_components(keys, fps, most):
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                up[root(i)] = root(j)
    low = {}
    for i, k in enumerate(keys):
        if k is not None:
            low[root(i)] = min(k, low.get(root(i), k))
    return [low.get(root(i)) for i in range(len(keys))]


def test_fingerprint_by_hand_and_in_pieces():
    rng = random.Random(1)
    texts = ["", " \t\n", "A", "a b", "A b C", "É x y z", "a\x0bb\x1fc d e f"]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    for t in texts:
        for k in (1, 3, 5):
            assert np.int64(fingerprint(t.encode(), k)).view(np.uint64).item() == slow_fingerprint(t, k)
    long = (" ".join(texts) * 40).encode()
    assert [w for r in word_runs(long, 100) for w in r] == long.split()


def test_components_against_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([2, 30, 200, 400]))] for _ in range(25)]
    texts = [None, "", "  ", "a"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randint(0, 8)):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    texts += [texts[5]] * 150
    keys = [None if i == 9 else 1000 - i for i in range(len(texts))]
    keys[12] = keys[13]
    df = spark.createDataFrame([(k, t, 0, 0) for k, t in zip(keys, texts)], "doc_id long, text string, _fp int, component_id int")
    fps = [slow_fingerprint(t) for t in texts]
    got = near_duplicates(df).collect()
    want = slow_components(keys, fps, 2)
    assert sorted(map(repr, got)) == sorted(
        f"Row(doc_id={k!r}, fingerprint='{f:016x}', component_id={c!r})" for k, f, c in zip(keys, fps, want))
    left = keep_one(df).select("doc_id").collect()
    assert sorted(r[0] for r in left if r[0] is not None) == sorted(k for k, c in zip(keys, want) if k is not None and k == c)
    exact = {r.doc_id: r.component_id for r in near_duplicates(df, most=0).collect()}
    assert all(exact[k] == c for k, c in zip(keys, slow_components(keys, fps, 0)) if k is not None)


def test_one_row_of_each_group(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (3, a), (3, b), (None, c), (None, c), (None, d), (4, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (0, 2):
        assert sorted(map(repr, map(tuple, keep_one(df, most=most).collect()))) == sorted(map(repr, [(1, a), (3, b), (None, c), (4, d)]))


def test_long_lists_and_all_distances(spark):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(4000):
        x = rng.choice(list(fps)) if rng.random() < .1 else centre
        for b in rng.sample(range(16), rng.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1, 3}
    fps = sorted(fps)
    signed = [np.uint64(x).astype(np.int64).item() for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "_fp long")
    for most in (1, 2, 3):
        links = near_links(df, most).collect()
        up = {x: x for x in signed}

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for a, b in links:
            assert (np.int64(a).view(np.uint64).item() ^ np.int64(b).view(np.uint64).item()).bit_count() <= most
            up[root(a)] = root(b)
        arr = np.array(fps, np.uint64)
        for i, x in enumerate(arr):
            near = np.flatnonzero(np.bitwise_count(arr ^ x) <= most)
            assert len({root(signed[j]) for j in near}) == 1
        assert len(links) < 40 * len(fps)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d", 7, "x", 1.5), (1, "a b c d", 8, "y", None), (None, "e f g h", None, "z", 0.0), (3, None, 9, None, 2.0), (4, "", 1, "q", 3.0)]
    names = ["doc_id", "text", "_row", "_key", "a.b"]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long, _key string, `a.b` double")
    got = keep_one(df)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], rows[2], rows[3]], key=repr)
