import random

import numpy as np
import pytest

from tessera.operators import mentions as mn
from tessera.operators import sparse
from tessera.operators.cluster import blind_mentions


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(300)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randint(1, 60))
        texts.append(" ".join(t))
    return texts + [texts[0]] * 5


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_join_is_that_of_all_pairs(spark, threshold):
    texts = corpus(7)
    df = spark.createDataFrame([*((1000 - i, t) for i, t in enumerate(texts)), (1, None), (2, " \n")], "doc_id long, text string")
    vectors = sparse.tfidf(df, bits=14)
    rows = {r.id: {t.term: t.weight for t in r.vector} for r in vectors.collect()}
    assert len(rows) == len(texts) and all(abs(sum(w * w for w in v.values()) - 1) < 1e-9 for v in rows.values())
    assert all(list(r.vector) == sorted(r.vector) for r in vectors.collect())
    pairs, members = sparse.cosine_join(vectors, threshold)
    same = {}
    for i in sorted(rows):
        same[i] = next((k for k in sorted(rows) if rows[k] == rows[i]), i)
    assert {r.id: r.same for r in members.collect()} == same
    first = sorted(set(same.values()))
    want = {(a, b): c for k, a in enumerate(first) for b in first[k + 1:] if (c := sum(w * rows[b].get(t, 0.0) for t, w in rows[a].items())) >= threshold}
    got = {(r.id1, r.id2): r.cosine for r in pairs.collect()}
    near = {p for p in got.keys() ^ want.keys() if abs(got.get(p, want.get(p)) - threshold) < 1e-9}
    assert got.keys() ^ want.keys() == near and all(abs(got[p] - want[p]) < 1e-9 for p in got.keys() & want.keys())
    assert threshold == 1.0 or len(want) > 10


def test_join_of_nothing(spark):
    pairs, members = sparse.cosine_join(sparse.tfidf(spark.createDataFrame([(1, None)], "doc_id long, text string")), 0.5)
    assert pairs.count() == members.count() == 0


def slow_spans(text, words):
    out, i = [], 0
    while i < len(text):
        best = max((len(w) for w in words if text.startswith(w, i)), default=0)
        if best:
            out.append((i, i + best))
        i += best or 1
    return out


def test_spans_are_leftmost_and_longest(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcé", k=rng.randint(1, 6))) for _ in range(60)} - {"a", "b", "c", "é"})
    texts = [None, "", "xyz", *("".join(rng.choices("abcé x", k=rng.randint(0, 200))) for _ in range(80))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dictionary = spark.createDataFrame([(w,) for w in [*words, words[0], None, ""]], "mention string")
    want = {i: slow_spans(t or "", words) for i, t in enumerate(texts)}
    for most in (1 << 17, 9):  # one automaton, many
        found = mn.mention_spans(df, dictionary, most=most)
        assert {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()} == want
        blinded = {r.doc_id: r.text for r in mn.blind_spans(df, found, token="#").collect()}
        assert blinded == {i: t if t is None else mn.replaced(t, want[i], "#") for i, t in enumerate(texts)}
    assert all(not r.spans for r in mn.mention_spans(df, dictionary.limit(0)).collect())


def test_own_mentions_as_by_replacing_one_after_the_other(spark):
    rng = random.Random(4)
    vocabulary = [f"{c}{k}z" for c in "abcd" for k in range(10, 30)]  # none within another, or across two
    texts = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(50)] + [(50, None)]
    mentions = [(i, w, rng.randint(0, 9)) for i in range(0, 50, 2) for w in rng.sample(vocabulary, 8)] + [(50, "a", 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    m = spark.createDataFrame(mentions, "doc_id long, mention string, start int")
    assert sorted(map(tuple, mn.blind_own(df, m).collect())) == sorted(map(tuple, blind_mentions(df, m).collect()))
    assert np.all([len(r) == 2 for r in mn.blind_own(df, m).collect()])


def test_join_shuffles_no_met_pairs(spark):
    """Blocks of any size give the pairs of one block, and no join on terms or
    on the candidates' vectors is left."""
    df = spark.createDataFrame(list(enumerate(corpus(11))), "doc_id long, text string")
    vectors = sparse.tfidf(df, bits=14)
    pairs, _ = sparse.cosine_join(vectors, 0.6)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, pairs.collect()))
    kept, at_once = sparse.BLOCK, sparse.AT_ONCE
    try:
        sparse.BLOCK, sparse.AT_ONCE = 200, 50
        got = sorted(map(tuple, sparse.cosine_join(vectors, 0.6)[0].collect()))
    finally:
        sparse.BLOCK, sparse.AT_ONCE = kept, at_once
    assert len(want) > 10 and [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-12)


def test_blocks_and_copies_are_not_shuffled(spark):
    """Vectors lie where their blocks were written: nothing deals them out to
    the pairs of blocks, and equal ones are found without them."""
    texts = corpus(13, 700) * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    vectors = sparse.tfidf(df, bits=14)
    pairs, members = sparse.cosine_join(vectors, 0.6)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    none, alone = sparse.cosine_join(vectors, 0.6, compare=False)
    assert none is None and "vector" not in alone._jdf.queryExecution().optimizedPlan().toString()
    first = {}
    same = {i: first.setdefault(" ".join(sorted(t.split())), i) for i, t in enumerate(texts)}
    assert {r.id: r.same for r in members.collect()} == {r.id: r.same for r in alone.collect()} == same
    want, kept = sorted(map(tuple, pairs.collect())), sparse.COPIES
    try:
        sparse.COPIES = 10
        got = sorted(map(tuple, sparse.cosine_join(vectors, 0.6)[0].collect()))
    finally:
        sparse.COPIES = kept
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-12)
    assert {x for r in want for x in r[:2]} <= set(same.values()) and len(want) > 100


def test_counts_of_one_id_are_one_text(spark):
    """Packed counts add up over the rows of an id, also of none."""
    df = spark.createDataFrame([(1, "a b a"), (2, "c"), (1, "b c"), (None, "a"), (None, "a d"), (3, "a a b b c")], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b a b c"), (2, "c"), (None, "a a d"), (3, "a a b b c")], "doc_id long, text string")
    got, want = ({r.id: [tuple(t) for t in r.vector] for r in sparse.tfidf(x.repartition(3), bits=14).collect()} for x in (df, one))
    assert got == want and len(got) == 4 and got[1] == got[3]
