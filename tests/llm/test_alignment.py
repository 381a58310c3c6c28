import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from tessera.llm import alignment as A
from tessera.llm.bpe import byte_symbols

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def slow(libraries, texts):
    """All columns but the key, by walking over the tokens of each text."""
    first, second = libraries
    byte = {s: b for b, s in enumerate(byte_symbols())}
    links, groups, sizes = [], [], []
    for t in texts:
        a, b = (first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)) if t else ([], [])
        x = [bytes(byte[c] for c in first.id_to_token(i)) for i in a]
        y = [bytes([int(p[3:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            a = b = x = y = []
        sizes.append((len(a), len(b)))
        i = j = end_a = end_b = 0
        own, mine, theirs, parts = [], [], [], []
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                start = end_a
                end_a += len(x[i])
                mine.append(a[i])
                i += 1
                if start < end_b:
                    own.append((mine[-1], theirs[-1]))
            else:
                end_b += len(y[j])
                theirs.append(b[j])
                j += 1
                own.append((mine[-1], theirs[-1]))
            if end_a == end_b:
                parts.append((mine, theirs))
                mine, theirs = [], []
        links.append(own)
        groups.append(parts)
    n = Counter(p for own in links for p in own)
    best = {}
    for (_, b), k in n.items():
        best[b] = max(best.get(b, 0), k)
    return n, [(*s, len(g), len(own), sum(n[p] == best[p[1]] for p in own), sum(n[p] for p in own),
                ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)) for s, own, g in zip(sizes, links, groups)]


def overlaps(a_sizes, b_sizes):
    spans = lambda v: [(sum(v[:i]), sum(v[:i + 1])) for i in range(len(v))]
    return [(i, j) for i, (p, q) in enumerate(spans(a_sizes)) for j, (r, s) in enumerate(spans(b_sizes)) if max(p, r) < min(q, s)]


def test_links_are_the_overlapping_pairs():
    rng = np.random.default_rng(1)
    a_size, b_size = rng.integers(1, 6, 50), rng.integers(1, 6, 40)
    tokens, want = [], []
    while len(tokens) < 60:
        a, b = rng.integers(0, 50, rng.integers(0, 12)), rng.integers(0, 40, rng.integers(0, 12))
        if a_size[a].sum() != b_size[b].sum():
            continue
        tokens.append((a.astype(np.uint32), b.astype(np.uint32)))
        want.append(sorted((int(a[i]), int(b[j])) for i, j in overlaps(a_size[a].tolist(), b_size[b].tolist())))
    x = A.align(tokens, a_size, b_size)
    pairs = x.pairs(40)
    for own, start, end in zip(want, x.links, x.links[1:]):
        assert sorted((p // 40, p % 40) for p in pairs[start:end].tolist()) == own


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 200_000])
def test_hash_is_perfect_and_minimal(n):
    keys = np.random.default_rng(n).choice(1_600_000_000, n, replace=False)
    sizes, words = A.build(keys)
    index = A.Hash([sizes], [words]).index(keys, np.zeros(n, np.int64))
    assert np.array_equal(np.sort(index), np.arange(n))


def test_table_verifies_keys():
    keys = np.unique(np.random.default_rng(3).integers(0, 10**9, 50_000))
    own = A.segment_of(keys)
    levels, words, kept = [], [], []
    for s in range(A.SEGMENTS):
        k = keys[own == s]
        sizes, bits = A.build(k)
        at = A.Hash([sizes], [bits]).index(k, np.zeros(len(k), np.int64))
        ordered = np.empty_like(k)
        ordered[at] = k
        levels.append(sizes), words.append(bits), kept.append(ordered)
    flat = np.concatenate(kept)
    table = A.Table(A.Hash(levels, words), flat, flat + 1)
    asked = np.concatenate([keys, keys + 1])
    assert np.array_equal(table.look_up(asked), np.where(np.isin(asked, keys), asked + 1, 0))


def test_quick_path_is_the_library(libraries):
    t = A.Tokenizers.load()
    assert t.ready()["quick"]
    chars = [chr(c) for c in range(A.PLAIN)]
    texts = ["".join(f"{p}{c}{q}" for p in ("a", " ", "1", "!", "'") for q in ("b", " ", "2", "?", "s ")) for c in chars]
    texts += ["it's we'LL 'S  \n\n x", " ", "  ", "\xa0\xa0 a", "<|endoftext|> x", "x" * 5000, " " * 5000 + "a", "日本 Ᲊ", "a b"]
    assert [s for s in texts if not t._ordinary(s)] == texts[-4:]
    for s, (a, b) in zip(texts, t.encode(texts)):
        assert a.tolist() == libraries[0].encode(" " + s, add_special_tokens=False).ids
        assert b.tolist() == libraries[1].encode(s)


def test_rows_small_tables_and_joins(spark, libraries, monkeypatch):
    monkeypatch.setattr(A, "FAN", 2)
    texts = [None, "", "The cat sat", "The cat sat", "x▁y", "internationalisation of internationalisations", "日本語 é 🙂 x", "<s> </s> <|endoftext|>", " ", "z" * 30_000,
             "the cat " * 5000] + [f"cat {i} dog{i}" for i in range(60)]
    df = spark.createDataFrame([(i % 50, t, "q", 1) for i, t in enumerate(texts)], "doc_id int, text string, a string, n long").repartition(7)
    n, want = slow(libraries, texts)
    want = sorted((i % 50, *w) for i, w in enumerate(want))
    assert want[0][1:] == (0, 0, 0, 0, 0, 0, "") and sum(w[1] for w in want) > 0
    for hot in (A.HOT, 40, 0):
        got = A.aligned(df, hot=hot, keep_groups=True)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        assert sorted(map(tuple, got.collect())) == want
    assert {(r.a, r.b): r.n for r in A.pair_counts(df).collect()} == n
    assert A.aligned(df.limit(0)).count() == 0
    assert [tuple(r) for r in A.aligned(df.where("text is null")).collect()] == [(0, 0, 0, 0, 0, 0, 0, "")]


def test_whole_query(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    _, want = slow(libraries, [r.text for r in docs])
    got = sorted(map(tuple, A.op13_alignment(spark, SF).collect()))
    assert got == sorted((r.doc_id, *w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else "") for r, w in zip(docs, want))
