import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import pieces
from tessera.llm.pieces import SPACE, Pieces, digests, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def ours():
    return Pieces.load(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(ours, library, texts):
    for t, e in zip(texts, library.encode(texts, num_threads=1)):
        assert ours.encode(t) == e, repr(t[:200])
        assert ours.decode([1, *e, 2]) == library.decode([1, *e, 2])


BITS = ["the ", "don't ", "tion", "ing", "  ", "    ", "12", "½", "é", "é", "日本", "!!", "\x00", "\x85", "　", "\n", "\n\n", "\t", "\r\n", "<s>", "</s>",
        "<unk>", "<0x41>", SPACE, "a" + SPACE, "\U0001d4b3", "\U0001f642", "﻿", "ß", "aaaa", "ooo", "....", "----", "ŝ", "קש", "ಕ", "각", "=", "=="]


def test_texts(ours, library):
    rng = random.Random(1)
    same(ours, library, ["", " ", "  ", " a", "a ", SPACE, "\n", *BITS, *("".join(rng.choice(BITS) for _ in range(rng.randint(1, 40))) for _ in range(3000))])


def test_every_character_and_every_piece(ours, library):
    same(ours, library, ["x" + "x".join(chr(i) for i in range(a, a + 64) if not 0xD800 <= i < 0xE000) for a in range(0, 0x30000, 64)])
    same(ours, library, [library.id_to_piece(i) for i in range(32000)])


def test_joined_pieces_against_the_library(ours, library):
    rng = random.Random(2)
    known = [t for t in ours.text[:ours.size] if t]
    same(ours, library, ["".join(rng.choice(known) for _ in range(rng.randint(2, 12))).replace(SPACE, " ") for _ in range(5000)])


def test_long_stretches_and_portions(ours, library, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aeinrst") for _ in range(20_000)), "a" * 5000, " " * 3000, "ab" * 4000, "日本語" * 900, "the cat  sat " * 3000]
    same(ours, library, texts)
    monkeypatch.setattr(pieces, "PORTION", 50)
    same(ours, library, [*texts, *("".join(rng.choice(BITS) for _ in range(200)) for _ in range(200))])


def test_decoding_of_any_ids(ours, library):
    rng = random.Random(4)
    special = [0, 1, 2, *range(3, 259), 28705, 259]
    for _ in range(3000):
        ids = [rng.choice(special) if rng.random() < 0.6 else rng.randrange(32000) for _ in range(rng.randint(0, 12))]
        assert ours.decode(ids) == library.decode(ids), ids
        d, k = ours.decoder(), rng.randint(0, len(ids))
        assert d.feed(np.array(ids[:k], int)) + d.feed(np.array(ids[k:], int)) + d.close() == library.decode(ids), ids


def test_prefixes_end_with_the_table(ours, library):
    s = SPACE + "internationalisation..."
    last = ours.table(s)
    for i in range(1, len(s) + 1):
        assert last[i - 1] == library.encode(s[1:i] if i > 1 else " ")[-1] or i == 1


def test_rows(spark, library):
    texts = [None, "", "The cat", "The cat", "x" * 100_000, "Don't stop " * 20_000, " \n é", "ÀÉ \n 12"]
    df = spark.createDataFrame([(i % 7, t, 0, [1]) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids array<int>")

    def want(t):
        e = library.encode(t or "", add_bos=True, add_eos=True)
        back = library.decode(e)
        return len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    assert sorted(map(tuple, digests(df).collect())) == sorted((i % 7, *want(t)) for i, t in enumerate(texts))
    more = sorted((r.doc_id, r.ids, r.decoded) for r in encode(df).collect())
    assert more == sorted((i % 7, e, library.decode(e)) for i, t in enumerate(texts) for e in [library.encode(t or "", add_bos=True, add_eos=True)])
    assert digests(df.limit(0)).count() == 0
    keys = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id string, text string")
    assert [r.n_tokens for r in digests(keys).collect()] == [3, 3]


def test_given_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in digests(docs).collect():
        e = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(e).encode()).hexdigest()
