import hashlib
import random

import public_tokenizers
import pytest
import tokenizers

from tessera.llm.bpe import Tokenizer, digests, encode, lookahead

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ours():
    return Tokenizer.load(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def same(ours, library, texts):
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ours.encode(t) == e.ids, repr(t[:200])
        assert ours.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


def test_every_character(ours, library):
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    wrong = []
    for at in range(0, len(chars), 4096):
        texts = ["x" + c + "y" + c + "1" for c in chars[at:at + 4096]]
        for c, t, e in zip(chars[at:], texts, library.encode_batch(texts, add_special_tokens=False)):
            if ours.encode(t) != e.ids:
                wrong.append(hex(ord(c)))
    assert not wrong, (len(wrong), wrong[:50])


def test_texts(ours, library):
    rng = random.Random(1)
    bits = ["the ", "don't ", "we'LL", "'S ", "12", "½", "é", "e\u0301", "Σ ", "ΟΔΟΣ", "\u0130", "日本", "!!", "\x00", "\x1c", "\x85",
            "\u3000", "\xa0", "\n", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "ß", "\ufb01", "\u200b", "\U0001d4b3", "\U0001f642", "\ufeff",
            "a\u0327\u0301", "\u1100\u1161\u11a8", "\u2003", "\u202f"]
    texts = ["", " ", "<|endoftext|><|endoftext|> a"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    same(ours, library, texts)


def test_long_words_through_the_window(ours, library):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeinrst") for _ in range(3000)), "a" * 2000, "!" * 3000, "ab" * 1500, "".join(rng.choice(["the", "ing", "tion", "er"]) for _ in range(900)), "é" * 1500]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    ids = list(ours.ids.values())
    for w, e in zip(words, want):
        for window in (None, 1, ours.ahead + 37, 2 * ours.ahead):
            assert [ids[t] for part in ours.word_tokens(w.encode(), window) for t in part] == e


def test_lookahead_of_small_lists():
    assert lookahead([("a", "b")], "") == 3
    # "bc" before "ab": whether c follows decides over a
    assert lookahead([("b", "c"), ("a", "b")], "") == 2 + 2
    assert 0 < Tokenizer.load(PATH).ahead < 2000


def test_text_decoder(ours):
    ids = ours.encode("Zażółć 🙂 <|endoftext|> 日本")
    d = ours.decoder(as_text=True)
    assert "".join([d.feed([i]) for i in ids]) + d.close() == ours.decode(ids, as_text=True) == "zażółć 🙂 <|endoftext|>日本 "


def test_rows(spark, library):
    texts = [None, "", "The cat", "The cat", "x" * 200_000, "Don't stop " * 20_000, "<|endoftext|>", "ÀÉ \n 12"]
    df = spark.createDataFrame([(i, t, 0, [1]) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids array<int>")
    rows = {r.doc_id: r for r in digests(df).collect()}
    more = {r.doc_id: r for r in encode(df).collect()}
    for i, t in enumerate(texts):
        e = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(e, skip_special_tokens=False)
        assert more[i].ids == e and more[i].decoded == back
        assert rows[i].n_tokens == len(e)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert digests(df.limit(0)).count() == 0


def test_given_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in digests(docs).collect():
        e = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest())


def test_a_file_with_a_byte_level_decoder(spark, library, tmpdir_path):
    """The digest of the decoded text is that of the decoder that the file names."""
    import json

    with open(PATH, encoding="utf-8") as f:
        j = json.load(f)
    j["decoder"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True}
    path = f"{tmpdir_path}/t.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(j, f)
    named = tokenizers.Tokenizer.from_file(path)
    texts = ["The café 🙂 naïve <|endoftext|> é", "x" * 9000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in digests(df, path).collect():
        back = named.decode(named.encode(texts[r.doc_id], add_special_tokens=False).ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    t, rng = Tokenizer.load(path), random.Random(7)
    for _ in range(500):
        ids = [rng.randrange(49408) if rng.random() < 0.6 else rng.randrange(256) for _ in range(9)]
        assert t.decode(ids) == named.decode(ids, skip_special_tokens=False)


def test_long_texts_without_white_space(ours, library, monkeypatch):
    from tessera.llm import bpe

    rng = random.Random(8)
    texts = ["".join(rng.choice(["abc", "'s", "!", "é", "9", "<|", "|>", "é", "x-y", "@", "don't", "12.5"]) for _ in range(400)) for _ in range(200)]
    monkeypatch.setattr(bpe, "PIECE", 37)
    same(ours, library, texts)
