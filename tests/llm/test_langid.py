import itertools
import random
import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.langid import best_paths, keep_known, learn, op1_language, pieces, predict, words_in


def test_paths_against_all_paths():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 1, 5, 2, 5])
    scores = rng.normal(size=(sizes.sum(), 3)).round(1)
    got, at = best_paths(scores, sizes, 0.7), 0
    for n in sizes:
        own = scores[at:at + n]

        def value(p):
            return sum(own[i, s] for i, s in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))

        assert abs(value(tuple(got[at:at + n])) - max(map(value, itertools.product(range(3), repeat=n)))) < 1e-9
        at += n


def test_words_against_plain_python():
    rng = random.Random(3)
    for _ in range(200):
        s = "".join(rng.choice("abÉß ́\n1.日本и İʰ　_") for _ in range(rng.randint(0, 30)))
        want, i = [], 0
        while i < len(s):
            j = i
            while j < len(s) and unicodedata.category(s[j])[0] in "LM":
                j += 1
            if any(c for c in s[i:j] if unicodedata.category(c)[0] == "L"):
                want.append((i, j))
            i = max(j, i + 1)
        w = words_in(s)
        assert list(zip(w.start.tolist(), w.end.tolist())) == want
        assert len(w.cell) == sum(b - a for a, b in want)
    assert words_in("Abc").cell.tolist() == words_in("x abc y").cell.tolist()[1:4]


def test_pieces():
    t = "ab cd\n" * 100 + "x" * 500
    assert "".join(pieces(t, 64)) == t and max(map(len, pieces(t, 64))) <= 64
    assert [p for p in pieces("", 9)] == []


WORDS = {"en": "the cat and this house with that water".split(), "de": "der hund und dieses haus mit jenem wasser schön".split(), "ru": "кот и этот дом с водой тут".split()}


def corpus(rng, n=60):
    out = []
    for lang, words in WORDS.items():
        out += [(lang, " ".join(rng.choice(words) for _ in range(25))) for _ in range(n)]
    return out


def test_spans_of_mixed_texts(spark):
    rng = random.Random(4)
    rows = [(i, t, lang, 0, "x") for i, (lang, t) in enumerate(corpus(rng))]
    rows += [(900, None, "en", 0, "x"), (901, "the cat", None, 0, "x"), (902, "123 ...", "de", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string")
    model = learn(df)
    assert model.languages == ["de", "en", "ru"]
    assert not model.candidates[langid.NAMES.index("cyrillic")][:2].any()
    parts = [("de", "der hund und jenem haus mit dieses wasser"), ("en", "the cat with this water and that house"), ("ru", "кот и этот дом")]
    text = " 1, ".join(t for _, t in parts)
    tests = [(1, text), (2, None), (3, ""), (4, "42 !"), (5, "кот"), (6, "the " * 200_000), (7, text), (7, text), (8, "日本")]
    got = predict(spark.createDataFrame([(*t, 9) for t in tests], "doc_id long, text string, spans int"), model, F.col("doc_id"), spans=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(tests)
    assert [(text[s.start:s.end], s.lang) for s in by[1].spans] == [(t, lang) for lang, t in parts]
    assert (by[1].lang_pred, by[1].spans) == (by[7].lang_pred, by[7].spans)
    assert [(by[i].lang_pred, by[i].score) for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert by[5].lang_pred == "ru" and by[6].lang_pred == "en" and by[6].score == 1 and by[8].lang_pred in model.languages
    left = keep_known(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [*range(len(rows) - 3), 901]


def test_nothing_learned_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert predict(df, learn(df), F.col("doc_id")).collect()[0].lang_pred == "und"
    assert predict(df.limit(0), learn(df.limit(0)), F.col("doc_id")).count() == 0


def test_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op1_language(spark, sf).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in out) >= 0.98 * len(out)


def test_more_languages_than_the_dense_model_takes(spark, monkeypatch):
    import random

    rng = random.Random(9)
    own = {f"l{k:03}": ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(30)] for k in range(300)}
    rows = [(i, " ".join(rng.choices(own[x], k=40)), x) for i, x in enumerate([*own] * 4)]
    df = spark.createDataFrame([*rows, (-1, None, "l000"), (-2, "12 !", None)], "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert len(model.languages) == 300 and model.weights is None
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model, F.col("doc_id")).collect()}
    assert got[-1] == got[-2] == "und" and sum(got[i] == x for i, _, x in rows) > 0.99 * len(rows)
    # both kinds of model give the same scores
    few = df.where("lang < 'l020'")
    dense = langid.learn(few)
    monkeypatch.setattr(langid, "LANGUAGES", 5)
    sparse = langid.learn(few)
    w = langid.words_in(" ".join(t for _, t, _ in rows[:50]))
    np.testing.assert_allclose(dense.scores(w), sparse.scores(w), rtol=1e-4)
    assert keep_known(df).columns == df.columns


def slow_words(s):
    """(letters, script, cells) of the words of a text, character by character."""
    def script(c):
        return next((n for n, blocks in enumerate(langid.SCRIPTS.values(), 1) if any(a <= ord(c) <= b for a, b in blocks)), 0)

    def cell(a, b, c):
        x = sum(v * m for v, m in zip((a, b, c), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))) % 2**64
        x ^= x >> 29
        return (x * 0xBF58476D1CE4E5B9) % 2**64 >> 48

    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    out, i = [], 0
    while i < len(low):
        j = i
        while j < len(low) and unicodedata.category(low[j])[0] in "LM":
            j += 1
        letters = [c for c in low[i:j] if unicodedata.category(c)[0] == "L"]
        if letters:
            codes = [0, *map(ord, low[i:j]), 0]
            out.append((len(letters), next((script(c) for c in letters if script(c)), 0), [cell(*codes[k:k + 3]) for k in range(len(codes) - 2)]))
        i = max(j, i + 1)
    return out


def test_whole_query_against_plain_python(spark):
    """Counts, candidates, scores and the best path of every document."""
    from collections import Counter

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs}
    words = {r.doc_id: slow_words(r.text or "") for r in docs}
    cells, scripts = {}, {}
    for r in docs:
        if not held[r.doc_id] and r.lang is not None and r.text is not None:
            for _, script, found in words[r.doc_id]:
                cells.setdefault(r.lang, Counter()).update(found)
                scripts.setdefault(r.lang, Counter())[script] += 1
    languages = sorted(cells)
    total = {x: sum(c.values()) + 0.5 * langid.CELLS for x, c in cells.items()}

    def tried(script):
        own = [x for x in languages if scripts[x][script] >= max(1, langid.SCRIPT_SHARE * sum(scripts[x].values()))]
        return languages if script == 0 or not own else own

    got = {r.doc_id: r for r in op1_language(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        found, best, back = words[r.doc_id], None, []
        for _, script, own in found:
            score = {x: sum(np.float32(np.log((cells[x][c] + 0.5) / total[x])) for c in own) if x in tried(script) else -1e6 for x in languages}
            if best is None:
                best = score
                continue
            top = max(best.values())
            back.append({x: x if best[x] >= top - langid.PENALTY else min(y for y in languages if best[y] == top) for x in languages})
            best = {x: score[x] + max(best[x], top - langid.PENALTY) for x in languages}
        held_by, state = Counter(), best and min(x for x in languages if best[x] == max(best.values()))
        for k in range(len(found) - 1, -1, -1):
            held_by[state] += found[k][0]
            state = back[k - 1][state] if k else state
        want = min((x for x in held_by if held_by[x] == max(held_by.values())), default="und")
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (want, held[r.doc_id]), r.doc_id
        assert abs(got[r.doc_id].score - (held_by[want] / sum(held_by.values()) if held_by else 0.0)) < 1e-9
