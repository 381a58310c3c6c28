"""Cleaning, first-word typing, length and overlap profiles (P1-P5, A1-A3,
B7, A11, T3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import profile
from tessera.plans import derived
from tessera.plans import sqltext as sq
from tessera.plans.catalog import register

R = 6


@register("clean_text", "P1", f"""
SELECT doc_id, {sq.clean('text')} AS text_clean FROM documents""")
def clean_text(spark, sf):
    return derived.documents(spark, sf).select("doc_id", tx.clean_text("text").alias("text_clean"))


@register("first_word", "P2", f"""
SELECT doc_id, {sq.first_word('text')} AS question_word FROM documents""")
def first_word(spark, sf):
    return derived.documents(spark, sf).select("doc_id", tx.first_word("text").alias("question_word"))


@register("rare_category", "P2 P3 J4", f"""
WITH w AS (SELECT doc_id, {sq.first_word('text')} AS question_word FROM documents),
c AS (SELECT question_word, count(*) AS n FROM w GROUP BY question_word)
SELECT w.doc_id, w.question_word,
       CASE WHEN c.n <= 10 THEN '<rare>' ELSE w.question_word END AS question_word_norm
FROM w LEFT JOIN c ON c.question_word = w.question_word""")
def rare_category(spark, sf):
    words = first_word(spark, sf)
    return profile.collapse_rare(words, "question_word", threshold=10,
                                 out="question_word_norm")


@register("category_counts", "A1", f"""
WITH w AS (SELECT {sq.first_word('text')} AS question_word FROM documents)
SELECT question_word, count(*) AS n,
       round(count(*) / (SELECT count(*) FROM w), {R}) AS share
FROM w GROUP BY question_word""")
def category_counts(spark, sf):
    return profile.category_counts(first_word(spark, sf), "question_word")


@register("word_counts", "P5", f"""
SELECT doc_id, len({sq.ws_tokens('text')}) AS n_words FROM documents""")
def word_counts(spark, sf):
    return derived.documents(spark, sf).select("doc_id", tx.word_count("text").alias("n_words"))


@register("length_profile", "P5 A2", f"""
WITH w AS (SELECT lang, len({sq.ws_tokens('text')}) AS n FROM documents)
SELECT lang, count(*) AS n_docs, min(n) AS min_words, max(n) AS max_words,
       round(avg(n), {R}) AS mean_words,
       round(quantile_cont(n, 0.75), {R}) AS q75, round(quantile_cont(n, 0.9), {R}) AS q90,
       round(quantile_cont(n, 0.95), {R}) AS q95, round(quantile_cont(n, 0.98), {R}) AS q98
FROM w GROUP BY lang""")
def length_profile(spark, sf):
    docs = derived.documents(spark, sf, ("doc_id", "lang", "text")).select(
        "lang", tx.word_count("text").alias("n"))
    return profile.numeric_profile(docs, "n", {"q75": .75, "q90": .9, "q95": .95, "q98": .98},
                                   group=["lang"], prefix="words", count_name="n_docs")


_OVERLAP_SQL = f"""{sq.with_(sq.PAIRS_CONV)}, t AS (
  SELECT conv_id, turn, list_distinct({sq.ws_tokens('lower(target)')}) AS tw,
         list_distinct({sq.ws_tokens('lower(source)')}) AS sw FROM pairs_conv)"""


@register("overlap_scores", "B7", _OVERLAP_SQL + f"""
SELECT conv_id, turn,
       CASE WHEN len(tw) = 0 THEN NULL
            ELSE round(len(list_intersect(tw, sw)) / len(tw), {R}) END AS overlap
FROM t""")
def overlap_scores(spark, sf):
    return profile.target_source_overlap(derived.pairs_conv(spark, sf), keys=["conv_id", "turn"])


@register("overlap_profile", "B7 A3", _OVERLAP_SQL + f""",
o AS (SELECT len(list_intersect(tw, sw)) / len(tw) AS v FROM t WHERE len(tw) > 0)
SELECT count(*) AS n, round(min(v), {R}) AS min_overlap, round(max(v), {R}) AS max_overlap,
       round(avg(v), {R}) AS mean_overlap,
       round(quantile_cont(v, 0.25), {R}) AS q25, round(quantile_cont(v, 0.5), {R}) AS q50,
       round(quantile_cont(v, 0.75), {R}) AS q75, round(quantile_cont(v, 0.9), {R}) AS q90,
       round(quantile_cont(v, 0.95), {R}) AS q95
FROM o""")
def overlap_profile(spark, sf):
    scores = profile.target_source_overlap(derived.pairs_conv(spark, sf), keys=["conv_id", "turn"],
                                           rounded=False)
    return profile.numeric_profile(
        scores.where(F.col("overlap").isNotNull()), "overlap",
        {"q25": .25, "q50": .5, "q75": .75, "q90": .9, "q95": .95}, prefix="overlap",
        count_name="n", with_minmax_round=True)


_NEW_WORDS_SQL = _OVERLAP_SQL + """,
nw AS (SELECT unnest(list_filter(tw, lambda w: NOT list_contains(sw, w))) AS word FROM t)"""


@register("new_word_counts", "A11 X3", _NEW_WORDS_SQL + """
SELECT word, count(*) AS n FROM nw GROUP BY word""")
def new_word_counts(spark, sf):
    return profile.new_word_frequency(derived.pairs_conv(spark, sf))


@register("missing_words", "A11 T3", _NEW_WORDS_SQL + """
SELECT word, count(*) AS n FROM nw GROUP BY word ORDER BY n DESC, word LIMIT 20""")
def missing_words(spark, sf):
    return profile.top_k(profile.new_word_frequency(derived.pairs_conv(spark, sf)), "n", "word", 20)


@register("sentence_lines", "P12 P6 P10", f"""
SELECT doc_id, 'summarize: ' || array_to_string({sq.sentences('text')}, chr(10)) AS text FROM documents""")
def sentence_lines(spark, sf):
    """Every document with a sentence a line, behind a prefix."""
    return derived.documents(spark, sf).select("doc_id", tx.add_prefix(tx.sentence_per_line("text"), "summarize: ").alias("text"))
