"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at one figure of a text and votes good, votes bad or abstains.
No rule decides alone: expectation-maximisation over the votes of all
documents estimates how often each rule votes bad on good and on bad
documents, and the share of good ones, without labels; a document is kept by
the posterior probability that it is good.

Votes of R rules have at most 3^R patterns.  The corpus is reduced to a count
for each pattern (59,049 rows at most for ten rules), the estimation is one
expression over that row, and the verdicts go back to the documents by a join
with the pattern table, whose size is bounded by the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import WS, cut_lineage, let, read, words_of

WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIGURES = (*BASE, "n_lines", "n_upper", "n_letters", "n_bangs", "n_bare", "n_echoes")


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words that lie in a window of ``k`` words found twice or more.  Windows
    are compared by a 64-bit hash of their words' 64-bit hashes."""
    def of(win: Column) -> Column:
        found = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                             | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        def covered(p: Column) -> Column:
            new = F.transform(p, lambda x, i: F.least(F.lit(k), x - F.coalesce(F.get(p, i - 1), x - F.lit(k))))
            return F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(
            let(found, lambda s: let(places(s), covered)))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - F.lit(k - 1)), lambda i: F.xxhash64(F.slice(h, i, k)))

    return F.when(F.size(words) <= k, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), of)))


def _chars(text: Column, kept: str) -> Column:
    """Characters of a class (the body of a Java character class)."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def figures(text: Column) -> Column:
    """A struct of all figures of a text (null: empty), each a long."""
    def of(t: Column) -> Column:
        def of_words(w: Column) -> Column:
            lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WS}]"))
            return let(lines, lambda own: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _chars(t, "#*$%&|<>").alias("n_symbols"),
                (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.size(own).cast("long").alias("n_lines"),
                _chars(t, r"\p{Lu}").alias("n_upper"),
                _chars(t, r"\p{L}").alias("n_letters"),
                _chars(t, "!").alias("n_bangs"),
                F.size(F.filter(w, lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_bare"),
                F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))).cast("long").alias("n_echoes")))

        return let(words_of(t), of_words)

    return let(F.coalesce(text, F.lit("")), of)


@dataclass(frozen=True)
class Rule:
    """Votes good while ``part`` is in [low, high] times ``whole``, bad beyond
    ``bad_low`` or ``bad_high``, and abstains between and where there is no
    ``whole``."""

    part: str
    whole: str | None
    high: float
    bad_high: float
    low: float = 0.0
    bad_low: float = -1.0

    def vote(self) -> Column:
        whole = F.lit(1) if self.whole is None else F.col(self.whole)
        x = F.col(self.part).cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
        return (F.when((x > self.bad_high) | (x < self.bad_low), -1)
                 .when((x >= self.low) & (x <= self.high), 1).otherwise(0))


RULES = (
    Rule("n_words", None, low=50, high=float("inf"), bad_low=20, bad_high=float("inf")),
    Rule("word_chars", "n_words", low=3.0, high=10.0, bad_low=2.0, bad_high=15.0),
    Rule("n_symbols", "n_words", high=0.02, bad_high=0.1),
    Rule("n_dup_lines", "n_lines", high=0.34, bad_high=0.5),
    Rule("n_repeat_words", "n_words", high=0.1, bad_high=0.3),
    Rule("n_upper", "n_letters", high=0.2, bad_high=0.5),
    Rule("n_letters", "word_chars", low=0.85, high=1.0, bad_low=0.7, bad_high=1.0),
    Rule("n_bangs", "n_words", high=0.05, bad_high=0.2),
    Rule("n_bare", "n_words", high=0.05, bad_high=0.2),
    Rule("n_echoes", "n_words", high=0.05, bad_high=0.2),
)


def vote_code(rules: tuple[Rule, ...] = RULES) -> Column:
    """The votes of all rules as one number in base 3."""
    return sum((r.vote() + 1) * 3 ** j for j, r in enumerate(rules)).cast("long")


def _estimated(patterns: Column, n_rules: int, rounds: int) -> Column:
    """Expectation-maximisation over (votes, n) patterns: struct of the share
    of good documents and, for each rule, how often its vote is bad on good
    and on bad documents.  Pseudo-counts keep every rate inside (0, 1)."""
    def logs(p: Column, rates: Column) -> Column:
        return F.aggregate(F.zip_with(p["votes"], rates, lambda v, r: F.when(v < 0, F.log(r)).when(v > 0, F.log(1 - r)).otherwise(0.0)),
                           F.lit(0.0), lambda a, x: a + x)

    def posterior(p: Column, m: Column) -> Column:
        odds = logs(p, m["bad"]) + F.log(1 - m["good_share"]) - logs(p, m["good"]) - F.log(m["good_share"])
        return 1 / (1 + F.exp(F.least(odds, F.lit(700.0))))

    def rate(weighted: Column, j: int, side: str, bad_votes: float, good_votes: float) -> Column:
        def mass(test) -> Column:
            return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + F.when(test(F.get(x["votes"], F.lit(j))), x[side]).otherwise(0.0))

        return (mass(lambda v: v < 0) + bad_votes) / (mass(lambda v: v != 0) + bad_votes + good_votes)

    def step(m: Column) -> Column:
        weighted = F.transform(patterns, lambda p: let(posterior(p, m), lambda g: F.struct(
            p["votes"].alias("votes"), (g * p["n"]).alias("g"), ((1 - g) * p["n"]).alias("b"))))

        def means(w: Column) -> Column:
            good = F.aggregate(w, F.lit(0.0), lambda a, x: a + x["g"])
            every = F.aggregate(w, F.lit(0.0), lambda a, x: a + x["g"] + x["b"])
            return F.struct(
                ((good + 9.0) / (every + 10.0)).alias("good_share"),
                F.array(*[rate(w, j, "g", 0.1, 9.9) for j in range(n_rules)]).alias("good"),
                F.array(*[rate(w, j, "b", 3.0, 7.0) for j in range(n_rules)]).alias("bad"))

        return let(weighted, means)

    start = F.struct(F.lit(0.9).alias("good_share"), F.array_repeat(F.lit(0.01), n_rules).alias("good"),
                     F.array_repeat(F.lit(0.3), n_rules).alias("bad"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda m, _: step(m))


def estimate(codes: DataFrame, code: str = "_code", n_rules: int = len(RULES), rounds: int = 25) -> DataFrame:
    """``code`` and ``p_good`` for every pattern of votes in ``codes``; at
    most 3 ** n_rules rows."""
    def votes(c: Column) -> Column:
        return F.array(*[(F.floor(c / 3 ** j) % 3 - 1).cast("int") for j in range(n_rules)])

    def logs(p: Column, rates: Column) -> Column:
        return F.aggregate(F.zip_with(p["votes"], rates, lambda v, r: F.when(v < 0, F.log(r)).when(v > 0, F.log(1 - r)).otherwise(0.0)),
                           F.lit(0.0), lambda a, x: a + x)

    counts = codes.groupBy(code).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = counts.select(F.struct(F.col(code).alias("code"), votes(F.col(code)).alias("votes"), "n").alias("p"))
    one = cut_lineage(one.agg(F.sort_array(F.collect_list("p")).alias("patterns")))
    model = cut_lineage(one.select("patterns", _estimated(F.col("patterns"), n_rules, rounds).alias("m")))
    rows = model.select("m", F.explode("patterns").alias("p"))
    m, p = F.col("m"), F.col("p")
    odds = logs(p, m["bad"]) + F.log(1 - m["good_share"]) - logs(p, m["good"]) - F.log(m["good_share"])
    return rows.select(p["code"].alias(code), (1 / (1 + F.exp(F.least(odds, F.lit(700.0))))).alias("p_good"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(texts: DataFrame, model: DataFrame) -> DataFrame:
    """Figures with ``_code``, judged by a model of ``estimate``: adds
    base_failed, p_good and kept."""
    rows = texts.join(F.broadcast(model), "_code")
    return rows.select("*", base_failed().alias("base_failed"), (~base_failed() & (F.col("p_good") >= 0.5)).alias("kept")).drop("_code")


def _with_figures(docs: DataFrame, text: str, *carried: Column) -> DataFrame:
    # generated, not projected: a filter on a figure would else take all of them again
    rows = docs.select(*carried, F.inline(F.array(figures(F.col(text)))))
    return rows.withColumn("_code", vote_code())


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the figures, p_good, base_failed and kept of every row.

    Null and empty texts have no words and fail the base test.  Equal texts
    get equal results, repeated rows stay separate; an empty table gives an
    empty result; other columns are not read.
    """
    rows = cut_lineage(_with_figures(docs, text, F.col(key).alias("_key")))
    return judged(rows, estimate(rows)).withColumnRenamed("_key", key)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.  The figures
    are taken once: rows are written with their pattern of votes (those that
    fail the base test without their columns), and filtered by the model that
    is estimated from the patterns.  No text goes through a shuffle."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")
    rows = _with_figures(docs, text, whole).select("_code", F.when(~base_failed(), F.col("_whole")).alias("_row"))
    rows = cut_lineage(rows)
    kept = rows.join(F.broadcast(estimate(rows)), "_code").where(F.col("_row").isNotNull() & (F.col("p_good") >= 0.5))
    return kept.select("_row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", *BASE, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def _sql(rounds: int = 25) -> str:
    """The same with windows as strings, and the estimation as a recursion
    over one row of rates."""
    def vote(r: Rule) -> str:
        x = f"(CAST({r.part} AS DOUBLE) / {'1' if r.whole is None else f'nullif({r.whole}, 0)'})"
        high = "TRUE" if r.high == float("inf") else f"{x} <= {r.high}"
        bad = f"{x} < {r.bad_low}" + ("" if r.bad_high == float("inf") else f" OR {x} > {r.bad_high}")
        return f"CASE WHEN {bad} THEN -1 WHEN {x} >= {r.low} AND {high} THEN 1 ELSE 0 END"

    n = range(len(RULES))
    def logs(side: str) -> str:
        return " + ".join(f"(CASE WHEN v{j} < 0 THEN ln({side}{j}) WHEN v{j} > 0 THEN ln(1 - {side}{j}) ELSE 0 END)" for j in n)

    posterior = f"1 / (1 + exp(least(({logs('b')}) + ln(1 - share) - ({logs('g')}) - ln(share), 700)))"
    def rate(j: int, weight: str, bad: float, both: float) -> str:
        return (f"(sum(CASE WHEN v{j} < 0 THEN {weight} ELSE 0 END) + {bad}) / (sum(CASE WHEN v{j} <> 0 THEN {weight} ELSE 0 END) + {both})")

    new = ", ".join([f"(sum(n * p) + 9) / (sum(n) + 10)", *[rate(j, "n * p", 0.1, 10) for j in n], *[rate(j, "n * (1 - p)", 3, 10) for j in n]])
    names = ", ".join(["share", *[f"g{j}" for j in n], *[f"b{j}" for j in n]])
    start = ", ".join(["0.9::DOUBLE", *["0.01::DOUBLE" for _ in n], *["0.3::DOUBLE" for _ in n]])
    votes = ", ".join(f"v{j}" for j in n)
    ws = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: {{'p': i, 's': array_to_string(w[i:i + 7], ' ')}})) AS x FROM t WHERE len(w) > 8),
twice AS (SELECT doc_id, x.p AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x.s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY doc_id),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(cov.c, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]'))) AS n_bare,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echoes
  FROM t LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, {', '.join(f'{vote(r)} AS v{j}' for j, r in enumerate(RULES))} FROM f),
pat AS (SELECT {votes}, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY ALL),
em(it, {names}) AS (SELECT 0, {start} UNION ALL
  SELECT it + 1, {new} FROM (SELECT *, {posterior} AS p FROM em, pat WHERE it < {rounds}) GROUP BY it),
post AS (SELECT {votes}, {posterior} AS p FROM pat, em WHERE it = {rounds}),
j AS (SELECT v.*, p, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed FROM v JOIN post USING ({votes}))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       failed AS base_failed, NOT failed AND p >= 0.5 AS kept, round(p, 6) AS p_good FROM j"""


ORACLE_SQL = _sql()
