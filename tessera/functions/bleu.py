"""BLEU building blocks: the 13a tokeniser (a native regex chain, and the same
in Python) and per-row clipped n-gram statistics from one Arrow UDF
(aggregated by plain sums, never by averaging sentence BLEU)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.rouge import gram_counts, shared

# --- fixed values: 13a tokeniser rules (in application order) ---------------
# 1. punctuation and symbols  { | } ~  [ \ ] ^ _ `  space ! " # $ % &  ( ) * +
#    : ; < = > ? @  /  are split off
# 2. period/comma unless preceded by a digit
# 3. period/comma unless followed by a digit
# 4. dash when preceded by a digit
TOK13A_PUNCT = r"([\{-~\[-` -&(-+:-@/])"
TOK13A_RULES = [
    (TOK13A_PUNCT, " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
# ---------------------------------------------------------------------------


def tokens_13a(col) -> Column:
    x = F.col(col) if isinstance(col, str) else col
    x = F.replace(x, F.lit("<skipped>"), F.lit(""))
    x = F.replace(x, F.lit("-\n"), F.lit(""))
    x = F.replace(x, F.lit("\n"), F.lit(" "))
    for ent, ch in ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for pat, rep in TOK13A_RULES:
        x = F.regexp_replace(x, pat, rep)
    return tx.ws_tokens(x)


_PYTHON_RULES = [(re.compile(pat), rep.replace("$", "\\")) for pat, rep in TOK13A_RULES]


def python_tokens_13a(text: str) -> list[str]:
    """``tokens_13a`` of a Python string."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for ent, ch in ENTITIES:
        text = text.replace(ent, ch)
    text = f" {text} "
    for pat, rep in _PYTHON_RULES:
        text = pat.sub(rep, text)
    return text.split()


def bleu_stats(hyp, ref, tokenizer: str = "13a", max_order: int = 4) -> Column:
    """struct(sys_len, ref_len, m1..m4 clipped matches, t1..t4 totals) of two
    texts, in tokens of 13a or between blanks; a length is null for a null
    text.  An order is only counted where the one below it has a match; a
    reference is taken apart once for the rows in succession that have it."""
    tokens = python_tokens_13a if tokenizer == "13a" else str.split
    names = ["sys_len", "ref_len", *[f"{c}{n}" for c in "mt" for n in range(1, max_order + 1)]]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def stats(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
        rows, last, known, grams = [], None, [], {}
        for h, r in zip(hyp, ref):
            if r != last:
                last, known, grams = r, tokens(r or ""), {}
            own, matches = tokens(h or ""), []
            for n in range(1, max_order + 1):
                if matches and not matches[-1]:
                    matches.append(0)
                    continue
                if n not in grams:
                    grams[n] = gram_counts(known, n)
                matches.append(shared(gram_counts(own, n), grams[n]))
            rows.append([None if h is None else len(own), None if r is None else len(known), *matches, *[max(0, len(own) - n) for n in range(max_order)]])
        return pd.DataFrame({n: pd.array([row[i] for row in rows], "Int64") for i, n in enumerate(names)})

    return stats(hyp, ref)


def corpus_bleu_from_sums(smooth: str = "exp", max_order: int = 4) -> list[Column]:
    """Columns computing BLEU from summed stats ``sys_len, ref_len, m*, t*``."""
    logs = []
    zeros = F.lit(0)
    for n in range(1, max_order + 1):
        m, t = F.col(f"m{n}").cast("double"), F.col(f"t{n}").cast("double")
        zeros = zeros + F.when(F.col(f"m{n}") == 0, 1).otherwise(0)
        if smooth == "exp":
            p = F.when(t == 0, F.lit(0.0)).when(m == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t)) \
                 .otherwise(F.lit(100.0) * m / t)
        else:
            p = F.when(t == 0, F.lit(0.0)).otherwise(F.lit(100.0) * m / t)
        logs.append(F.when(p > 0, F.log(p)).otherwise(F.lit(-9999999999.0)))
    sys_len, ref_len = F.col("sys_len").cast("double"), F.col("ref_len").cast("double")
    bp = F.when(sys_len >= ref_len, F.lit(1.0)).when(sys_len > 0, F.exp(F.lit(1.0) - ref_len / sys_len)) \
          .otherwise(F.lit(0.0))
    mean_log = sum(logs[1:], logs[0]) / max_order
    return [F.round(bp * F.exp(mean_log), 4).alias("bleu"), F.round(bp, 6).alias("bp"),
            F.round(F.try_divide(sys_len, ref_len), 6).alias("ratio")]
