"""Augmentation pair mining and pair transforms.

Duplicate candidates are star pairs: every member of a key group is paired
with the group's representative (smallest id).  Output is linear in the
input — no all-pairs expansion inside a group, however hot the key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx


def symmetric_pairs(pairs: DataFrame, keys, a: str = "source", b: str = "target") -> DataFrame:
    """Each pair plus its mirror, from one scan (``mirrored`` 0/1)."""
    both = F.array(F.struct(F.lit(0).cast("long").alias("mirrored"), F.col(a).alias(a), F.col(b).alias(b)),
                   F.struct(F.lit(1).cast("long").alias("mirrored"), F.col(b).alias(a), F.col(a).alias(b)))
    return pairs.select(*keys, F.inline(both))


def star_pairs(df: DataFrame, id_col: str, key: Column, columns: Sequence[str]) -> DataFrame:
    """(id1 = group representative, id2 = member, ``{c}_1`` and ``{c}_2`` of
    each of ``columns``) for every other member of each key group.  What is
    derived from a text (its words, its sentences) is best a column of ``df``,
    so that it is computed once for a representative too.  Groups with one id
    have no pairs and aren't joined."""
    keyed = df.select(id_col, *columns, key.alias("_k")).where(F.col("_k").isNotNull())
    reps = keyed.groupBy("_k").agg(F.min(id_col).alias("id1"), F.max(id_col).alias("_last"))
    reps = reps.where(F.col("id1") < F.col("_last")).drop("_last")
    own = keyed.select(F.col(id_col).alias("id1"), *[F.col(c).alias(f"{c}_1") for c in columns])
    return (keyed.join(reps, "_k").where(F.col(id_col) != F.col("id1")).join(own, "id1")
                 .select("id1", F.col(id_col).alias("id2"), *[F.col(f"{c}_1") for c in columns],
                         *[F.col(c).alias(f"{c}_2") for c in columns]))


def jaccard_at_least(a: Column, b: Column, num: int, den: int) -> Column:
    """|A & B| / |A | B| >= num/den of two arrays of distinct words, in integers."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return (inter * den >= union * num) & (union > 0)


def _numbered(lists) -> pa.Array:
    """Lists of numbers as an Arrow array."""
    offsets = np.append(0, np.cumsum([len(x) for x in lists]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([v for x in lists for v in x], pa.int32()))


def _words(text: str, number: dict) -> dict:
    """The distinct words of a text, by numbers that ``number`` deals out."""
    return dict.fromkeys([number.setdefault(w, len(number)) for w in text.split()])


_NUMBERS = T.ArrayType(T.IntegerType())


@F.arrow_udf(T.StructType().add("w_1", _NUMBERS).add("w_2", _NUMBERS).add("n_1", T.LongType()).add("n_2", T.LongType()))
def pair_words(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of two lower-cased texts the distinct words, as numbers that are equal
    for equal words of the pair, and the counts of sentences."""
    one, two, n_1, n_2 = [], [], [], []
    last, known, words, n = None, {}, {}, 0
    for x, y in zip(a, b):
        x, y = x.as_py() or "", y.as_py() or ""
        if x != last:  # pairs of a representative follow one another
            last, known, n = x, {}, tx.python_sentence_count(x)
            words = _words(x, known)
        one.append(words)
        two.append(_words(y, dict(known)))
        n_1.append(n)
        n_2.append(tx.python_sentence_count(y))
    return pa.StructArray.from_arrays([_numbered(one), _numbered(two), pa.array(n_1, pa.int64()), pa.array(n_2, pa.int64())], ["w_1", "w_2", "n_1", "n_2"])


@F.arrow_udf(T.ArrayType(T.StructType().add("w", _NUMBERS).add("n", T.LongType()).add("n_next", T.LongType())))
def line_words(texts: pa.Array) -> pa.Array:
    """Of each line (``tx.non_empty_lines``) of a lower-cased text the distinct
    words, as numbers that are equal for equal words of the text, its count of
    sentences, and that of the line and the next one with a blank between
    (null for the last line)."""
    sizes, words, n, n_next = [], [], [], []
    for text in texts:
        known: dict = {}
        lines = [x for x in (x.strip() for x in (text.as_py() or "").split("\n")) if x]
        pieces = [tx.python_sentences(x) for x in lines]
        first, last = ([bool(p[k].strip()) for p in pieces] for k in (0, -1))
        counts = [sum(1 for s in p if s.strip()) for p in pieces]
        sizes.append(len(lines))
        words += [_words(x, known) for x in lines]
        n += counts
        # the last sentence of a line and the first of the next are one, unless it ends there
        n_next += [counts[i] + counts[i + 1] - (first[i + 1] and last[i] and lines[i][-1] not in ".!?") for i in range(len(lines) - 1)]
        n_next += [None] * bool(lines)
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
        [_numbered(words), pa.array(n, pa.int64()), pa.array(n_next, pa.int64())], ["w", "n", "n_next"]))


def with_sentence_stats(pairs: DataFrame, q1: str = "q1", q2: str = "q2") -> DataFrame:
    """Sentence counts of both sides (kept if they are there) and their difference."""
    for name, q in (("num_sent_1", q1), ("num_sent_2", q2)):
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, tx.sentence_count(q))
    return pairs.withColumn("sent_diff", F.abs(F.col("num_sent_1") - F.col("num_sent_2")))


def mine(pairs: DataFrame, min_diff: int = 1, q1: str = "q1", q2: str = "q2",
         dup: str = "is_duplicate", require_single: bool = True) -> DataFrame:
    """Duplicates whose sentence counts differ and where one side is a single
    sentence, oriented longer -> shorter (ties keep the first as source):
    ``source`` and ``target`` where the texts are there, ``_swapped`` always."""
    s = with_sentence_stats(pairs.where(F.col(dup) == 1), q1, q2)
    s = s.where(F.col("sent_diff") >= min_diff)
    if require_single:
        s = s.where((F.col("num_sent_1") == 1) | (F.col("num_sent_2") == 1))
    s = s.withColumn("_swapped", F.col("num_sent_1") < F.col("num_sent_2"))
    if q1 not in s.columns:
        return s
    swap = F.col("_swapped")
    return s.select("*", F.when(swap, F.col(q2)).otherwise(F.col(q1)).alias("source"),
                    F.when(swap, F.col(q1)).otherwise(F.col(q2)).alias("target"))


def funnel_counts(pairs: DataFrame, q1: str = "q1", q2: str = "q2", dup: str = "is_duplicate") -> DataFrame:
    """Rows left after each cumulative filter, in one pass."""
    s = with_sentence_stats(pairs, q1, q2)
    d = F.col(dup) == 1
    diff = d & (F.col("sent_diff") >= 1)
    one = diff & ((F.col("num_sent_1") == 1) | (F.col("num_sent_2") == 1))
    return s.agg(F.count(F.lit(1)).alias("n_read"), F.count_if(d).alias("n_duplicate"),
                 F.count_if(diff).alias("n_sent_diff"), F.count_if(one).alias("n_one_sentence"))


def has_entity(pairs: DataFrame, mentions: DataFrame, id_cols=("id1", "id2"), threshold: float = 0.9,
               name: str = "has_entity", mention_key: str = "doc_id", score: str = "score") -> DataFrame:
    """True when either side of the pair has a linked mention scoring strictly
    above ``threshold`` (no mentions = False)."""
    hit = (mentions.where(F.col(score) > threshold).select(mention_key).distinct()
                   .withColumn("_hit", F.lit(True)))
    out = pairs
    flags = []
    for i, c in enumerate(id_cols):
        h = hit.withColumnRenamed(mention_key, c).withColumnRenamed("_hit", f"_hit{i}")
        out = out.join(h, c, "left")
        flags.append(F.coalesce(F.col(f"_hit{i}"), F.lit(False)))
    cond = flags[0]
    for f_ in flags[1:]:
        cond = cond | f_
    return out.withColumn(name, cond).drop(*[f"_hit{i}" for i in range(len(id_cols))])
