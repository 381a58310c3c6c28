"""Many-pattern matching: mentions of a dictionary in texts.

An Aho-Corasick automaton reads a text once, whatever the number of patterns.
A dictionary of up to ``MOST`` mentions is one broadcast automaton; a larger
one is dealt into parts of that size, every text is read once for each part,
and the matches of a text are brought together.  Of overlapping matches the
leftmost counts, of those the longest.

``blind_own`` replaces each text's own mentions, with an automaton a row.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.splits import seeded_hash
from tessera.session import cut_lineage

#: Mentions, and characters of mentions, in one automaton at most.
MOST, CHARACTERS = 1 << 17, 1 << 23
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def automaton_of(mentions: Iterable[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for m in mentions:
        a.add_word(m, len(m))
    a.make_automaton()
    return a


def chosen(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Leftmost, then longest spans that don't overlap."""
    out, end = [], 0
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= end:
            out.append((a, b))
            end = b
    return out


def matches(a: ahocorasick.Automaton, text: str) -> list[tuple[int, int]]:
    return [(i + 1 - n, i + 1) for i, n in a.iter(text)] if len(a) else []


def replaced(text: str, spans: list[tuple[int, int]], token: str) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], token]
        at = b
    return "".join([*out, text[at:]])


def _found(shared, whole: bool):
    def run(batches):
        a = automaton_of(shared.value)
        for batch in batches:
            spans = [matches(a, t.as_py() or "") for t in batch.column("_text")]
            spans = [chosen(s) for s in spans] if whole else spans
            rows = [[{"start": x, "end": y} for x, y in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(rows, _SPANS)], ["_key", "spans"])

    return run


def _joined(batches):
    for batch in batches:
        rows = [[{"start": x, "end": y} for x, y in chosen((s["start"], s["end"]) for s in spans)] for spans in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(rows, _SPANS)], ["_key", "spans"])


def mention_spans(texts: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", mention: str = "mention",
                  most: int = MOST) -> DataFrame:
    """(key, spans): the mentions of the whole ``dictionary`` in every text, as
    an array of (start, end) in characters, leftmost and longest, without
    overlaps.  Null texts and texts without a mention have none; null and
    empty mentions match nothing; repeated mentions count once.  Keys must be
    unique if the dictionary is larger than one automaton (``most`` mentions
    or ``CHARACTERS`` characters)."""
    spark = texts.sparkSession
    words = cut_lineage(dictionary.select(F.col(mention).alias("m")).where(F.length("m") > 0).distinct())
    n, size = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("m")), F.lit(0))).first()
    parts = max(1, -(-2 * n // most), -(-2 * size // CHARACTERS)) if n > most or size > CHARACTERS else 1
    rows = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, spans array<struct<start: int, end: int>>"
    found = []
    for k in range(parts):  # a part is about half of ``most``
        own = words if parts == 1 else words.where(seeded_hash("m", 3) % parts == k)
        shared = spark.sparkContext.broadcast([r["m"] for r in own.toLocalIterator()])
        found.append(rows.mapInArrow(_found(shared, parts == 1), schema))
    if parts > 1:
        together = reduce(DataFrame.unionByName, found).groupBy("_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        found = [together.mapInArrow(_joined, schema)]
    return found[0].withColumnRenamed("_key", key)


def blind_spans(texts: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", token: str = "disease") -> DataFrame:
    """``texts`` with every span of (key, spans) replaced by ``token``; spans
    are ascending and don't overlap.  Texts without spans stay as they are."""
    j = texts.join(spans.withColumnRenamed("spans", "_s"), key, "left")
    start = F.concat(F.array(F.lit(0)), F.transform("_s", lambda s: s["end"]))
    end = F.concat(F.transform("_s", lambda s: s["start"]), F.array(F.length(text)))
    kept = F.zip_with(start, end, lambda a, b: F.substring(F.col(text), a + 1, b - a))
    return j.withColumn(text, F.when(F.size("_s") > 0, F.array_join(kept, token)).otherwise(F.col(text))).drop("_s")


def blind_own(texts: DataFrame, mentions: DataFrame, key: str = "doc_id", text: str = "text", mention: str = "mention",
              token: str = "disease") -> DataFrame:
    """Every text with all occurrences of its own mentions (rows of key,
    mention) replaced by ``token``, leftmost and longest, in one reading.
    Where no two mentions of a text overlap in it, nor one with what a
    replacement leaves, this is the same as replacing one after the other."""
    once = mentions.where(F.length(mention) > 0).groupBy(key).agg(F.collect_set(mention).alias("_m"))
    j = texts.join(once, key, "left").withColumn("_t", F.struct(F.col(text).alias("t"), F.col("_m").alias("m")))

    @F.pandas_udf("string")
    def blinded(rows):
        import pandas as pd
        return pd.Series([t if t is None or m is None else replaced(t, chosen(matches(automaton_of(m), t)), token) for t, m in zip(rows["t"], rows["m"])], dtype=object)

    return j.withColumn(text, F.when(F.col("_m").isNotNull(), blinded("_t")).otherwise(F.col(text))).drop("_m", "_t")
