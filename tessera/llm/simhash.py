"""SimHash near-duplicates by a byte-position inverted index.

A fingerprint has eight positional bytes.  Two fingerprints that differ in at
most ``d`` bits differ in at most ``d`` bytes, so they share at least ``8 - d``
positional bytes: the guaranteed minimum of matches.  Counting shared bytes
over lists of single (position, byte) pairs would meet a 256th of all pairs.
The lists here are keyed by the minimum itself, by ``8 - d`` positions and
their bytes: exactly the pairs that reach the minimum meet, and a list holds
at most ``256 ** d`` distinct fingerprints whatever the data.  Each pair that
meets is tallied (shared positional bytes), kept if it reaches the minimum,
and verified by its differing bits.

Equal fingerprints are one entry of the index, so copies cost nothing.  A task
passes on a spanning forest of the verified links of each batch, never all
pairs of a group; components come from star contraction.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import cut_lineage, read, sliced
from tessera.operators.cluster import connected_components

SEED = 42
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Lists up to this length are compared pair by pair, longer ones by looking up each neighbour.
SHORT = 64


def word_runs(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, from pieces of about ``size`` bytes."""
    at, n = 0, len(text)
    while at < n:
        end = at + size
        if end < n:
            m = _SPACE.search(text, end)
            end = m.start() if m else n
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the XXH64 of a text's word shingles, as a signed long."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in word_runs(text.lower()):  # bytes: A-Z only
        words = tail + words
        h = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))]
        tail = words[max(0, len(words) - shingle + 1):]
        for k in range(0, len(h), 1 << 16):
            some = np.array(h[k:k + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    if not n:
        return np.uint64(digest(b" ".join(tail), SEED)).astype(np.int64).item() if tail else 0
    return np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0].item()


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int, *more: str) -> DataFrame:
    """``_key`` and ``_fp`` (signed) of every row, and its columns ``more``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], ["_key", "_fp", *more])

    schema = ", ".join([f"_key {kind}, _fp long", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in more)])
    return docs.select(F.col(key).alias("_key"), F.encode(F.col(text), "UTF-8").alias("_text"), *more).mapInArrow(sliced(run), schema)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links a-b."""
    up: dict[int, int] = {}
    out: tuple[list[int], list[int]] = ([], [])

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
            out[0].append(x)
            out[1].append(y)
    return out


def _masks(bits: int, most: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for m in range(1, most + 1) for c in itertools.combinations(range(bits), m)], np.uint64)


def _verified(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Pairs with the minimum of shared positional bytes and at most ``most`` differing bits."""
    x = a ^ b
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return (tally >= 8 - most) & (np.bitwise_count(x) <= most)


def _links(sets: list[tuple[int, ...]], most: int):
    """Links among fingerprints sorted by (set, shared bytes, fingerprint)."""
    free = _masks(8 * most, most)
    # a mask over the free bits of a set of positions, spread to where they are
    spread = []
    for s in sets:
        at = [8 * p + i for p in range(8) if p not in s for i in range(8)]
        m = np.zeros(len(free), np.uint64)
        for i, bit in enumerate(at):
            m |= ((free >> np.uint64(i)) & np.uint64(1)) << np.uint64(bit)
        spread.append(m)

    def of(s: np.ndarray, part: np.ndarray, fp: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (part[1:] != part[:-1])]))
        sizes = np.diff(np.append(starts, len(s)))
        left, right = [], []
        short = np.repeat((sizes > 1) & (sizes <= SHORT), sizes)
        run = np.repeat(np.arange(len(starts)), sizes)[short]
        some, d = fp[short], 1
        while d < len(run) and (same := run[d:] == run[:-d]).any():
            a, b = some[:-d][same], some[d:][same]
            ok = _verified(a, b, most)
            left.append(a[ok])
            right.append(b[ok])
            d += 1
        for i in np.flatnonzero(sizes > SHORT):
            own = np.sort(fp[starts[i]:starts[i] + sizes[i]])
            for m in spread[int(s[starts[i]])]:
                there = own ^ m
                at = np.minimum(np.searchsorted(own, there), len(own) - 1)
                hit = (own[at] == there) & (own < there)
                a, b = own[hit], there[hit]
                ok = _verified(a, b, most)
                left.append(a[ok])
                right.append(b[ok])
        return _forest(np.concatenate([[], *left]).astype(np.uint64) if not left else np.concatenate(left),
                       np.concatenate([[], *right]).astype(np.uint64) if not right else np.concatenate(right))

    def run_batches(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
                if len(held[0]) < 1 << 16:
                    continue
            if held is None:
                return
            n = len(held[0])
            if batch is not None:  # the last list may go on in the next batch
                changes = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
                if not len(changes):
                    continue
                n = int(changes[-1]) + 1
            a, b = of(*(x[:n] for x in held))
            held = [x[n:] for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["id1", "id2"])

    return run_batches


def near_links(fps: DataFrame, most: int) -> DataFrame:
    """id1, id2: links that connect every two distinct fingerprints (column
    ``_fp``) within ``most`` bits, directly or through others."""
    if not 0 <= most <= 7:
        raise ValueError("the maximum bit distance is 0 to 7")
    sets = list(itertools.combinations(range(8), 8 - most))
    postings = fps.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_set"), F.col("_fp").bitwiseAND(F.lit(int(np.uint64(sum(255 << 8 * p for p in s)).astype(np.int64)))).alias("_part"),
                 F.col("_fp").alias("_id")) for i, s in enumerate(sets)])))
    lists = postings.repartition("_set", "_part").sortWithinPartitions("_set", "_part", "_id")
    return lists.mapInArrow(_links(sets, most), "id1 long, id2 long")


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, fingerprint (16 hex digits), component_id of every row.

    Words are runs of anything but ASCII white space, A-Z lower-cased, in
    shingles of ``shingle`` words, repeats included (a shorter text: one
    shingle of all its words).  A fingerprint bit is set if it is set in over
    half of the shingles' XXH64.  Null, empty and blank texts have fingerprint
    zero and are linked like any other.  ``component_id`` is the smallest key
    that is reachable by links, itself included; repeated keys are separate
    rows of one component each, null keys are never the smallest.  An empty
    table gives an empty result; other columns are not read.
    """
    rows = cut_lineage(fingerprints(docs, key, text, shingle))
    distinct = cut_lineage(rows.groupBy("_fp").agg(F.min("_key").alias("_low")))
    if most:
        labels = connected_components(distinct, near_links(distinct, most), "_fp")
        low = labels.join(distinct, "_fp")
        low = low.join(low.groupBy("cluster").agg(F.min("_low").alias("component_id")), "cluster").select("_fp", "component_id")
    else:
        low = distinct.withColumnRenamed("_low", "component_id")
    return rows.join(low, "_fp").select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, most: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest key
    (null keys last), of equal keys the first as the rows are written here.
    All columns of ``docs`` are kept, whatever their names."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    docs = cut_lineage(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*columns).alias("_doc")))
    narrow = docs.select(F.col("_doc")[key].alias("_key"), F.col("_doc")[text].alias("_text"), "_row")
    rows = cut_lineage(fingerprints(narrow, "_key", "_text", shingle, "_row"))
    low = F.min(F.struct(F.col("_key").isNull(), "_key", "_row"))
    distinct = cut_lineage(rows.groupBy("_fp").agg(low.alias("_low")))
    if most:
        labels = connected_components(distinct.select("_fp"), near_links(distinct, most), "_fp")
        distinct = labels.join(distinct, "_fp").groupBy("cluster").agg(F.min("_low").alias("_low"))
    return docs.join(distinct.select(F.col("_low._row").alias("_row")), "_row", "left_semi").select("_doc.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
