"""Periodic runs of words: maximal stretches that repeat with a period.

A run is a stretch of consecutive words with smallest period q and a length of
at least max(24, 3 q) that no neighbouring word extends keeping period q.

Method: Ukkonen's suffix trees of a word sequence and of its reversal; longest
common extensions as lowest common ancestors, in constant time from an Euler
tour and a table of range minima; Lyndon roots (for the order of words and for
its opposite) as candidates, extended in both directions.

Trees are built where a run can be, which loses none: inside a run of period q
every 8 words, but for those of the last period, are found again at most q
words later.  Places whose 8 words come back soon enough, and often enough in
a row for the period they allow, are marked with numpy; stretches around them
hold every run whole, and only their words go into trees.  In texts that
repeat nothing this leaves nothing, in periodic ones all.

Documents are handled in their own rows; a worker holds a portion of texts and
the trees of at most ``FOREST`` words, or of one longer stretch.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import let, read, words_of

#: Least words, and least periods, in a run.
WORDS, TIMES = 24, 3
GRAM = 8
#: Words of texts handled together; words of stretches whose trees are handled together.
PORTION = 1 << 18
FOREST = 1 << 16


# ----------------------------- suffix trees -----------------------------

class Forest:
    """Suffix trees of word sequences, and common extensions of suffixes.

    Each sequence is ended by a terminator of its own (symbol 0, which no
    sequence has).  Nodes of all trees are numbered through; places of all
    sequences, terminators included, too.
    """

    def __init__(self, sequences: Iterable[list[int]]):
        self.to: dict[int, int] = {}  # (node, first symbol of the edge) -> node
        self.first: list[int] = []  # an edge's label, in places
        self.last: list[int] = []
        self.leaf: list[int] = []  # of the suffix at each place
        self.root: list[int] = []
        sequences = [[*s, 0] for s in sequences]
        self.width = 1 + max((max(s) for s in sequences), default=0)
        for s in sequences:
            self._ukkonen(s)
        self.size = len(self.leaf)
        self._tour()

    def _ukkonen(self, s: list[int]) -> None:
        to, first, last, leaf, width, base = self.to, self.first, self.last, self.leaf, self.width, len(self.leaf)
        root = len(first)
        self.root.append(root)
        first.append(base)
        last.append(base)
        link = {root: root}
        end = base + len(s)
        node, edge, length, left = root, 0, 0, 0
        for i, c in enumerate(s):
            waits = -1
            left += 1
            while left:
                if not length:
                    edge = i
                key = node * width + s[edge]
                child = to.get(key)
                if child is None:
                    to[key] = new = len(first)
                    first.append(base + i)
                    last.append(end)
                    leaf.append(new)
                    if waits >= 0:
                        link[waits] = node
                        waits = -1
                else:
                    start = first[child]
                    size = last[child] - start
                    if length >= size:
                        node = child
                        edge += size
                        length -= size
                        continue
                    if s[start - base + length] == c:
                        length += 1
                        if waits >= 0:
                            link[waits] = node
                        break
                    middle = len(first)
                    first.append(start)
                    last.append(start + length)
                    to[key] = middle
                    start += length
                    first[child] = start
                    to[middle * width + s[start - base]] = child
                    new = middle + 1
                    first.append(base + i)
                    last.append(end)
                    leaf.append(new)
                    to[middle * width + c] = new
                    if waits >= 0:
                        link[waits] = middle
                    waits = middle
                left -= 1
                if node == root:
                    if length:
                        length -= 1
                        edge = i - left + 1
                else:
                    node = link.get(node, root)

    def _tour(self) -> None:
        """Numbers the nodes in the order of a tour (children by first symbol)
        and keeps, at each node's number, the depth of its parent."""
        n = len(self.first)
        keys = np.fromiter(self.to.keys(), np.int64, len(self.to))
        kids = np.fromiter(self.to.values(), np.int64, len(self.to))
        order = np.argsort(keys)
        keys, kids = keys[order], kids[order]
        over = keys // self.width
        has = np.bincount(over, minlength=n)
        at = np.cumsum(has) - has
        label = np.array(self.last, np.int64) - np.array(self.first, np.int64)
        depth, parent = np.zeros(n, np.int64), np.full(n, -1)
        parent[kids] = over
        levels, level = [], np.array(self.root, np.int64)
        while len(level):
            levels.append(level)
            level = kids[_ranges(at[level], has[level])]
            depth[level] = depth[parent[level]] + label[level]
        nodes = np.ones(n, np.int64)  # in the tree below
        for level in levels[:0:-1]:
            np.add.at(nodes, parent[level], nodes[level])
        # the terminator comes first; or, for the opposite order, last
        self.rank, number = self._numbers(levels, over, kids, at, has, nodes, parent)
        terminator_last = np.argsort(np.where(keys % self.width == 0, keys + self.width, keys))
        self.opposite, _ = self._numbers(levels, over, kids[terminator_last], at, has, nodes, parent)
        above = np.zeros(n, np.int32)
        above[number] = np.where(parent >= 0, depth[parent], 0)
        self.table = [above]
        longest = max((b - a for a, b in zip(self.root, [*self.root[1:], n])), default=1)
        while 2 << (len(self.table) - 1) <= longest:
            step, before = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(before[:-step], before[step:]) if step < len(before) else before)

    def _numbers(self, levels, over, kids, at, has, nodes, parent):
        """The tour's number of each place's leaf, and of each node."""
        before = np.cumsum(nodes[kids]) - nodes[kids]  # of the siblings before, and of all earlier families
        offset = np.zeros(len(nodes), np.int64)
        offset[kids] = before - before[at[over]]
        number = np.zeros(len(nodes), np.int64)
        roots = levels[0] if levels else np.zeros(0, np.int64)
        number[roots] = np.cumsum(nodes[roots]) - nodes[roots]
        for level in levels[1:]:
            number[level] = number[parent[level]] + 1 + offset[level]
        return number[np.array(self.leaf, np.int64)] if self.leaf else np.zeros(0, np.int64), number

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at two different
        places of the same sequence: the depth of their leaves' lowest common
        ancestor."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        power = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(power):
            at = power == k
            level = self.table[k]
            out[at] = np.minimum(level[a[at]], level[b[at] - (1 << int(k))])
        return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (size[0] numbers), then those of start[1] ..."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    return out + np.arange(len(out))


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller rank, or the length."""
    n = len(rank)
    after = [n] * (n + 1)
    rank = [*rank, -1]
    for i in range(n - 1, -1, -1):
        j, r = i + 1, rank[i]
        while rank[j] > r:
            j = after[j]
        after[i] = j
    return after[:n]


def runs_of(sequences: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period), sorted by start and period, of each
    of several sequences of positive numbers."""
    ahead = Forest(sequences)
    back = Forest([s[::-1] for s in sequences])
    sizes = np.array([len(s) for s in sequences], np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    starts, periods = [], []
    for at, n in zip(base.tolist(), sizes.tolist()):
        if n < WORDS:
            continue
        for rank in (ahead.rank[at:at + n].tolist(), (len(ahead.first) - ahead.opposite[at:at + n]).tolist()):
            place = np.arange(n)
            period = np.array(_next_smaller(rank), np.int64) - place
            kept = period * TIMES <= n
            starts.append(place[kept] + at)
            periods.append(period[kept])
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    if not starts:
        return out
    i, q = np.concatenate(starts), np.concatenate(periods)
    own = np.searchsorted(base, i, "right") - 1
    at, n = base[own], sizes[own]
    right = ahead.common(i, i + q)  # i + q is the terminator's place at most
    # the words before i and before i + q, from the reversal
    inside = np.flatnonzero(i > at)
    left = np.zeros(len(i), np.int64)
    left[inside] = back.common(2 * at[inside] + n[inside] - i[inside], 2 * at[inside] + n[inside] - i[inside] - q[inside])
    start, length = i - left, left + q + right
    kept = length >= np.maximum(WORDS, TIMES * q)
    found = np.unique(np.column_stack([own, start - at, q, length])[kept], axis=0)
    for k, s, p, size in found.tolist():
        out[k].append((s, size, p))
    return out


# ------------------------- where runs can be -------------------------

def stretches(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(sequence, from, to) of stretches that hold every run of the sequences
    ids[starts[k]:ends[k]] whole; between two of them stands a number found
    once."""
    n = len(ids)
    if n <= GRAM:
        return []
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    for step, factor in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB), (4, 0xD6E8FEB86659FD93)):
        x = x[:-step] * np.uint64(factor) + x[step:]
        x ^= x >> np.uint64(29)
    order = np.argsort(x, kind="stable")
    again = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    if not len(again):
        return []
    far = np.full(len(x) + 1, n, np.int64)  # to the next place with the same words
    far[order[again]] = order[again + 1] - order[again]
    found, top = [], GRAM
    while True:
        # a run with a period of top / 2 + 1 to top (up to 8 at first) has so many such places in a row
        least = (WORDS - top if top == GRAM else (TIMES - 1) * (top // 2 + 1)) - GRAM + 1
        near = np.concatenate([[False], far <= top])
        edge = np.flatnonzero(near[1:] != near[:-1])
        a, b = edge[::2], edge[1::2]
        kept = b - a >= least
        if kept.any():
            found.append(np.column_stack([a[kept], b[kept] + top + GRAM]))
        if not (far[:-1] < n).any() or top > n // TIMES:
            break
        top *= 2
    if not found:
        return []
    spans = np.concatenate(found)
    own = np.searchsorted(starts, spans[:, 0], "right") - 1
    out: list[tuple[int, int, int]] = []
    for k, a, b in sorted(zip(own.tolist(), spans[:, 0].tolist(), np.minimum(spans[:, 1], ends[own]).tolist())):
        if out and out[-1][0] == k and a <= out[-1][2]:
            out[-1] = (k, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((k, a, b))
    return [s for s in out if s[2] - s[1] >= WORDS]


def of_texts(texts: Iterable[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several lists of words."""
    number = defaultdict(count(1).__next__)
    ids, starts, ends = [], [], []
    for k, words in enumerate(texts):
        starts.append(len(ids))
        ids.extend(map(number.__getitem__, words))
        ends.append(len(ids))
        ids.append(number[k])  # no word: stands once
    out: list[list[tuple[int, int, int]]] = [[] for _ in starts]
    flat = np.array(ids, np.int64)
    group, held = [], 0

    def close():
        for (k, a, _), found in zip(group, runs_of([_numbered(flat[a:b]) for _, a, b in group])):
            out[k] += [(s + a - starts[k], size, q) for s, size, q in found]

    for s in stretches(flat, np.array(starts, np.int64), np.array(ends, np.int64)):
        if group and held + s[2] - s[1] > FOREST:
            close()
            group, held = [], 0
        group.append(s)
        held += s[2] - s[1]
    if group:
        close()
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def _numbered(part: np.ndarray) -> list[int]:
    """Small numbers from 1 for equal words, so that a tree's keys stay small."""
    return (np.unique(part, return_inverse=True)[1] + 1).tolist()


# ------------------------------ Spark ------------------------------

def _portions(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """(first row, last row, words of each) of portions of a batch."""
    texts, held, at = [], 0, 0
    for i, text in enumerate(batch.column("_text")):
        buffer = text.as_buffer()
        # a text's white space is that of bytes.split(): blank and U+0009 to U+000D
        texts.append(buffer.to_pybytes().split() if buffer is not None else [])
        held += len(texts[-1])
        if held >= PORTION:
            yield at, i + 1, texts
            texts, held, at = [], 0, i + 1
    if texts:
        yield at, batch.num_rows, texts


def _spans(batches):
    for batch in batches:
        for a, b, texts in _portions(batch):
            found = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in of_texts(texts)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("_key").slice(a, b - a), pa.array(map(len, texts), pa.int64()), pa.array(found, kind),
                                              pa.array([b" ".join(collapsed(w, r)).decode() for w, r in zip(texts, map(_tuples, found))], pa.string())],
                                             ["_key", "n_words", "runs", "collapsed"])


def _tuples(runs: list[dict]) -> list[tuple[int, int, int]]:
    return [(r["start"], r["length"], r["period"]) for r in runs]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def best(runs: list[tuple[int, int, int]]) -> tuple | None:
    """The run with most periods; of equals the first, then the shortest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _digested(batches):
    for batch in batches:
        for a, b, texts in _portions(batch):
            rows = []
            for words, runs in zip(texts, of_texts(texts)):
                top = best(runs)
                rows.append((len(runs), *(top + (1000 * top[1] // top[2],) if top else (None,) * 4),
                             hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                             hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            n, start, length, period, milli, first, second = (pa.array(c, k) for c, k in zip(zip(*rows), kinds))
            yield pa.RecordBatch.from_arrays([batch.column("_key").slice(a, b - a), n, start, length, period, milli, first, second],
                                             ["_key", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def _over(docs: DataFrame, key: str, text: Column, run, columns: str) -> DataFrame:
    rows = docs.select(F.col(f"`{key}`").alias("_key"), text.alias("_text"))
    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, {columns}").withColumnRenamed("_key", key)


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_words, runs (array of start, length, period; by start, then
    period) and collapsed (the text's words joined by one blank, each run cut
    to its first period) of every row.

    Null and empty texts have no word and no run.  Repeated rows and keys stay
    separate; an empty table gives an empty result; other columns, whatever
    their names, are not read.
    """
    return _over(docs, key, F.col(f"`{text}`"), _spans,
                 "n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def digests(docs: DataFrame, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """``key``, n_runs, start, length, period and exponent_milli of the run
    with the greatest length / period (ties: smallest start, then period;
    nulls without a run), runs_sha256 and collapsed_sha256 of every row;
    edge cases as in ``runs``."""
    return _over(docs, key, F.col("text") if text is None else text, _digested,
                 "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def made_periodic(key: Column, text: Column) -> Column:
    """A text in ten (crc32 of the key, as decimal text, divisible by 10) with
    its words from word a = g % n on repeating with period 1 + floor((n - a) /
    (3 + g % 8)), g = floor(crc32 / 10); other texts as they are.  A null key
    counts as empty text."""
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        return let(F.struct(words.alias("w"), F.pmod(g, F.size(words)).cast("int").alias("a"), F.size(words).alias("n")), lambda s: let(
            F.struct(s["w"].alias("w"), s["a"].alias("a"), (1 + F.floor((s["n"] - s["a"]) / (3 + g % 8))).cast("int").alias("p")),
            lambda t: F.array_join(F.transform(t["w"], lambda x, i: F.when(i < t["a"], x).otherwise(F.get(t["w"], t["a"] + (i - t["a"]) % t["p"]))), " ")))

    return F.when(h % 10 == 0, let(words_of(text), lambda w: F.when(F.size(w) > 0, changed(w)))).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return digests(docs, text=made_periodic(F.col("doc_id"), F.col("text")))
