"""Alignment of two tokenizers' tokens over a corpus.

Tokens of both cover the same bytes.  Places where a token of A and one of B
both end cut a text into groups; a link is a pair of token occurrences whose
bytes overlap; a pair of ids counts its links in the whole corpus.

Method: a first pass encodes and aligns texts and leaves, for each task, the
distinct pairs with their links.  Distinct pairs get minimal perfect hashing,
built for each of ``SEGMENTS`` segments of the pairs in a task of its own: at
each level the keys that fall alone on a place of a bit array stay there, the
others go on; a key's index is the rank of its bit.  Counts are dense vectors
indexed by that hash, summed in a tree of at most ``FAN`` vectors a node; keys
are kept in hash order, so that a look-up is verified.  A second pass aligns
the documents again (from the ids that the first one kept) and looks up their
counts.

The table that the second pass carries to every task holds the ``HOT`` most
frequent pairs at most; links of rarer pairs, where there are more, meet their
counts in a join on the pair.  A segment has at most (A's ids x B's ids) /
SEGMENTS pairs, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import cut_lineage, read
from tessera.llm.bpe import byte_symbols
from tessera.operators.ordering import global_index

#: Segments of the pairs, each with a hash and vectors of its own.
SEGMENTS = 256
#: Vectors, or lists of pairs, that one node of a tree takes.
FAN = 32
#: Pairs at most in the table that every task of the second pass has.
HOT = 1 << 22
#: Bytes of text aligned at a time; pairs that a task holds before it passes them on.
PORTION = 1 << 21
HELD = 1 << 21
#: Texts below this character are cut into words alike by both libraries that know A's files.
PLAIN = 0x250
#: Words longer than this go to the library that takes them in linear time.
LONG = 2000
_U = np.uint64


# ------------------------------ tokenizers ------------------------------

@dataclass
class Tokenizers:
    """Both tokenizers, from the contents of their files."""

    a: str
    b: bytes
    _ready: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_ready": {}}

    @classmethod
    def load(cls, a: str | None = None, b: str | None = None) -> Tokenizers:
        import public_tokenizers

        with open(a or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            text = f.read()
        pre = json.loads(text)["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("A must be a byte-level tokenizer that adds no space")
        with open(b or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
            return cls(text, f.read())

    def ready(self) -> dict:
        r = self._ready
        if not r:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import sentencepiece
            import tiktoken
            import tokenizers

            j = json.loads(self.a)
            byte = {s: b for b, s in enumerate(byte_symbols())}
            special = {t["id"]: t["content"].encode() for t in j["added_tokens"]}
            known = {i: bytes(map(byte.__getitem__, t)) for t, i in j["model"]["vocab"].items() if i not in special}
            first = [b""] * (1 + max([*known, *special]))
            for i, t in [*known.items(), *special.items()]:
                first[i] = t
            library = tokenizers.Tokenizer.from_str(self.a)
            library.encode_special_tokens = True
            library.no_truncation()
            library.no_padding()
            # ids of merges in their order: the same merges as ranks, which another library applies faster
            merged = [byte_string(m, byte) for m in j["model"]["merges"]]
            ranked = [known[i] for i in sorted(known)]
            quick = None
            if not j["normalizer"] and sorted(ranked[:256]) == [bytes([b]) for b in range(256)] and ranked[256:] == merged:
                pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
                quick = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in known.items()}, special_tokens={}).encode_ordinary
            pieces = sentencepiece.SentencePieceProcessor(model_proto=self.b)
            second = [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
                      for i in range(pieces.get_piece_size())]
            width = len(str(max(len(first), len(second))))
            digits = np.zeros((max(len(first), len(second)), width + 1), np.uint8)
            sizes = np.array([len(str(i)) for i in range(len(digits))], np.int64)
            for i in range(len(digits)):
                digits[i, :sizes[i]] = np.frombuffer(str(i).encode(), np.uint8)
            r |= {"library": library, "quick": quick, "pieces": pieces, "a": first, "b": second, "digits": digits, "sizes": sizes,
                  "kind": np.uint16 if len(digits) <= 1 << 16 else np.uint32,  # of an id
                  "a_size": np.array(list(map(len, first)), np.int64), "b_size": np.array(list(map(len, second)), np.int64),
                  "other": re.compile(f"[^\0-{chr(PLAIN - 1)}]")}
        return r

    def _ordinary(self, t: str) -> bool:
        """Whether all characters are below PLAIN and no run of white space or
        of other characters is long."""
        if not t.isascii() and self.ready()["other"].search(t):
            return False
        sizes = list(map(len, t.split()))
        return max(sizes, default=0) < LONG and len(t) - sum(sizes) - len(sizes) < LONG

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A's ids of space + text and B's ids of each text; none where the
        text is null or empty or its tokens' bytes aren't those of space + text."""
        r = self.ready()
        a_of, b_of = r["a"].__getitem__, r["b"].__getitem__
        given = [t or "" for t in texts]
        second = r["pieces"].encode(given, num_threads=1)
        first: list[list[int]] = [[]] * len(given)
        slow = []
        for i, t in enumerate(given):
            if t and r["quick"] and self._ordinary(t):
                first[i] = r["quick"](" " + t)
            elif t:
                slow.append(i)
        for i, e in zip(slow, r["library"].encode_batch_fast([" " + given[i] for i in slow], add_special_tokens=False)):
            first[i] = e.ids
        out, none, kind = [], np.zeros(0, r["kind"]), r["kind"]
        for t, x, y in zip(given, first, second):
            whole = (" " + t).encode()
            same = t and b"".join(map(a_of, x)) == whole and b"".join(map(b_of, y)) == whole
            out.append((np.array(x, kind), np.array(y, kind)) if same else (none, none))
        return out


def byte_string(merge: str | list[str], byte: dict[str, int]) -> bytes:
    return bytes(byte[s] for t in (merge if isinstance(merge, list) else merge.split(" ")) for s in t)


# ------------------------------- aligning -------------------------------

@dataclass
class Aligned:
    """The alignment of several texts, one after another."""

    a: np.ndarray  # ids
    b: np.ndarray
    a_ends: np.ndarray  # whether each link is the last of its token of A
    b_ends: np.ndarray
    links: np.ndarray  # before each text, and of all
    a_at: np.ndarray  # tokens before each text, and of all
    b_at: np.ndarray

    def pairs(self, width: int) -> np.ndarray:
        """A's id * width + B's id of each link."""
        i, j = np.cumsum(self.a_ends) - self.a_ends, np.cumsum(self.b_ends) - self.b_ends
        return self.a[i].astype(np.int64) * width + self.b[j]

    def group_ends(self) -> np.ndarray:
        return self.a_ends & self.b_ends


def align(tokens: list[tuple[np.ndarray, np.ndarray]], a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
    a = np.concatenate([x for x, _ in tokens] + [np.zeros(0, np.uint16)])
    b = np.concatenate([y for _, y in tokens] + [np.zeros(0, np.uint16)])
    a_to, b_to = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    end = int(a_to[-1]) if len(a_to) else 0
    ends_a, ends_b = np.zeros(end + 1, bool), np.zeros(end + 1, bool)
    ends_a[a_to] = True
    ends_b[b_to] = True
    cuts = np.flatnonzero(ends_a | ends_b)
    a_at, b_at = (np.cumsum([0, *map(len, ids)]) for ids in zip(*tokens)) if tokens else (np.zeros(1, np.int64),) * 2
    texts_end = np.concatenate([[0], a_to])[a_at]
    return Aligned(a, b, ends_a[cuts], ends_b[cuts], np.searchsorted(cuts, texts_end, "right"), a_at, b_at)


def written(x: Aligned, digits: np.ndarray, sizes: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The groups of all texts as ``a1,a2|b1;a3|b2;``, and where each text's begin."""
    both = x.group_ends()
    group = np.cumsum(both) - both
    a_last, b_last = np.flatnonzero(x.a_ends), np.flatnonzero(x.b_ends)
    a_to, b_to = np.cumsum(x.a_ends)[both], np.cumsum(x.b_ends)[both]  # tokens up to each group's end
    place_a = np.arange(len(x.a)) + np.concatenate([[0], b_to])[group[a_last]]
    place_b = np.arange(len(x.b)) + a_to[group[b_last]]
    ids, after = np.empty(len(x.a) + len(x.b), np.int64), np.empty(len(x.a) + len(x.b), np.uint8)
    ids[place_a], ids[place_b] = x.a, x.b
    after[place_a], after[place_b] = np.where(both[a_last], ord("|"), ord(",")), np.where(both[b_last], ord(";"), ord(","))
    size = sizes[ids]
    rows = digits[ids]
    rows[np.arange(len(ids)), size] = after
    flat = rows[np.arange(rows.shape[1]) <= size[:, None]]
    begins = np.concatenate([[0], np.cumsum(size + 1)])[x.a_at + x.b_at]
    return memoryview(np.ascontiguousarray(flat)), begins


# --------------------------- minimal perfect hash ---------------------------

def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(_U) * _U(0x9E3779B97F4A7C15) + _U((seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> _U(32)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def segment_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 0) >> _U(32)).astype(np.int64) % SEGMENTS


def places(keys: np.ndarray, level: int, sizes: np.ndarray | int) -> np.ndarray:
    """Where a level's bit array of the given sizes has each key."""
    return ((mixed(keys, level + 1) >> _U(32)) * np.asarray(sizes, _U) >> _U(32)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The sizes (in bits) of the levels and the bit arrays, as 64-bit words,
    of a minimal perfect hash of distinct keys."""
    sizes, words, left = [], [], keys
    while len(left):
        if len(sizes) == 64:
            raise ValueError("keys are not distinct")
        size = 64 * -(-2 * len(left) // 64)
        at = places(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(_U))
        left = left[~alone[at]]
        sizes.append(size)
    return sizes, np.concatenate(words) if words else np.zeros(0, _U)


class Hash:
    """Index of keys in several segments: each segment's keys follow those of
    the segment before."""

    def __init__(self, levels: list[list[int]], words: list[np.ndarray]):
        depth = max(map(len, levels), default=0)
        self.sizes = np.zeros((len(levels), depth), np.int64)
        for k, sizes in enumerate(levels):
            self.sizes[k, :len(sizes)] = sizes
        flat = self.sizes.ravel()
        self.base = (np.cumsum(flat) - flat).reshape(self.sizes.shape)
        self.words = np.concatenate([*words, np.zeros(1, _U)])
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def index(self, keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The index of each key that was hashed; some index, or -1, of others."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            some, own = keys[left], segment[left]
            size = self.sizes[own, level]
            bit = self.base[own, level] + places(some, level, size)
            word, shift = self.words[bit >> 6], (bit & 63).astype(_U)
            hit = (size > 0) & ((word >> shift) & _U(1) > 0)
            lower = word & ((_U(1) << shift) - _U(1))
            out[left[hit]] = (self.before[bit >> 6] + np.bitwise_count(lower))[hit]
            left = left[~hit & (size > 0)]
            if not len(left):
                break
        return out


@dataclass
class Table:
    """Counts of pairs by their hash."""

    hash: Hash
    keys: np.ndarray
    counts: np.ndarray

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key, 0 of keys that are not in the table."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = self.hash.index(keys, segment_of(keys))
        return np.where((at >= 0) & (self.keys[at] == keys), self.counts[at], 0)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, where, np.concatenate(counts))
    return found, total


# ------------------------------- first pass -------------------------------

def _first(shared):
    def columns(key_type, ids=(), keys=None, a=(), b=(), segment=(), part=(), pairs=(), counts=()):
        n = max(len(ids), len(segment))
        fill = lambda x, kind: pa.array(x if len(x) else [None] * n, kind)
        return pa.RecordBatch.from_arrays(
            [fill(ids, pa.int64()), pa.nulls(n, key_type) if keys is None else keys, fill(a, pa.binary()), fill(b, pa.binary()), fill(segment, pa.int32()), fill(part, pa.int64()),
             fill(pairs, pa.binary()), fill(counts, pa.binary())], ["_id", "_key", "a", "b", "segment", "part", "keys", "counts"])

    def run(batches):
        t = shared.value
        r = t.ready()
        number = TaskContext.get().partitionId() << 33
        row = part = number
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def passed_on(key_type):
            keys, counts = _summed(*map(list, zip(*held)))
            own = segment_of(keys)
            order = np.argsort(own, kind="stable")
            edges = np.searchsorted(own[order], np.arange(SEGMENTS + 1))
            some = [s for s in range(SEGMENTS) if edges[s] < edges[s + 1]]
            spans = [order[edges[s]:edges[s + 1]] for s in some]
            return columns(key_type, segment=some, part=[part] * len(some), pairs=[keys[x].tobytes() for x in spans], counts=[counts[x].tobytes() for x in spans])

        for batch in batches:
            key_type = batch.schema.field("_key").type
            for key, texts in _portions(batch):
                tokens = t.encode(texts)
                found, n = np.unique(align(tokens, r["a_size"], r["b_size"]).pairs(len(r["b"])), return_counts=True)
                if len(found):
                    held.append((found, n))
                if sum(len(k) for k, _ in held) > HELD:
                    held[:] = [_summed(*map(list, zip(*held)))]
                    if len(held[0][0]) > HELD // 2:
                        yield passed_on(key_type)
                        held.clear()
                        part += 1
                yield columns(key_type, ids=list(range(row, row + len(texts))), keys=key, a=[x.tobytes() for x, _ in tokens], b=[y.tobytes() for _, y in tokens])
                row += len(texts)
        if held:
            yield passed_on(key_type)

    return run


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    texts, size, at = [], 0, 0
    for i, text in enumerate(batch.column("_text")):
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size >= PORTION:
            yield batch.column("_key").slice(at, i + 1 - at), texts
            texts, size, at = [], 0, i + 1
    if texts:
        yield batch.column("_key").slice(at), texts


# --------------------------- hashing and counting ---------------------------

def _numbers(column, kind=np.int64) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _distinct(table: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate(_numbers(table["keys"])))
    return table.slice(0, 1).select(["segment", "part"]).append_column("keys", pa.array([keys.tobytes()], pa.binary()))


def _added(table: pa.Table) -> pa.Table:
    total = np.sum(_numbers(table["counts"]), axis=0)
    return table.slice(0, 1).select(["segment", "part"]).append_column("counts", pa.array([total.tobytes()], pa.binary()))


def _tree(rows: DataFrame, step, parts: int) -> DataFrame:
    """One row of each segment: nodes of FAN rows are joined by ``step`` until
    one is left; ``rows`` has the parts 0 to parts - 1 of each."""
    while parts > 1:
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("segment", "part").applyInArrow(step, rows.schema)
        parts = -(-parts // FAN)
    return rows


def _hashed(batches):
    for batch in batches:
        for segment, keys in zip(batch.column("segment").to_pylist(), _numbers(batch.column("keys"))):
            sizes, words = build(keys)
            at = Hash([sizes], [words]).index(keys, np.zeros(len(keys), np.int64))
            ordered = np.empty_like(keys)
            ordered[at] = keys
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([sizes], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary()),
                                              pa.array([ordered.tobytes()], pa.binary())], ["segment", "levels", "words", "keys"])


def _counted(parts: pa.Table, hashes: pa.Table) -> pa.Table:
    """A vector of the segment's counts from the lists of some tasks."""
    known = _numbers(hashes["keys"])[0]
    index = Hash([hashes["levels"].to_pylist()[0]], _numbers(hashes["words"], _U)).index
    total = np.zeros(len(known), np.int64)
    for keys, counts in zip(_numbers(parts["keys"]), _numbers(parts["counts"])):
        at = index(keys, np.zeros(len(keys), np.int64))
        if not np.array_equal(known[at], keys):
            raise ValueError("a pair is not in the hash of its segment")
        total[at] += counts
    return parts.slice(0, 1).select(["segment", "part"]).append_column("counts", pa.array([total.tobytes()], pa.binary()))


def _tables(first: DataFrame) -> DataFrame:
    """segment, levels, words, keys and counts (both in hash order) of all pairs."""
    lists = first.where(F.col("segment").isNotNull()).select("segment", "part", "keys", "counts")
    # tasks' parts get numbers without gaps; there are a few for each task
    numbers = lists.groupBy("part").agg(F.count("*").alias("_")).select("part").orderBy("part")
    numbered = cut_lineage(global_index(numbers, ["part"], "_n"))
    parts = numbered.count()
    lists = lists.join(numbered, "part").select("segment", F.col("_n").cast("long").alias("part"), "keys", "counts")
    nodes = -(-parts // FAN)
    keys = lists.select("segment", "part", "keys")
    # the first joining is done for one part as well: its keys are then an array of their own
    hashes = cut_lineage(_tree(keys, _distinct, max(parts, 2)).select("segment", "keys").mapInArrow(_hashed, "segment int, levels array<long>, words binary, keys binary"))
    leaves = lists.withColumn("part", F.floor(F.col("part") / FAN))
    copies = hashes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(nodes, 1) - 1).cast("long"))))
    by = ["segment", "part"]
    vectors = leaves.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(_counted_or_none, "segment int, part long, counts binary")
    return cut_lineage(hashes.join(_tree(vectors, _added, nodes).select("segment", "counts"), "segment"))


def _counted_or_none(parts: pa.Table, hashes: pa.Table) -> pa.Table:
    if not parts.num_rows:  # a segment that none of these tasks has
        empty = np.zeros(len(_numbers(hashes["keys"])[0]), np.int64)
        return hashes.select(["segment", "part"]).append_column("counts", pa.array([empty.tobytes()], pa.binary()))
    return _counted(parts, hashes)


def _rows(width: int):
    """The pairs of each segment as rows."""
    def run(batches):
        for batch in batches:
            for keys, counts in zip(_numbers(batch.column("keys")), _numbers(batch.column("counts"))):
                for at in range(0, len(keys), 1 << 16):
                    k, n = keys[at:at + (1 << 16)], counts[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(k // width), pa.array(k % width), pa.array(n)], ["key", "a", "b", "n"])

    return run


def _best(width: int):
    """The highest count of each id of B in each segment."""
    def run(batches):
        most = np.zeros(width, np.int64)
        for batch in batches:
            for keys, counts in zip(_numbers(batch.column("keys")), _numbers(batch.column("counts"))):
                np.maximum.at(most, keys % width, counts)
        at = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(most[at])], ["b", "best"])

    return run


def _bands(batches):
    """Pairs of each segment by the power of two below their count."""
    n = np.zeros(64, np.int64)
    for batch in batches:
        for counts in _numbers(batch.column("counts")):
            n += np.bincount(np.frexp(counts.astype(float))[1], minlength=64)[:64]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(n)], ["band", "n"])


def _frequent(least: int):
    """A table of the pairs counted at least so often, from that of all."""
    def run(batches):
        for batch in batches:
            for segment, keys, counts in zip(batch.column("segment").to_pylist(), _numbers(batch.column("keys")), _numbers(batch.column("counts"))):
                kept = counts >= least
                keys, counts = keys[kept], counts[kept]
                sizes, words = build(keys)
                at = Hash([sizes], [words]).index(keys, np.zeros(len(keys), np.int64)) if len(keys) else np.zeros(0, np.int64)
                k, n = np.empty_like(keys), np.empty_like(counts)
                k[at], n[at] = keys, counts
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([sizes], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary()),
                                                  pa.array([k.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())],
                                                 ["segment", "levels", "words", "keys", "counts"])

    return run


_TABLE = "segment int, levels array<long>, words binary, keys binary, counts binary"


def _hot(tables: DataFrame, most: int) -> tuple[Table, int]:
    """The table of the most frequent pairs, ``most`` at most, and the least
    count of a pair in it (1: all pairs are in it)."""
    n = dict(tables.mapInArrow(_bands, "band long, n long").groupBy("band").agg(F.sum("n")).collect())  # 64 rows
    least = 1
    total = sum(n.values())
    while total > most:
        total -= n.get(least.bit_length(), 0)
        least *= 2
    chosen = tables if least == 1 else tables.mapInArrow(_frequent(least), _TABLE)
    rows = {r.segment: r for r in chosen.collect()}  # at most ``most`` pairs
    levels = [list(rows[s].levels) if s in rows else [] for s in range(SEGMENTS)]
    some = [rows[s] for s in sorted(rows)]
    join = lambda name, kind: [np.frombuffer(r[name], kind) for r in some] + [np.zeros(0, kind)]
    return Table(Hash(levels, join("words", _U)), np.concatenate(join("keys", np.int64)), np.concatenate(join("counts", np.int64))), least


# ------------------------------ second pass ------------------------------

def _second(shared, table, best, partial: bool, keep: bool):
    def run(batches):
        r, known, top = shared.value.ready(), table.value, best.value
        width = len(r["b"])
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                tokens, size, end = [], 0, at
                while end < batch.num_rows and size < PORTION:
                    tokens.append((np.frombuffer(batch.column("a")[end].as_py(), r["kind"]), np.frombuffer(batch.column("b")[end].as_py(), r["kind"])))
                    size += 4 * len(tokens[-1][0])
                    end += 1
                x = align(tokens, r["a_size"], r["b_size"])
                pairs = x.pairs(width)
                counts = known.look_up(pairs)
                within = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[x.links])
                is_best = (counts > 0) & (counts == top[pairs % width])
                text, begins = written(x, r["digits"], r["sizes"])
                spans = [text[a:b - 1] if b > a else None for a, b in zip(begins.tolist(), begins[1:].tolist())]
                out = [batch.column("_id").slice(at, end - at), batch.column("_key").slice(at, end - at), pa.array(np.diff(x.a_at)), pa.array(np.diff(x.b_at)),
                       pa.array(within(x.group_ends())), pa.array(np.diff(x.links)), pa.array(within(is_best)), pa.array(within(counts)),
                       pa.array(["" if s is None else bytes(s).decode() if keep else hashlib.sha256(s).hexdigest() for s in spans], pa.string())]
                names = ["_id", "_key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups" if keep else "groups_sha256"]
                if partial:
                    missing = np.where(counts == 0, pairs, -1)
                    rare = []
                    for a, b in zip(x.links.tolist(), x.links[1:].tolist()):
                        k, n = np.unique(missing[a:b][missing[a:b] >= 0], return_counts=True)
                        rare.append([{"key": p, "m": m} for p, m in zip(k.tolist(), n.tolist())])
                    out.append(pa.array(rare, pa.list_(pa.struct([("key", pa.int64()), ("m", pa.int64())]))))
                    names.append("_rare")
                yield pa.RecordBatch.from_arrays(out, names)
                at = end

    return run


def _first_pass(docs: DataFrame, key: str, text: str, a_path: str | None, b_path: str | None):
    spark = docs.sparkSession
    tokenizers = Tokenizers.load(a_path, b_path)
    shared = spark.sparkContext.broadcast(tokenizers)  # files of a fixed size
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    first = cut_lineage(rows.mapInArrow(_first(shared), f"_id long, _key {kind}, a binary, b binary, segment int, part long, keys binary, counts binary"))
    return first, shared, len(tokenizers.ready()["b"])


def pair_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a, b (ids) and n (links) of every pair of ids that is linked."""
    first, _, width = _first_pass(docs, key, text, a_path, b_path)
    return _tables(first).mapInArrow(_rows(width), "key long, a long, b long, n long").drop("key")


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, hot: int = HOT,
            keep_groups: bool = False) -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best (links whose pair's count
    is the highest of its id of B; ties too), count_sum (counts of all links)
    and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``) of every row, or with
    ``keep_groups`` the groups themselves as ``groups``.

    Texts that are null or empty, and those whose tokens' bytes differ from
    space + text, have no tokens: zeros and an empty string.  Repeated rows
    and keys stay separate and each counts its links; an empty table gives an
    empty result; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    first, shared, width = _first_pass(docs, key, text, a_path, b_path)
    tables = _tables(first)
    best = np.zeros(width, np.int64)
    found = tables.mapInArrow(_best(width), "b long, best long").groupBy("b").agg(F.max("best").alias("best"))
    rows = found.toArrow()  # at most B's ids
    best[rows["b"].to_numpy()] = rows["best"].to_numpy()
    table, least = _hot(tables, hot)
    name = "groups" if keep_groups else "groups_sha256"
    kind = first.schema["_key"].dataType.simpleString()
    columns = f"_id long, _key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {name} string"
    tokens = first.where(F.col("_id").isNotNull()).select("_id", "_key", "a", "b")
    run = _second(shared, spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(best), least > 1, keep_groups)
    if least == 1:
        return tokens.mapInArrow(run, columns).drop("_id").withColumnRenamed("_key", key)
    out = cut_lineage(tokens.mapInArrow(run, columns + ", _rare array<struct<key: bigint, m: bigint>>"))
    # a rarer pair has fewer than ``least`` links, so that no key of this join is a hot one
    counts = tables.mapInArrow(_rows(width), "key long, a long, b long, n long").where(F.col("n") < least)
    highest = spark.createDataFrame([(i, int(x)) for i, x in enumerate(best) if x], "b long, best long")
    more = (out.select("_id", F.inline("_rare")).join(counts, "key").join(F.broadcast(highest), "b")
            .groupBy("_id").agg(F.sum(F.col("m") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("n") == F.col("best"), F.col("m")).otherwise(0)).alias("_best")))
    out = out.drop("_rare").join(more, "_id", "left")
    out = out.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return out.drop("_id", "_sum", "_best").withColumnRenamed("_key", key)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(read(spark, sf_dir, "documents", "doc_id", "text"))
