"""Hashed TF-IDF vectors and an exact cosine join over them.

The join is by prefix filtering.  Terms have one global order, rare ones
first.  A vector's *prefix* is its shortest beginning in that order whose rest
has a norm below the threshold less a share of it.  Terms that two vectors have in
common and that aren't in both prefixes all come after the end of one of them,
so they add at most the norm of that one's rest to the cosine.  Hence two
vectors at or over the threshold share prefix terms, and what those add
together with the greater rest must reach the threshold.  The pairs that do
are verified by whole vectors.

Equal vectors are one entry, so copies of a text make no pairs.  They are told
by a digest of their terms and weights: what is shuffled to find them is a row
of some bytes, and vectors are worked out again from the counts rather than
written.  The others are written once, as blocks with a bounded number of terms,
each one packed value.  A task reads two blocks where they lie and compares
them: neither the pairs that meet in a list, nor the vectors of a candidate, nor
copies of a block are ever shuffled, and what is on disk grows with the rows.
The pairs that share prefix terms, and with them the time, grow with the square
of the rows wherever terms do not get rarer.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.splits import seeded_hash
from tessera.session import cut_lineage

#: Buckets of the hashed terms, as a power of two.
BITS = 20
#: Rows of a task that are held in memory at once.
SLICE = 512
#: Share of the threshold that common prefix terms must add at least.
SLACK = 0.125
#: Terms of a block (25 MB), least number of blocks, pairs that a task expands at once.
BLOCK, BLOCKS, AT_ONCE = 1 << 21, 6, 1 << 20
#: Copies whose ids are broadcast; more of them meet the vectors in a shuffle.
COPIES = 1 << 20


def bucket(word: Column, bits: int = BITS) -> Column:
    return seeded_hash(word, 0) % (1 << bits)


@lru_cache(maxsize=1 << 16)
def _hashed(word: str) -> int:
    """``seeded_hash(word, 0)``"""
    return int(hashlib.md5(f"0:{word}".encode()).hexdigest()[:15], 16)


def _packed(*values) -> bytes:
    """Arrays one after the other, compressed without loss."""
    return pa.compress(b"".join(v.tobytes() for v in values), codec="zstd", asbytes=True)


def _unpacked(blob, size: int, *kinds) -> list[np.ndarray]:
    """Arrays of ``size`` numbers each."""
    data, out, at = pa.decompress(blob, size * sum(np.dtype(k).itemsize for k in kinds), codec="zstd"), [], 0
    for kind in kinds:
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    return out


def _counts(terms: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """Ascending terms, as their differences, and their counts."""
    return len(terms), _packed(np.diff(terms, prepend=0).astype(np.int32), counts.astype(np.int64))


def _terms(size: int, blob) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = _unpacked(blob, size, np.int32, np.int64)
    return np.cumsum(steps, dtype=np.int64), counts


def _counted(bits: int, schema: pa.Schema):
    """(id, size, counts) of each (id, lower-cased text) with a word."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                kept, found = [], []
                for i, text in enumerate(part.column(1)):
                    of: dict[int, int] = {}
                    for word, c in Counter((text.as_py() or "").split()).items():
                        term = _hashed(word) % (1 << bits)
                        of[term] = of.get(term, 0) + c
                    if of:
                        kept.append(i)
                        found.append(_counts(*np.array(sorted(of.items()), np.int64).T))
                yield _batch(part.column(0).take(pa.array(kept, pa.int64())), found, schema)

    return run


def _batch(ids, rows, schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([ids, *(pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(len(schema) - 1))], schema=schema)


def _merged(schema: pa.Schema):
    """Rows in succession with the same id are one, with the sums of counts."""
    def run(batches):
        last, held = None, []

        def out():
            if len(held) == 1:
                return held[0]
            terms, counts = map(np.concatenate, zip(*(_terms(*x) for x in held)))
            terms, at = np.unique(terms, return_inverse=True)
            sums = np.zeros(len(terms), np.int64)
            np.add.at(sums, at, counts)
            return _counts(terms, sums)

        def batch_of(rows):
            return _batch(pa.array([r[0] for r in rows], schema.field(0).type), [r[1] for r in rows], schema)

        for batch in batches:
            rows = []
            for key, *own in zip(*(c.to_pylist() for c in batch.columns)):
                if held and key == last:
                    held.append(own)
                    if len(held) >= SLICE:
                        held = [out()]
                    continue
                if held:
                    rows.append((last, out()))
                last, held = key, [own]
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of([(last, out())])

    return run


def _frequencies(bits: int, schema: pa.Schema):
    """(term, n): the numbers of a task's texts with each term."""
    def run(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for size, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[_terms(size, blob)[0]] += 1  # a text has a term once
        terms = np.flatnonzero(total)
        yield pa.record_batch([pa.array(terms), pa.array(total[terms])], schema=schema)

    return run


def _weighed(shared, schema: pa.Schema):
    """Unit vectors in the order of (n, term)."""
    def run(batches):
        frequency, idf = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                sizes = batch.column(1).to_numpy()
                terms, counts = map(np.concatenate, zip(*map(_terms, sizes.tolist(), batch.column(2).to_pylist())))
                n = frequency[terms]
                order = np.lexsort((terms, n, np.repeat(np.arange(len(sizes)), sizes)))
                terms, n = terms[order], n[order]
                weights = counts[order] * idf[terms]
                # one after the other in the array's order, so that equal texts get equal numbers
                ends = np.cumsum(sizes)
                norms = np.array([np.cumsum(weights[a:b] ** 2)[-1] for a, b in zip(ends - sizes, ends)])
                parts = pa.StructArray.from_arrays([pa.array(n), pa.array(terms), pa.array(weights / np.repeat(np.sqrt(norms), sizes))], ["n", "term", "weight"])
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), parts)], schema=schema)

    return run


def tfidf(texts: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(id, vector): for each text with a word its unit vector, as an array of
    (n, term, weight) in the order of n, the number of texts with the term,
    then of the term.  A weight is the term's count times ln((1 + N) / (1 + n))
    + 1, over the norm.  Ids must be unique (texts with the same are one).

    Words are counted where their text is; a text's counts move once, as one
    packed value, and are written so.  The numbers of texts are 2^bits at most and go to every task."""
    spark = texts.sparkSession
    rows = texts.select(F.col(id_col).alias("id"), F.lower(text).alias("text"))
    kind = rows.schema["id"].dataType
    key = pa.field("id", to_arrow_type(kind))
    packed = pa.schema([key, ("size", pa.int64()), ("counts", pa.binary())])
    spelled = f"id {kind.simpleString()}, size bigint, counts binary"
    counted = rows.mapInArrow(_released(_counted(bits, packed)), spelled)
    counts = cut_lineage(counted.repartition("id").sortWithinPartitions("id").mapInArrow(_released(_merged(packed)), spelled))
    total = counts.select(F.count("id")).first()[0]
    seen = counts.select("size", "counts").mapInArrow(_released(_frequencies(bits, pa.schema([("term", pa.int64()), ("n", pa.int64())]))), "term bigint, n bigint")
    frequency = seen.groupBy("term").agg(F.sum("n").alias("n"))
    known = frequency.select("term", "n", (F.ln(F.lit(1.0 + total) / (1 + F.col("n"))) + 1).alias("idf")).toArrow()
    n, idf = np.zeros(1 << bits, np.int64), np.zeros(1 << bits)
    at = known.column("term").to_numpy()
    n[at], idf[at] = known.column("n").to_numpy(), known.column("idf").to_numpy()
    vectors = pa.schema([key, ("vector", pa.list_(pa.struct([("n", pa.int64()), ("term", pa.int64()), ("weight", pa.float64())])))])
    return counts.mapInArrow(_released(_weighed(spark.sparkContext.broadcast((n, idf)), vectors)), f"id {kind.simpleString()}, vector array<struct<n:bigint,term:bigint,weight:double>>")


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each first, n of them, one after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Block:
    """Vectors of a task: the parts of vector i are terms and weights from
    offsets[i] to offsets[i + 1], its prefix the first ``prefix[i]`` of them."""

    def __init__(self, packed: bytes, below: float):
        with pa.ipc.open_stream(packed) as stream:
            table = stream.read_all().combine_chunks()
        parts = table.column("parts").combine_chunks()
        self.ids, self.offsets = table.column("id").combine_chunks(), np.append(0, np.cumsum(np.diff(parts.offsets.to_numpy()))).astype(np.int64)
        self.terms, self.weights = (parts.flatten().field(c).to_numpy() for c in ("term", "weight"))
        self.prefix, self.rest = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        for i, (a, b) in enumerate(zip(self.offsets, self.offsets[1:])):
            rest = np.append(np.cumsum(self.weights[a:b][::-1] ** 2)[::-1], 0.0)  # of each term and those after it
            self.prefix[i] = k = int(np.count_nonzero(rest >= below * below))
            self.rest[i] = np.sqrt(rest[k])

    def lists(self):
        """The prefix terms in their order, with the row and the weight of each."""
        at = _spans(self.offsets[:-1], self.prefix)
        order = np.argsort(self.terms[at], kind="stable")
        row = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.prefix)[order]
        return self.terms[at[order]], row, self.weights[at[order]]


def _near(a: _Block, b: _Block, same: bool, threshold: float):
    """(row of a, row of b, cosine) of the pairs at or over the threshold, in pieces."""
    terms, rows, weights = b.lists()
    starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
    known, counts = terms[starts], np.diff(np.append(starts, len(terms)))
    whole = np.zeros(int(max((x.terms.max() for x in (a, b) if len(x.terms)), default=0)) + 1)
    lo, width = 0, max(1, len(b.ids))
    while lo < len(a.ids) and len(known):
        hi = min(len(a.ids), lo + max(1, (2 * AT_ONCE) // width))
        own = _spans(a.offsets[lo:hi], a.prefix[lo:hi])
        row = np.repeat(np.arange(hi - lo), a.prefix[lo:hi])
        at = np.minimum(np.searchsorted(known, a.terms[own]), len(known) - 1)
        met = known[at] == a.terms[own]
        own, row, at = own[met], row[met], at[met]
        sums, upto = np.zeros((hi - lo) * width), np.append(0, np.cumsum(counts[at]))
        part = 0
        while part < len(own):
            end = max(part + 1, int(np.searchsorted(upto, upto[part] + AT_ONCE, side="right")) - 1)
            n = counts[at[part:end]]
            k = _spans(starts[at[part:end]], n)
            code = np.repeat(row[part:end] * width, n) + rows[k]
            if len(code) * 8 > len(sums):
                sums += np.bincount(code, np.repeat(a.weights[own[part:end]], n) * weights[k], len(sums))
            else:
                np.add.at(sums, code, np.repeat(a.weights[own[part:end]], n) * weights[k])
            part = end
        sums = sums.reshape(hi - lo, width)
        may = (sums > 0) & (sums + np.maximum(a.rest[lo:hi, None], b.rest[None, :]) >= threshold - 1e-9)
        if same:
            may &= np.arange(lo, hi)[:, None] < np.arange(width)[None, :]
        for i in np.flatnonzero(may.any(axis=1)):
            x = slice(a.offsets[lo + i], a.offsets[lo + i + 1])
            whole[a.terms[x]] = a.weights[x]
            others = np.flatnonzero(may[i])
            sizes = b.offsets[others + 1] - b.offsets[others]
            cuts = np.flatnonzero(np.append(True, np.diff(np.cumsum(sizes) // AT_ONCE) > 0))
            for group in np.split(others, cuts[1:]):
                n = b.offsets[group + 1] - b.offsets[group]
                k = _spans(b.offsets[group], n)
                cosines = np.add.reduceat(whole[b.terms[k]] * b.weights[k], np.cumsum(n) - n)
                near = cosines >= threshold
                if near.any():
                    yield np.full(int(near.sum()), lo + i), group[near], cosines[near]
            whole[a.terms[x]] = 0.0
        lo = hi


def _vectors(batch: pa.RecordBatch):
    """(terms, weights, offsets) of the vectors of a batch, of (id, terms, weights)."""
    terms, weights = batch.column(1), batch.column(2)
    return terms.flatten().to_numpy(), weights.flatten().to_numpy(), np.append(0, np.cumsum(np.diff(terms.offsets.to_numpy())))


def _released(run):
    """``run``, after which the worker gives back what Arrow keeps: workers of
    several steps idle beside each other."""
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def _keyed(schema: pa.Schema):
    """(id, size, key): ``key`` is a digest of the vector."""
    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                terms, weights, at = _vectors(batch)
                yield _batch(batch.column(0), [(b - a, hashlib.sha256(terms[a:b].tobytes() + weights[a:b].tobytes()).digest()) for a, b in zip(at.tolist(), at[1:].tolist())], schema)

    return run


def _rows(schema: pa.Schema):
    """(id, size, parts): the terms and weights of a vector, packed."""
    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                terms, weights, at = _vectors(batch)
                yield _batch(batch.column(0), [(b - a, _packed(terms[a:b], weights[a:b])) for a, b in zip(at.tolist(), at[1:].tolist())], schema)

    return run


def _blocks(most: int, key: pa.Field, packed: bool):
    """Blocks of ``most`` terms, or of one vector with more, from vectors or
    from ``_rows`` of them."""
    def entries(batch):
        if packed:
            for own, size, blob in zip(*(c.to_pylist() for c in batch.columns)):
                yield own, _unpacked(blob, size, np.int32, np.float64)
            return
        for start in range(0, batch.num_rows, SLICE):
            some = batch.slice(start, SLICE)
            terms, weights, at = _vectors(some)
            terms, weights = terms.copy(), weights.copy()  # else the batch stays
            for own, a, b in zip(some.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                yield own, [terms[a:b], weights[a:b]]

    def run(batches):
        ids, parts, held = [], [], 0

        def out():
            terms, weights = map(np.concatenate, zip(*parts))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p[0]) for p in parts])), pa.int32()),
                                             pa.StructArray.from_arrays([pa.array(terms), pa.array(weights)], ["term", "weight"]))
            block, sink = pa.record_batch([pa.array(ids, key.type), lists], names=["id", "parts"]), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(block)
            return pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])

        for batch in batches:
            for own, part in entries(batch):
                if held and held + len(part[0]) > most:
                    yield out()
                    ids, parts, held = [], [], 0
                ids.append(own)
                parts.append(part)
                held += len(part[0])
        if held:
            yield out()

    return run


def _compared(threshold: float, below: float, key: pa.Field):
    schema = pa.schema([("id1", key.type), ("id2", key.type), ("cosine", pa.float64())])

    def run(batches):
        for batch in batches:
            for bi, bj, x, y in zip(*(batch.column(k) for k in range(4))):
                same = bi == bj
                a = _Block(x.as_buffer(), below)
                b = a if same else _Block(y.as_buffer(), below)
                for i, j, cosine in _near(a, b, same, threshold):
                    ids = a.ids.take(pa.array(i)), b.ids.take(pa.array(j))
                    yield pa.record_batch([pc.min_element_wise(*ids), pc.max_element_wise(*ids), pa.array(cosine)], schema=schema)

    return run


def cosine_join(vectors: DataFrame, threshold: float, compare: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """(pairs, members) of ``tfidf`` vectors.  ``members``: id, same (the
    smallest id with the same vector).  ``pairs``: id1 < id2, cosine for all
    pairs of different vectors, named by their smallest ids, with a cosine of
    at least ``threshold``; exact.  Vectors without a term pair with nothing.
    A caller that has no use for the pairs says so by ``compare``: they are
    None then, and no block is written."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    vectors = vectors.select("id", F.transform("vector", lambda t: t["term"].cast("int")).alias("terms"), F.transform("vector", lambda t: t["weight"]).alias("weights"))
    kind = vectors.schema["id"].dataType
    key, spelled = pa.field("id", to_arrow_type(kind)), f"id {kind.simpleString()}, size bigint"
    keyed = cut_lineage(vectors.mapInArrow(_released(_keyed(pa.schema([key, ("size", pa.int64()), ("key", pa.binary())]))), f"{spelled}, key binary"))
    members = keyed.join(keyed.groupBy("key").agg(F.min("id").alias("same")), "key").select("id", "same", "size")
    if not compare:
        return None, members.select("id", "same")
    members = cut_lineage(members)
    copy = ~F.col("id").eqNullSafe(F.col("same"))
    copies = members.where(copy).select(F.col("id").alias("_copy"))
    n, size = members.agg(F.count_if(copy), F.coalesce(F.sum(F.when(~copy, F.col("size"))), F.lit(0))).first()
    rows, shuffled = vectors.where(F.size("terms") > 0), n > COPIES
    if shuffled:
        rows = rows.mapInArrow(_released(_rows(pa.schema([key, ("size", pa.int64()), ("parts", pa.binary())]))), f"{spelled}, parts binary")
    if n:
        rows = rows.join(copies if shuffled else F.broadcast(copies), F.col("id") == F.col("_copy"), "left_anti")
    blocks = max(BLOCKS, -(-size // BLOCK))
    packed = cut_lineage(rows.coalesce(blocks).mapInArrow(_released(_blocks(max(1, -(-size // blocks)), key, shuffled)), "block binary")).select(F.monotonically_increasing_id().alias("b"), "block")
    left, right = (packed.withColumnsRenamed({"b": f"b{x}", "block": f"block_{x}"}) for x in "ij")
    met = left.join(right.hint("shuffle_replicate_nl"), F.col("bi") <= F.col("bj")).select("bi", "bj", "block_i", "block_j")
    pairs = met.mapInArrow(_released(_compared(threshold, threshold * (1 - SLACK), key)), f"id1 {kind.simpleString()}, id2 {kind.simpleString()}, cosine double")
    return pairs, members.select("id", "same")
