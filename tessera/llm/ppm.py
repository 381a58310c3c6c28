"""Language-model scoring by prediction by partial matching, pretrained.

The model is a byte-context trie of orders 0 to ``order``, gathered from all
training texts in one pass: every task counts the byte strings of context and
symbol it meets, and the counts of shorter contexts are sums of those of
longer ones.  A symbol is predicted in the longest context that was seen; if
that context hasn't seen it, an escape is paid (as many pseudo-counts as the
context has distinct symbols) and the next shorter context predicts it among
the symbols not yet excluded.  Below order 0 the remaining byte values are
equally likely.  As the trie is nested (what a context has seen, its shorter
ones have), each context's exclusions are one number.

The trie grows with the corpus and stays in Spark.  A symbol's probability
depends on nothing but the string of its longest context and itself, so it is
worked out once for each distinct string of the texts, by joins of each order
with the next shorter one: a string extends its shorter form by one byte, so
no key of these joins or sums has more than 257 rows.  The most frequent
strings are broadcast with their probabilities; all other strings of a text
meet theirs in a join, and no entry of the trie is left out.

Beside the score stands a unigram word model with add-one smoothing.  The
words' counts grow with the corpus, so only words with a fixed share of all
tokens are broadcast (the share bounds their number); all other words of a
document meet their counts in a join.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import cut_lineage, read, sliced
from tessera.llm.simhash import word_runs

ORDER = 5
#: Strings that are broadcast with their probabilities; the others are joined.
MOST = 1 << 20
#: A word with one in so many training tokens is broadcast; no more than that many words can be.
SHARE = 1 << 16
#: Never a byte of UTF-8: before a text, and the symbol that ends it.
END = b"\xff"
_EMPTY = np.uint64(2**64 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 18
#: White space: no word starts with it.
_MARK = b"\t"


def held_out(key: Column, mod: int = 7, rest: int = 2) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod == rest


def _texts(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    return docs.select(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_text"), *columns)


# ------------------------------- gathering ----------------------------------

def framed(texts, order: int, piece: int = _PIECE):
    """(keys, text numbers): context and symbol of every byte and of the end
    of texts, as numbers of ``order + 1`` bytes, in portions of some
    ``piece`` bytes; a longer text goes on in the next portion."""
    buf, who, size = [], [], 0

    def portion():
        data = np.frombuffer(b"".join(buf), np.uint8)
        keys = np.zeros(max(0, len(data) - order), np.uint64)
        for j in range(order + 1):
            keys = (keys << np.uint64(8)) | data[j:len(data) - order + j].astype(np.uint64)
        sizes = np.array([len(b) for b in buf])
        inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= order
        return keys[inside[order:]], np.repeat(np.array(who), sizes - order)

    for i, t in enumerate(texts):
        t = END * order + t.lower() + END
        for at in range(0, len(t) - order, piece):
            part = t[at:at + piece + order]
            buf.append(part)
            who.append(i)
            size += len(part)
            if size >= piece:
                yield portion()
                buf, who, size = [], [], 0
    if buf:
        yield portion()


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    at = np.argsort(keys, kind="stable")
    keys, n = keys[at], n[at]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counted(order: int, most: int = 1 << 21):
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            asked = np.array(batch.column(1)) if batch.num_columns > 1 else np.zeros(batch.num_rows, bool)
            for keys, who in framed((t.as_py() for t in batch.column(0)), order, 1 << 20):
                learned = ~asked[who]
                parts.append(np.unique(keys[learned], return_counts=True))
                parts.append((rest := np.unique(keys[~learned]), np.zeros(len(rest), np.int64)))
                held += len(parts[-2][0]) + len(rest)
                if held > most:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > most // 2:
                        yield _key_rows(*parts[0])
                        parts, held = [], 0
        if parts:
            yield _key_rows(*_merged(parts))

    def _key_rows(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def gathered(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """key, n: counts of all strings of ``order`` bytes and a symbol; texts
    whose ``_held_out`` is true add their strings, but count nothing."""
    return texts.select("_text", *[c for c in texts.columns if c == "_held_out"]).mapInArrow(sliced(_counted(order)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


# --------------------------------- the trie ---------------------------------

class Table:
    """A set of 64-bit keys with places, looked up by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.place = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = keys[todo[free]]
            won = free & (self.keys[slot] == keys[todo])
            self.place[slot[won]] = todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that aren't there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.place[slot], -1)
        todo = np.flatnonzero((there != keys) & (there != _EMPTY))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.place[slot[hit]]
            on = ~hit & (there != _EMPTY)
            todo, slot = todo[on], slot[on]
        return out


class Trie:
    """A trie in memory: for each order the entries (context and symbol) and
    the contexts, with what escapes and exclusions need.  Only for counts of
    a known size; ``lm_scores`` takes ``logged``."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels: for each order from 0 sorted keys and their counts; every
        key's shorter forms are in the levels below."""
        self.entries, self.contexts, self.n, self.total, self.kinds, self.covered, self.top = [], [], [], [], [], [], None
        for j, (keys, n) in enumerate(levels):
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, int)
            add = (lambda x: np.add.reduceat(x, first)) if len(first) else (lambda x: np.zeros(0))
            self.entries.append(Table(keys))
            self.contexts.append(Table(context[first]))
            self.n.append(n.astype(np.float64))
            self.total.append(add(n.astype(np.float64)))
            self.kinds.append(add(np.ones(len(keys))))
            below = self.n[j - 1][self.entries[j - 1].find(keys & np.uint64((1 << 8 * j) - 1))] if j and len(keys) else np.zeros(len(keys))
            self.covered.append(add(below))  # counts in the shorter context of the symbols seen here
        if levels and len(levels[-1][0]):
            sizes = np.diff(np.append(first, len(keys)))
            self.top = np.log10(self.n[-1] / np.repeat(self.total[-1] + self.kinds[-1], sizes))

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol in its context."""
        out, top = np.zeros(len(keys)), len(self.n) - 1
        if self.top is None:
            return out - np.log10(256)
        at = self.entries[top].find(keys)
        out = np.where(at >= 0, self.top[at], 0.0)
        todo = np.flatnonzero(at < 0)
        keys = keys[todo]
        covered, kinds = np.zeros(len(todo)), np.zeros(len(todo))
        for j in range(top, -1, -1):
            here = keys & np.uint64((1 << 8 * (j + 1)) - 1)
            context = self.contexts[j].find(here >> np.uint64(8))
            at = self.entries[j].find(here) if j < top else np.full(len(here), -1, np.int32)
            seen = context >= 0
            new = np.where(seen, self.kinds[j][context], 0.0) - kinds  # symbols that aren't excluded
            left = np.where(seen, self.total[j][context], 0.0) - covered + new
            hit = seen & (at >= 0)
            out[todo[hit]] += np.log10(self.n[j][at[hit]] / left[hit])
            pay = seen & ~hit & (left > 0)
            out[todo[pay]] += np.log10(new[pay] / left[pay])
            covered, kinds = np.where(seen, self.covered[j][context], covered), np.where(seen, self.kinds[j][context], kinds)
            todo, keys, covered, kinds = todo[~hit], keys[~hit], covered[~hit], kinds[~hit]
        out[todo] -= np.log10(256 - kinds)
        return out


def fit(counts: DataFrame, order: int = ORDER, most: int = MOST) -> Trie:
    """The trie in memory of ``gathered`` counts, cut to ``most`` entries of
    each order by power-of-two counts: not the whole model beyond that."""
    levels, least = [], 1
    for j in range(order + 1):
        own = counts if j == order else counts.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        sizes = {r["b"]: r["c"] for r in own.groupBy(F.length(F.bin("n")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}
        b, held = 64, 0
        while b > 0 and held + sizes.get(b, 0) <= most:
            held += sizes.get(b, 0)
            b -= 1
        least = max(least, 1 << b)  # an entry's shorter forms are at least as frequent: the levels are nested
        rows = own.where(F.col("n") >= least).toArrow() if sizes else None
        keys, n = (rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()) if rows is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        at = np.argsort(keys)
        levels.append((keys[at], n[at]))
    return Trie(levels)


def logged(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """key, n, logp: log10 probability of the symbol of each string of
    ``gathered`` counts, whole for any number of strings."""
    levels = [counts.select("key", "n")]
    for j in range(order - 1, -1, -1):
        short = F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1))
        levels.append(cut_lineage(levels[-1].groupBy(short.alias("key")).agg(F.sum("n").alias("n"))))
    lower = None
    for j, level in enumerate(reversed(levels)):
        seen, rows = F.col("n") > 0, level
        if j:
            names = [F.col(c).alias(f"_{c}") for c in ("key", "n", "total", "kinds", "rest")]
            rows = level.join(lower.select(*names), F.col("key").bitwiseAND(F.lit((1 << 8 * j) - 1)) == F.col("_key"))
        context = Window.partitionBy(F.shiftright("key", 8))
        covered = F.sum(F.when(seen, F.col("_n")).otherwise(0)).over(context) if j else F.lit(0)
        rows = rows.select("*", F.sum("n").over(context).alias("total"), F.sum(seen.cast("long")).over(context).alias("kinds"), covered.alias("covered"))
        if j:  # a miss here: the shorter context predicts or escapes, without the symbols seen here
            new = F.col("_kinds") - F.col("kinds")
            left = F.col("_total") - F.col("covered") + new
            rest = (F.when(F.col("_n") > 0, F.log10(F.col("_n") / left))
                    .when(left > 0, F.log10(new / left) + F.col("_rest")).otherwise(F.col("_rest")))
        else:
            rest = -F.log10(F.lit(256) - F.col("kinds"))
        lower = rows.select("key", "n", "total", "kinds", F.when(~seen, rest).alias("rest"))
    left = F.col("total") + F.col("kinds")
    return lower.select("key", "n", F.when(F.col("n") > 0, F.log10(F.col("n") / left))
                        .when(left > 0, F.log10(F.col("kinds") / left) + F.col("rest")).otherwise(F.col("rest")).alias("logp"))


def frequent(strings: DataFrame, most: int = MOST) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and log10 probabilities of the strings with at least the smallest
    power-of-two count that leaves ``most`` of them, and that count."""
    band = F.when(F.col("n") > 0, F.length(F.bin("n"))).otherwise(0)
    sizes = {r["b"]: r["c"] for r in strings.groupBy(band.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}
    b, held = 64, 0
    while b >= 0 and held + sizes.get(b, 0) <= most:
        held += sizes.get(b, 0)
        b -= 1
    least = 1 << b if b >= 0 else 0
    rows = strings.where(F.col("n") >= least).select("key", "logp").toArrow()
    return rows["key"].to_numpy().view(np.uint64), rows["logp"].to_numpy(), least


# -------------------------------- word counts -------------------------------

def _word_counts(batches, most: int = 200_000):
    def rows(c):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    c: Counter = Counter()
    for batch in batches:
        for t in batch.column(0):
            for words in word_runs(t.as_py().lower()):
                c.update(words)
                if len(c) > most:
                    yield rows(c)
                    c = Counter()
            c[b""] += 1  # the end; never a word
    yield rows(c)


def word_counts(texts: DataFrame) -> DataFrame:
    """word (UTF-8; empty: the end of a text), c."""
    return texts.select("_text").mapInArrow(sliced(_word_counts), "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


# ---------------------------------- scoring ---------------------------------

SCORED = "row long, key {key}, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, n long"


def _scored(strings, common, order: int, key_type: pa.DataType):
    """For each text a row of its figures over broadcast words and strings,
    and a row for each other word and string of it.  A string is joined as
    _MARK and its eight bytes."""
    fields = [("row", pa.int64()), ("key", key_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
              ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("n", pa.int64())]
    names = [n for n, _ in fields]

    def run(batches):
        (keys, logp), known_words = strings.value, common.value
        table = Table(keys)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [t.as_py() for t in batch.column("_text")]
            scores, ids, tokens, known, base, rare = np.zeros(len(texts)), [], [], [], [], ([], [], [])
            for keys, who in framed(texts, order):
                at = table.find(keys)
                scores += np.bincount(who, np.where(at >= 0, logp[at] if len(logp) else 0.0, 0.0), len(texts))
                if (at < 0).any():
                    yield _unknown(keys[at < 0], row + who[at < 0])
            for text in texts:
                end = known_words.get(b"")
                n_tokens, n_known, total = 1, int(end is not None), end or 0.0
                for words in word_runs(text.lower()):
                    n_tokens += len(words)
                    for w, n in Counter(words).items():
                        if (logged := known_words.get(w)) is not None:
                            n_known += n
                            total += n * logged
                        else:
                            rare[0].append(row)
                            rare[1].append(w)
                            rare[2].append(n)
                ids.append(row)
                tokens.append(n_tokens)
                known.append(n_known)
                base.append(total)
                row += 1
            marks = [b" %d" % i for i in ids]  # no word has a space: matches nothing, and is dealt evenly
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("_key"), batch.column("_held_out"), pa.array(tokens), pa.array(known),
                                              pa.array(base, pa.float64()), pa.array(scores), pa.array(marks, pa.binary()), none], names)
            for at in range(0, len(rare[0]), 1 << 17):
                ids, words, n = (x[at:at + (1 << 17)] for x in rare)
                empty = [pa.nulls(len(ids), t) for _, t in fields[1:7]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *empty, pa.array(words, pa.binary()), pa.array(n, pa.int64())], names)

    def _unknown(keys, rows):
        at = np.lexsort((keys, rows))
        keys, rows = keys[at], rows[at]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]))
        n = np.diff(np.append(first, len(keys)))
        marked = np.empty((len(first), 9), np.uint8)
        marked[:, 0], marked[:, 1:] = _MARK[0], keys[first].astype(">u8").view(np.uint8).reshape(-1, 8)
        words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.arange(0, 9 * len(first) + 1, 9, dtype=np.int32)), pa.py_buffer(marked)])
        empty = [pa.nulls(len(first), t) for _, t in fields[1:7]]
        return pa.RecordBatch.from_arrays([pa.array(rows[first]), *empty, words, pa.array(n.astype(np.int64))], names)

    return run


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, most: int = MOST, share: int = SHARE,
              mod: int = 7, rest: int = 2) -> DataFrame:
    """``key``, held_out, n_tokens, n_known, train_tokens, base_score, score
    of every row.

    Rows whose crc32(key as text) mod ``mod`` is ``rest`` are held out (a null
    key counts as empty text); the others are learned from.  A-Z are
    lower-cased.  ``score`` is the log10 probability of the text's bytes and
    its end under the trie, ``base_score`` that of its words and its end under
    the unigram model.  Null texts are empty: one token, the end.  Repeated
    rows are scored and learned from each.  Without training texts all bytes
    are equally likely.  An empty table gives an empty result; other columns
    are not read.
    """
    if not 0 <= order <= 6:
        raise ValueError("the order is 0 to 6")
    spark = docs.sparkSession
    out = held_out(F.col(key), mod, rest)
    texts = _texts(docs, text, F.col(key).alias("_key"), out.alias("_held_out"))
    train = texts.where(~F.col("_held_out"))
    counts = cut_lineage(word_counts(train))
    strings = cut_lineage(logged(cut_lineage(gathered(texts, order)), order))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the end of a text is in every text: never left to the join
    common = {bytes(r["word"]): float(np.log10(r["c"] + 1)) for r in counts.where((F.col("c") * share >= n) | (F.length("word") == 0)).toLocalIterator()}
    keys, logp, least = frequent(strings, most)
    met = counts.withColumn("logp", F.lit(None).cast("double"))
    if least:  # strings that aren't broadcast
        marked = F.concat(F.lit(_MARK), F.unhex(F.lpad(F.hex("key"), 16, "0")))
        met = met.unionByName(strings.where(F.col("n") < least).select(marked.alias("word"), F.lit(None).cast("long").alias("c"), "logp"))
    sc = spark.sparkContext
    field = texts.select("_key").schema["_key"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    scored = texts.mapInArrow(sliced(_scored(sc.broadcast((keys, logp)), sc.broadcast(common), order, to_arrow_type(field))), SCORED.format(key=field.simpleString()))
    found = scored.join(met, "word", "left")
    known = F.col("c").isNotNull()
    sums = found.groupBy("row").agg(
        F.max("key").alias(key), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.max("base") + F.coalesce(F.sum(F.when(known, F.col("n") * F.log10(F.col("c") + 1.0))), F.lit(0.0))
         - F.max("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.max("score") + F.coalesce(F.sum(F.col("n") * F.col("logp")), F.lit(0.0))).alias("score"))
    return sums.drop("row")


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents", "doc_id", "text"))
