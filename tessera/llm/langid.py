"""Language identification of spans in mixed-language texts.

Per text: words are runs of letters and marks; the script of a word's letters
(by code point ranges) narrows the languages that are tried; each word gets a
log-likelihood under each language's character trigrams; Viterbi over the
words, with a penalty for a switch, labels spans.  The language that holds
most letters is the text's.

The model is counted from labelled texts in one distributed pass: trigrams
fall in 2^16 hashed cells and scripts have numbers, so a language is a vector
of fixed length, whatever the size of the corpus.  There may be any number of
languages; with many, the model is kept as the cells that each one has.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import cut_lineage, read, sliced

CELLS = 1 << 16
#: With more languages the model holds only the cells that a language has.
LANGUAGES = 256
#: What a change of language between two words costs, in nats.
PENALTY = 12.0
#: A language is a candidate for a script that at least this share of its training words has.
SCRIPT_SHARE = 0.01
PIECE = 1 << 18

# fixed values: first and last code points of the scripts' main blocks
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
NAMES = ["other", *SCRIPTS]
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its kind (1 letter, 2 mark) and its script."""
    if not _TABLES:
        import unicodedata

        kind, script = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))[0]
            if c == "L" or c == "M":
                kind[i] = 1 if c == "L" else 2
        for n, blocks in enumerate(SCRIPTS.values(), 1):
            for a, b in blocks:
                script[a:b + 1] = n
        _TABLES[:] = [kind, script]
    return _TABLES[0], _TABLES[1]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut at white space
    where there is some."""
    at, n = 0, len(text)
    while at < n:
        end = at + size
        if end < n:
            space = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = space + 1 if space >= at else end
        yield text[at:end]
        at = end


@dataclass
class Words:
    """The words of a run of characters."""

    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    cell: np.ndarray  # of the trigram around each character of a word
    first: np.ndarray  # where each word's trigrams begin


def words_in(chars: str) -> Words:
    """Words of a string: maximal runs of letters and marks with a letter.
    Case is folded character by character, so places in it are kept."""
    kind, script = _tables()
    low = chars.lower()
    if len(low) != len(chars):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in chars)
    cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = kind[cp]
    inside = np.concatenate([[False], k > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    empty = np.zeros(0, np.int64)
    if not len(start):
        return Words(empty, empty, empty, empty, empty, empty)
    letters = np.add.reduceat(np.append((k == 1).astype(np.int64), 0), np.column_stack([start, end]).ravel())[::2]
    start, end, letters = start[letters > 0], end[letters > 0], letters[letters > 0]
    if not len(start):
        return Words(empty, empty, empty, empty, empty, empty)
    inside = np.zeros(len(cp) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    kept = np.zeros(len(cp) + 2, np.uint64)
    kept[at + 1] = cp[at]  # neighbours that aren't in the word count as 0
    x = kept[at] * np.uint64(0x9E3779B97F4A7C15) + kept[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + kept[at + 2] * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(29)
    cell = ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(end - start)[:-1]])
    # the script of the word's first letter with one
    own = np.where(k[at] == 1, script[cp[at]], 0).astype(np.int64)
    order = np.where(own > 0, (np.arange(len(at)) << 8) | own, np.iinfo(np.int64).max)
    best = np.minimum.reduceat(order, first)
    return Words(start, end, letters, np.where(best == np.iinfo(np.int64).max, 0, best & 255), cell, first)


# --------------------------------- learning ---------------------------------

def _counted(batches):
    cells: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for piece in pieces(text.as_py()):
                w = words_in(piece)
                if lang not in cells:
                    cells[lang], scripts[lang] = np.zeros(CELLS, np.int64), np.zeros(len(NAMES), np.int64)
                if len(w.cell) < CELLS // 4:
                    np.add.at(cells[lang], w.cell, 1)
                else:
                    cells[lang] += np.bincount(w.cell, minlength=CELLS)
                scripts[lang] += np.bincount(w.script, minlength=len(NAMES))
    for lang in cells:
        for base, c in ((0, cells[lang]), (CELLS, scripts[lang])):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array((at + base).astype(np.int32)), pa.array(c[at])], ["lang", "cell", "n"])


@dataclass
class Model:
    """Log-probabilities of the cells in each language: a row of ``weights``
    for each cell, or with many languages what each cell's languages have over
    ``floor``, the log-probability of a cell that a language doesn't have."""

    languages: list[str]
    candidates: np.ndarray  # for each script, the languages that are tried
    weights: np.ndarray | None = None
    floor: np.ndarray | None = None
    start: np.ndarray | None = None  # of each cell's entries
    lang: np.ndarray | None = None
    over: np.ndarray | None = None

    def scores(self, w: Words) -> np.ndarray:
        """The log-probability of each word (row) in each language."""
        if self.weights is not None:
            return np.add.reduceat(self.weights[w.cell], w.first, axis=0)
        size = np.diff(np.append(w.first, len(w.cell)))
        out = size[:, None] * self.floor[None, :]
        some = self.start[w.cell + 1] - self.start[w.cell]
        entry = np.repeat(self.start[w.cell] - (np.cumsum(some) - some), some) + np.arange(some.sum())
        np.add.at(out, (np.repeat(np.repeat(np.arange(len(size)), size), some), self.lang[entry]), self.over[entry])
        return out


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """The model of all rows with a language and a text."""
    rows = labelled.select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text")).where(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    counts = cut_lineage(rows.mapInArrow(sliced(_counted), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")))
    found = counts.toArrow()  # at most CELLS and the scripts for each language
    languages = sorted(found["lang"].unique().to_pylist())
    number = {x: i for i, x in enumerate(languages)}
    own = np.array([number[x] for x in found["lang"].to_pylist()], np.int64)
    cell, n = found["cell"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.float64)
    is_cell = cell < CELLS
    scripts = np.zeros((len(NAMES), len(languages)))
    scripts[cell[~is_cell] - CELLS, own[~is_cell]] = n[~is_cell]
    tried = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=0))
    tried[~tried.any(axis=1)] = True  # a script that no language has narrows nothing
    tried[0] = True
    own, cell, n = own[is_cell], cell[is_cell], n[is_cell]
    if len(languages) <= LANGUAGES:
        cells = np.zeros((CELLS, len(languages)))
        cells[cell, own] = n
        return Model(languages, tried, np.log((cells + 0.5) / (cells.sum(axis=0) + 0.5 * CELLS)).astype(np.float32))
    total = np.bincount(own, n, len(languages)) + 0.5 * CELLS
    order = np.lexsort((own, cell))
    return Model(languages, tried, floor=np.log(0.5 / total), start=np.searchsorted(cell[order], np.arange(CELLS + 1)),
                 lang=own[order].astype(np.int32), over=np.log((n[order] + 0.5) / 0.5).astype(np.float32))


# --------------------------------- labelling --------------------------------

def best_paths(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi paths through the rows of ``scores`` (words x states), for many
    sequences at once: ``sizes`` words each, one step of all sequences that
    are long enough at a time.  Ties go to staying, then to the lower state."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    long, at = sizes[order], starts[order]
    total = scores.astype(np.float64)
    active = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), side="right")
    for t in range(1, len(active)):
        here = at[:active[t]] + t
        before = total[here - 1]
        total[here] += np.maximum(before, before.max(axis=1, keepdims=True) - penalty)
    path = np.zeros(len(scores), np.int64)
    for t in range(len(active) - 1, -1, -1):
        here = at[:active[t]] + t
        best = total[here].argmax(axis=1)
        ends = active[t + 1] if t + 1 < len(active) else 0
        path[here[ends:]] = best[ends:]
        if ends:
            state, rows = path[here[:ends] + 1], np.arange(ends)
            now = total[here[:ends]]
            stays = now[rows, state] >= now[rows, best[:ends]] - penalty
            path[here[:ends]] = np.where(stays, state, best[:ends])
    return path


def _labelled(texts: list[str | None], model: Model, penalty: float):
    """(text number, starts, ends, letters, path) of portions of texts; a text
    is in one portion."""
    def portion(own):
        sizes = np.array([sum(len(w.start) for w, _ in parts) for _, parts in own])
        flat = [(w, base) for _, parts in own for w, base in parts if len(w.start)]
        if not flat:
            return
        scores = np.concatenate([np.where(model.candidates[w.script], model.scores(w), -1e6) for w, _ in flat])
        path = best_paths(scores, sizes, penalty)
        starts, ends = (np.concatenate([getattr(w, x) + base for w, base in flat]) for x in ("start", "end"))
        letters = np.concatenate([w.letters for w, _ in flat])
        at = np.cumsum(sizes) - sizes
        for (i, _), a, n in zip(own, at, sizes):
            if n:
                yield i, starts[a:a + n], ends[a:a + n], letters[a:a + n], path[a:a + n]

    most = (1 << 22) // max(4, len(model.languages))  # characters, as each has a number for each language
    own, held = [], 0
    for i, t in enumerate(texts):
        parts, base = [], 0
        for piece in pieces(t or "", min(PIECE, most)):
            parts.append((words_in(piece), base))
            base += len(piece)
        own.append((i, parts))
        held += base
        if held > most:
            yield from portion(own)
            own, held = [], 0
    yield from portion(own)


def _predicted(model, penalty: float, spans: bool, keep_text: bool):
    def run(batches):
        m = model.value
        for batch in batches:
            n = batch.num_rows
            lang, score, found = ["und"] * n, [0.0] * n, [None] * n
            if m.languages:
                for i, starts, ends, letters, path in _labelled(batch.column("_text").to_pylist(), m, penalty):
                    held = np.bincount(path, weights=letters, minlength=len(m.languages))
                    best = int(held.argmax())
                    lang[i], score[i] = m.languages[best], float(held[best] / held.sum())
                    if spans:
                        new = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
                        last = np.append(new[1:], len(path)) - 1
                        found[i] = json.dumps([[int(starts[a]), int(ends[b]), m.languages[path[a]]] for a, b in zip(new, last)])
            kept = batch if keep_text else batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lang), pa.array(score), *[pa.array(found, pa.string())] * spans],
                                             [*kept.schema.names, "lang_pred", "score", *["_spans"] * spans])

    return run


def predict(docs: DataFrame, model: Model, *carried: Column, text: str = "text", penalty: float = PENALTY, spans: bool = False,
            keep_text: bool = False) -> DataFrame:
    """The ``carried`` columns, lang_pred and score of every row, and with
    ``spans`` an array of (start, end, lang) in characters, with
    ``keep_text`` the text as ``_text``.

    ``score`` is the share of the text's letters in spans of ``lang_pred``.
    Texts that are null or have no letter are ``und`` with score 0, and all
    are if nothing was learned.  Ties go to the language that sorts first.
    Repeated rows stay separate; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(*carried, F.col(text).alias("_text"))
    more = [("lang_pred", T.StringType()), ("score", T.DoubleType()), *[("_spans", T.StringType())] * spans]
    schema = T.StructType([*rows.schema.fields[:len(rows.columns) - (not keep_text)], *[T.StructField(*m) for m in more]])
    out = rows.mapInArrow(sliced(_predicted(spark.sparkContext.broadcast(model), penalty, spans, keep_text)), schema)
    if spans:
        out = out.withColumn("spans", F.from_json("_spans", "array<array<string>>")).withColumn("spans", F.transform("spans", lambda s: F.struct(
            F.get(s, F.lit(0)).cast("int").alias("start"), F.get(s, F.lit(1)).cast("int").alias("end"), F.get(s, F.lit(2)).alias("lang")))).drop("_spans")
    return out


def held_out(key: Column, mod: int = 5) -> Column:
    """Rows whose crc32(key as text) is divisible by ``mod``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod == 0


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a language that holds at least ``least`` of
    the letters, learned from the rows' own lang; with their columns."""
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    found = predict(docs, learn(docs), others, keep_text=True).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(*[(F.col("_text") if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model, F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
