"""Byte-pair encoding and decoding as bounded-lookahead transducers.

The merge list of a tokenizer file tells how far unread text can reach back:
an unread symbol changes a merge only through a chain of merges of rising
rank, each of which takes in a token that starts with the left part of the
one before.  The longest such chain is computed once from the list.  A word of
any length is then read through a window; a token that ends further before
the window's end than the lookahead is final and leaves.  Words of ordinary
length fit the window and are kept in a bounded cache.

Decoding is a state machine over ids: joined tokens for files without a
decoder, or text from the bytes of tokens, holding back an unfinished UTF-8
sequence.

The tokenizer file is read on the driver and broadcast (its size is fixed);
each text is handled in its own row.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import read, sliced

#: Words in a worker's cache at most.
CACHE = 300_000
#: Characters of a text that are normalised at a time (cut where a word ends).
PIECE = 1 << 16
#: The white space of Unicode, as a class body.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Classes of a tokenizer file's pattern whose members differ between versions of Unicode.
CLASSES = {r"\p{L}": "L", r"\p{N}": "N"}
# fixed values: letters and numbers that Unicode 16 added to 15.1, first and last
ADDED = {
    "L": [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
          (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
          (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}
# fixed values: lower-case forms that Unicode 16 and 17 added
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
         **{0x10D50 + i: 0x10D70 + i for i in range(22)}, **{0x16EA0 + i: 0x16EBB + i for i in range(25)}}
# before white space, or between an ASCII letter or digit and a sign that no word has after it
_CUT = regex.compile(r"(?=[\t-\r ])|(?<=[A-Za-z0-9])(?=[!-&(-/:-@\[-`{-~])")


def class_bodies() -> tuple[dict[str, str], frozenset[str]]:
    """The classes of CLASSES spelled out as ranges, by Unicode 16 as the
    tokenizers library has them, and the characters that the regular
    expressions of this Python put elsewhere or that it can't lower-case."""
    every = "".join(map(chr, range(0x110000)))
    kinds = [unicodedata.category(c)[0] for c in every]
    for kind, blocks in ADDED.items():
        for a, b in blocks:
            kinds[a:b + 1] = kind * (b + 1 - a)
    bodies, moot = {}, set(map(chr, LOWER))
    for name, category in CLASSES.items():
        inside = [k == category for k in kinds] + [False]
        edges = [i for i in range(len(inside)) if inside[i] != (i > 0 and inside[i - 1])]
        bodies[name] = "".join(f"\\U{a:08X}-\\U{b - 1:08X}" for a, b in zip(edges[::2], edges[1::2]))
        moot |= {c for c, i in zip(every, inside) if i} ^ set(regex.findall(name, every))
    return bodies, frozenset(moot)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable Latin-1, else the next one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def lookahead(merges: Iterable[tuple[str, str]], end: str) -> int:
    """Symbols that unread text can reach back: whatever follows, a boundary
    between tokens that lies at least this far before the end of the read
    symbols stays."""
    def symbols(t: str) -> str:
        return t[:-len(end)] + "\0" if end and t.endswith(end) else t

    reach: dict[str, int] = {}
    longest, deepest = 1, 0
    for left, right in merges:
        u, v = symbols(left), symbols(right)
        far = len(u) + max((reach.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        reach[u] = max(reach.get(u, 0), far)
        longest, deepest = max(longest, len(u) + len(v)), max(deepest, far)
    return longest + deepest


@dataclass
class Tokenizer:
    """A BPE tokenizer with word ends, from a file of the tokenizers library."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    pattern: str
    exact: str  # the same with its classes spelled out: slow, for texts with ``moot`` characters
    moot: frozenset[str]
    end: str
    special: dict[str, int]
    byte_level_decoder: bool = False
    ahead: int = 0
    _ready: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        kinds = [n["type"] for n in (j["normalizer"] or {}).get("normalizers", [])]
        parts = (j["pre_tokenizer"] or {}).get("pretokenizers", [])
        model, decoder = j["model"], j.get("decoder")
        if (kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"] or not parts[0]["invert"]
                or parts[0]["behavior"] != "Removed" or model["type"] != "BPE" or model.get("continuing_subword_prefix")
                or (decoder or {"type": "ByteLevel"})["type"] != "ByteLevel"):
            raise ValueError(f"{path}: only NFC, lower case, a pattern of words, byte symbols and BPE are supported")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        end = model.get("end_of_word_suffix") or ""
        special = {t["content"]: t["id"] for t in j["added_tokens"]}
        pattern = exact = parts[0]["pattern"]["Regex"].replace(r"\s", SPACE)
        bodies, moot = class_bodies()
        for name, body in bodies.items():
            exact = exact.replace(name, body)
        return cls(model["vocab"], merges, pattern, exact, moot, end, special, bool(decoder), lookahead(merges, end))

    def __getstate__(self):
        return {**self.__dict__, "_ready": {}}

    def _prepared(self) -> dict:
        r = self._ready
        if not r:
            symbols = byte_symbols()
            number = {t: i for i, t in enumerate(self.ids)}  # of a token, independent of its id
            r["tokens"] = list(self.ids)
            r["id"] = list(self.ids.values())
            r["inner"] = [number.get(s, -1) for s in symbols]
            r["last"] = [number.get(s + self.end, -1) for s in symbols]
            r["rank"] = {}
            for rank, (a, b) in enumerate(self.merges):
                r["rank"].setdefault(number[a] << 20 | number[b], rank)
            r["made"] = [number[a + b] if not self.end or not a.endswith(self.end) else -1 for a, b in self.merges]
            r["words"], r["exact"] = regex.compile(self.pattern), None
            r["special"] = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
            r["cache"] = {}
        return r

    # ------------------------------- encoding -------------------------------

    def _merged(self, s: list[int]) -> list[int]:
        """Merge the lowest rank, of equals the leftmost, until none is left."""
        r = self._prepared()
        rank, made = r["rank"].get, r["made"]
        if len(s) <= 48:
            none = len(made)
            ranks = [rank(a << 20 | b, none) for a, b in zip(s, s[1:])]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                s[i:i + 2] = [made[best]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank(s[i - 1] << 20 | s[i], none)
                if i < len(ranks):
                    ranks[i] = rank(s[i] << 20 | s[i + 1], none)
            return s
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap = [(x, i) for i in range(len(s) - 1) if (x := rank(s[i] << 20 | s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            x, i = heapq.heappop(heap)
            j = after[i]
            if s[i] < 0 or j >= len(s) or rank(s[i] << 20 | s[j]) != x:
                continue
            s[i], s[j] = made[x], -1
            after[i] = after[j]
            if after[i] < len(s):
                before[after[i]] = i
                if (y := rank(s[i] << 20 | s[after[i]])) is not None:
                    heapq.heappush(heap, (y, i))
            if (h := before[i]) >= 0 and (y := rank(s[h] << 20 | s[i])) is not None:
                heapq.heappush(heap, (y, h))
        return [t for t in s if t >= 0]

    def word_tokens(self, word: bytes, window: int | None = None) -> Iterator[list[int]]:
        """Token numbers of one word, in portions, from left to right."""
        r = self._prepared()
        window = max(2 * self.ahead, 4096) if window is None else max(window, self.ahead + 1)
        inner, tokens, at = r["inner"], r["tokens"], 0
        while len(word) - at > window:
            part = self._merged([inner[b] for b in word[at:at + window]])
            final, size = [], 0
            for t in part:
                size += len(tokens[t])
                if size > window - self.ahead:
                    size -= len(tokens[t])
                    break
                final.append(t)
            if not final:  # a token as long as the window: look further
                window *= 2
                continue
            yield final
            at += size
        yield self._merged([*(inner[b] for b in word[at:-1]), r["last"][word[-1]]])

    def words(self, text: str) -> Iterator[tuple[str, list[str]]]:
        """("", words) of stretches of a text, and (special token, [])."""
        r = self._prepared()
        at = 0
        for m in [*(r["special"].finditer(text) if r["special"] else ()), None]:
            stop = m.start() if m else len(text)
            while at < stop:
                end = stop
                if stop - at > PIECE and (cut := _CUT.search(text, at + PIECE, stop)):
                    end = cut.start()  # NFC and words don't cross it
                part = text[at:end]
                words = r["words"]
                if not part.isascii():
                    # character by character: no special form at the end of a word
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                    if not self.moot.isdisjoint(part):
                        words = r["exact"] = r["exact"] or regex.compile(self.exact)
                        part = part.translate(LOWER)
                yield "", words.findall(part.lower())
                at = end
            if m:
                yield m[0], []
                at = m.end()

    def _of(self, word: str) -> tuple[str, tuple[int, ...]]:
        """Ids of a word of ordinary length, joined by blanks and as numbers."""
        r = self._prepared()
        ids = tuple([r["id"][t] for part in self.word_tokens(word.encode()) for t in part])
        out = (" ".join(map(str, ids)), ids)
        if len(r["cache"]) >= CACHE:
            r["cache"].clear()
        r["cache"][word] = out
        return out

    def stretches(self, text: str) -> Iterator[tuple[str, list[int]]]:
        """Ids of successive stretches of a text, joined by blanks and as
        numbers; one blank stands between the ids of two."""
        r = self._prepared()
        get, of = r["cache"].get, self._of
        for special, words in self.words(text):
            if special:
                yield str(self.special[special]), [self.special[special]]
                continue
            found = []
            for w in words:
                if len(w) <= 64:
                    found.append(get(w) or of(w))
                    continue
                if found:
                    yield _joined(found)
                    found = []
                for part in self.word_tokens(w.encode()):
                    ids = [r["id"][t] for t in part]
                    yield " ".join(map(str, ids)), ids
            if found:
                yield _joined(found)

    def encode(self, text: str) -> list[int]:
        return [i for _, ids in self.stretches(text) for i in ids]

    # ------------------------------- decoding -------------------------------

    def decoder(self, as_text: bool | None = None) -> Decoder:
        return Decoder(self, ("bytes" if self.byte_level_decoder else "tokens") if as_text is None else "text" if as_text else "tokens")

    def decode(self, ids: Iterable[int], as_text: bool | None = None) -> str:
        d = self.decoder(as_text)
        return d.feed(ids) + d.close()


class Decoder:
    """Incremental decoding.  "tokens" joins the tokens by blanks, as a file
    without a decoder does; "bytes" turns the symbols of tokens back into
    bytes and these into text, as a byte-level decoder does; "text" does too,
    with a blank for a word's end and special tokens as they are."""

    def __init__(self, tokenizer: Tokenizer, mode: str):
        self.end, self.mode, self.begun = tokenizer.end, mode, False
        self.special = {i: t for t, i in tokenizer.special.items()}
        r = tokenizer._prepared()
        if "token" not in r:
            byte = {s: b for b, s in enumerate(byte_symbols())}
            r["token"] = {i: t for t, i in tokenizer.ids.items()} | self.special
            r["bytes"] = {i: bytes(map(byte.__getitem__, t)) if byte.keys() >= set(t) else t.encode() for i, t in r["token"].items()}
            r["text"] = r["bytes"] | {i: bytes(map(byte.__getitem__, t[:-len(self.end)])) + b" " for t, i in tokenizer.ids.items() if self.end and t.endswith(self.end)}
        self.token, self.part = r["token"], r.get(mode)
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.mode == "tokens":
            get = self.token.get
            known = [t for i in ids if (t := get(i)) is not None]
            first, self.begun = " " if known and self.begun else "", self.begun or bool(known)
            return first + " ".join(known)
        if self.mode == "bytes":
            return self.utf8.decode(b"".join([self.part.get(i, b"") for i in ids]))
        out = []
        for i in ids:
            if i in self.special:
                out.append(self.utf8.decode(b"", True) + self.special[i])
                self.utf8.reset()
            else:
                out.append(self.utf8.decode(self.part.get(i, b"")))
        return "".join(out)

    def close(self) -> str:
        return "" if self.mode == "tokens" else self.utf8.decode(b"", True)


def _joined(found: list[tuple[str, tuple[int, ...]]]) -> tuple[str, list[int]]:
    return " ".join([x[0] for x in found]), [i for x in found for i in x[1]]


def _digested(tokenizer):
    def run(batches):
        t = tokenizer.value
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column("_text"):
                a, b, total, d = hashlib.sha256(), hashlib.sha256(), 0, t.decoder()
                for written, some in t.stretches(text.as_py() or ""):
                    a.update((" " + written if total else written).encode())
                    b.update(d.feed(some).encode())
                    total += len(some)
                b.update(d.close().encode())
                n.append(total)
                ids.append(a.hexdigest())
                decoded.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                                             ["_key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(tokenizer):
    def run(batches):
        t = tokenizer.value
        for batch in batches:
            ids = [t.encode(text.as_py() or "") for text in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(t.decode, ids), pa.string())],
                                             ["_key", "ids", "decoded"])

    return run


def _over(docs: DataFrame, path: str | None, key: str, text: str, run, columns: str) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer.load(path))
    return rows.mapInArrow(sliced(run(shared)), f"_key {rows.schema['_key'].dataType.simpleString()}, {columns}").withColumnRenamed("_key", key)


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ids (array of int) and decoded of every row; see ``digests``."""
    return _over(docs, path, key, text, _encoded, "ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, ids_sha256 (of the decimal ids joined by blanks) and
    decoded_sha256 (of the decoded text) of every row.

    Special tokens that stand in a text are recognised, none are added, texts
    are neither cut nor padded.  Null texts are empty: no token.  Repeated
    rows stay separate; an empty table gives an empty result; other columns
    are not read.
    """
    return _over(docs, path, key, text, _digested, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents", "doc_id", "text"))
