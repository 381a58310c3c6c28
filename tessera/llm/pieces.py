"""SentencePiece (merge type) encoding and decoding by a prefix table.

The encoding of a text by merges has a property that makes it a table look-up:
the tokens of a prefix are found without the rest, and a prefix has one last
token.  A sequence of tokens is an encoding exactly if every token encodes its
own text and every two neighbours encode their joint text, since merges inside
two neighbours happen in the same order whatever stands around them.

So: an automaton lists the pieces that end at each place of a text; the piece
whose predecessor (the last token of the prefix before it) fits it is the last
token of the prefix that ends there; ids are read off backwards from the end.

Whether two pieces fit is decided by replaying their merges side by side: each
piece's own merges are computed once from the vocabulary, and the two don't fit
if a merge across their border would come first at any step.

Texts are cut where no piece can reach across (before white space, if no piece
has white space after something else); stretches of ordinary length are kept
in a bounded cache.  Decoding reads ids only.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import read

SPACE = "▁"
#: Stretches, and pairs of pieces, in a worker's caches at most.
CACHE = 300_000
PAIRS = 4_000_000
#: Characters of a text that are cut into stretches at a time (at white space).
PORTION = 1 << 16
_NEVER = float("-inf")


def _byte_by_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tessera-byte-by-byte", _byte_by_byte)


@dataclass
class Pieces:
    """A merge-type model: pieces with scores, byte pieces for the rest."""

    text: list[str]  # of the pieces; characters that are no piece follow
    score: list[float]
    size: int  # ids below are pieces of the model
    bytes_: list[int]  # ids of the byte pieces, or none
    unknown: int
    control: dict[int, str]
    begin: int
    end: int
    prefix: bool
    apart: bool  # no piece has white space after another character
    _ready: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, norm = model.trainer_spec.model_type, model.normalizer_spec
        types = [p.type for p in model.pieces]
        if (kind != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or model.trainer_spec.treat_whitespace_as_suffix or not {1, 2, 3, 6}.issuperset(types)):
            raise ValueError(f"{path}: only merge models with plain, control and byte pieces and no normalisation are supported")
        pieces = list(model.pieces)
        text = [p.piece if t == 1 else "" for p, t in zip(pieces, types)]
        score = [p.score for p in pieces]
        have = set(text)
        loose = sorted({c for t in text for c in t} - have)
        byte = {int(p.piece[3:-1], 16): i for i, (p, t) in enumerate(zip(pieces, types)) if t == 6}
        return cls(text + loose, score + [_NEVER] * len(loose), len(pieces), [byte[b] for b in range(256)] if len(byte) == 256 else [],
                   types.index(2), {i: "" for i, t in enumerate(types) if t == 3}, model.trainer_spec.bos_id, model.trainer_spec.eos_id,
                   norm.add_dummy_prefix, not any(SPACE in t.lstrip(SPACE) for t in text))

    def __getstate__(self):
        return {**self.__dict__, "_ready": {}}

    # ------------------------------- the table -------------------------------

    def _history(self, number: dict[str, int], t: str) -> list[tuple[float, int, int]] | None:
        """The merges that make the piece ``t`` out of its characters, as
        (score, first token, last token after it); none if they make others."""
        parts, steps = [number[c] for c in t], []
        texts = self.text
        while len(parts) > 1:
            best, at, made = _NEVER, -1, -1
            for i in range(len(parts) - 1):
                joint = number.get(texts[parts[i]] + texts[parts[i + 1]])
                if joint is not None and joint < self.size and self.score[joint] > best:
                    best, at, made = self.score[joint], i, joint
            if at < 0:
                return None
            parts[at:at + 2] = [made]
            steps.append((best, parts[0], parts[-1]))
        return steps

    def _prepared(self) -> dict:
        r = self._ready
        if not r:
            number = {t: i for i, t in enumerate(self.text) if t}
            lefts, rights, automaton = [()] * len(self.text), [()] * len(self.text), ahocorasick.Automaton()
            for t, i in number.items():
                steps = self._history(number, t)
                if steps is not None:  # else no text has it as a token
                    lefts[i] = tuple((s, a) for s, a, _ in steps)
                    rights[i] = tuple((s, b) for s, _, b in steps)
                    automaton.add_word(t, (i, len(t)))
            automaton.make_automaton()
            r |= {"number": number, "left": lefts, "right": rights, "automaton": automaton, "fits": {}, "cache": {},
                  "first": [number[t[0]] if t else -1 for t in self.text], "last": [number[t[-1]] if t else -1 for t in self.text],
                  "cut": re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if self.apart and not any("\n" in t for t in self.text)
                                    else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.apart else r"(?s).+")}
            plain = [b""] * self.size
            for i, t in enumerate(self.text[:self.size]):
                plain[i] = t.replace(SPACE, " ").encode()
            for b, i in enumerate(self.bytes_):
                plain[i] = bytes([b])
            plain[self.unknown] = " ⁇ ".encode()
            r["plain"], r["is_byte"] = plain, np.zeros(self.size, bool)
            r["is_byte"][self.bytes_] = True
        return r

    def fit(self, u: int, v: int) -> bool:
        """Whether the texts of two pieces, joined, are encoded as the two."""
        r = self._prepared()
        text, number, score = self.text, r["number"], self.score
        mine, yours, a, b = r["right"][u], r["left"][v], 0, 0
        x, y = r["last"][u], r["first"][v]
        while True:
            joint = number.get(text[x] + text[y], self.size)
            across = score[joint] if joint < self.size else None
            own = mine[a][0] if a < len(mine) else None
            other = yours[b][0] if b < len(yours) else None
            # highest score first, of equals the leftmost
            if own is not None and (across is None or own >= across) and (other is None or own >= other):
                x, a = mine[a][1], a + 1
            elif across is not None and (other is None or across >= other):
                return False
            elif other is not None:
                y, b = yours[b][1], b + 1
            else:
                return True

    def table(self, s: str) -> list[int]:
        """For each non-empty prefix of ``s`` the last token of its encoding;
        -1 where that is a character of no piece."""
        r = self._prepared()
        last, fits, fit = [-1] * len(s), r["fits"], self.fit
        for at, (t, size) in r["automaton"].iter(s):
            if last[at] < 0:
                before = last[at - size] if at >= size else -1
                if before < 0:  # the beginning, or a character of no piece, which nothing merges with
                    last[at] = t
                else:
                    key = before << 20 | t
                    ok = fits.get(key)
                    if ok is None:
                        if len(fits) >= PAIRS:
                            fits.clear()
                        ok = fits[key] = fit(before, t)
                    if ok:
                        last[at] = t
        return last

    def tokens(self, s: str) -> list[int]:
        """The ids of a stretch, read backwards from its table."""
        last, out, at = self.table(s), [], len(s)
        while at:
            t = last[at - 1]
            if 0 <= t < self.size:
                out.append(t)
                at -= len(self.text[t])
            else:
                at -= 1
                out.extend([self.bytes_[b] for b in reversed(s[at].encode())] if self.bytes_ else [self.unknown])
        out.reverse()
        return out

    # -------------------------- encoding and decoding --------------------------

    def portions(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, in portions, without begin and end."""
        if not text:
            return
        r = self._prepared()
        cache, cut = r["cache"], r["cut"]
        at, n, first = 0, len(text), self.prefix
        while at < n:
            end = n
            if self.apart and n - at > PORTION:
                # a place before white space, after something else
                m = re.compile(f"(?<=[^ {SPACE}])[ {SPACE}]").search(text, at + PORTION)
                end = m.start() if m else n
            part = (SPACE if first else "") + text[at:end].replace(" ", SPACE)
            first, at, found = False, end, []
            for s in cut.findall(part):
                ids = cache.get(s)
                if ids is None:
                    ids = np.array(self.tokens(s), "<u4").tobytes()
                    if len(s) <= 64:
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[s] = ids
                found.append(ids)
            yield np.frombuffer(b"".join(found), "<u4")

    def encode(self, text: str) -> list[int]:
        return [i for p in self.portions(text) for i in p.tolist()]

    def decoder(self) -> Decoder:
        return Decoder(self)

    def decode(self, ids: Iterable[int]) -> str:
        d = self.decoder()
        return d.feed(np.fromiter(ids, np.int64)) + d.close()


class Decoder:
    """Text from ids, portion by portion.  Control pieces give nothing; the
    first white space of the first piece is the prefix that encoding added;
    byte pieces that stand together are read as UTF-8, and a byte that fits
    nowhere is U+FFFD; an unfinished run of bytes is held back."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.ready = pieces, pieces._prepared()
        self.held, self.fresh, self.prefix = b"", True, pieces.prefix

    def _plain(self, ids: np.ndarray) -> str:
        plain = self.ready["plain"]
        return b"".join([plain[i] for i in ids.tolist()]).decode()

    def feed(self, ids: np.ndarray) -> str:
        out = []
        is_byte = self.ready["is_byte"][ids]
        edges = [0, *(np.flatnonzero(is_byte[1:] != is_byte[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
        for a, b in zip(edges, edges[1:]):
            if is_byte[a]:
                self.held += b"".join([self.ready["plain"][i] for i in ids[a:b].tolist()])
                continue
            out.append(self.close())
            part = ids[a:b]
            if self.fresh and self.prefix:
                kept = part[~np.isin(part, list(self.pieces.control))] if self.pieces.control else part
                if len(kept) and not out[-1]:
                    t = self._plain(kept)
                    out.append(t[1:] if self.pieces.text[int(kept[0])].startswith(SPACE) else t)
                    self.fresh = False
                    continue
            out.append(self._plain(part))
        return "".join(out)

    def close(self) -> str:
        t, self.held = self.held.decode("utf-8", "tessera-byte-by-byte"), b""
        self.fresh = self.fresh and not t
        return t


def _digested(shared):
    def run(batches):
        p = shared.value
        begin, end = (np.array([i], "<u4").tobytes() for i in (p.begin, p.end))
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column("_text"):
                a, b, total, d = hashlib.sha256(begin), hashlib.sha256(), 2, p.decoder()
                for some in p.portions(text.as_py() or ""):
                    a.update(some.tobytes())
                    b.update(d.feed(some).encode())
                    total += len(some)
                a.update(end)
                b.update(d.close().encode())
                n.append(total)
                ids.append(a.hexdigest())
                decoded.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                             ["_key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(shared):
    def run(batches):
        p = shared.value
        for batch in batches:
            keys, ids, texts, held = [], [], [], 0
            field_ = batch.schema.field("_key").type

            def out():
                return pa.RecordBatch.from_arrays([pa.array(keys, field_), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["_key", "ids", "decoded"])

            for key, text in zip(batch.column("_key"), batch.column("_text")):
                found = [p.begin, *p.encode(text.as_py() or ""), p.end]
                keys.append(key.as_py())
                ids.append(found)
                texts.append(p.decode(found))
                held += len(found)
                if held > 1 << 20:
                    yield out()
                    keys, ids, texts, held = [], [], [], 0
            yield out()

    return run


def _over(docs: DataFrame, path: str | None, key: str, text: str, run, columns: str) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(path))  # a file's fixed size
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run(shared), f"_key {rows.schema['_key'].dataType.simpleString()}, {columns}").withColumnRenamed("_key", key)


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ids (array of int, with begin and end) and decoded of every
    row; see ``digests``."""
    return _over(docs, path, key, text, _encoded, "ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, ids_sha256 (of the ids as little-endian 32-bit
    integers) and decoded_sha256 (of the decoded text) of every row, with the
    begin and end ids.

    Null texts are empty: the two ids alone.  White space is kept as it is;
    U+2581 in a text is white space, as in the library.  Repeated rows and
    keys stay separate; an empty table gives an empty result; other columns,
    whatever their names, are not read.  A worker holds one batch of texts,
    the table of one stretch and two bounded caches.
    """
    return _over(docs, path, key, text, _digested, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents", "doc_id", "text"))
