"""Text cleaning, tokenising and sentence rules as native column expressions.

Every function takes and returns a ``Column`` so Catalyst keeps it inside the
generated code of the surrounding stage.  Regex classes are written once here
and mirrored in ``tessera.plans.sqltext`` for the DuckDB oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Python's str.split()/str.strip() whitespace: ASCII \s, the file/group/record/
# unit separators 0x1c-0x1f, NEL 0x85 and every Unicode separator (Z*).
PY_WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
# The same characters, for trimming.
WS_CHARS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# ROUGE tokeniser: lower-case, anything outside [a-z0-9] separates tokens.
NON_ALNUM = r"[^a-z0-9]+"
# Sentence end: one of . ! ? followed by whitespace.
SENT_END = r"([.!?])" + PY_WS + "+"
SENT_MARK = "\u0001"
# Placeholder that replaces entity mentions when blinding texts.
BLIND_TOKEN = "disease"
# Rare-category label.
RARE_LABEL = "<rare>"
# --------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def clean_text(col) -> Column:
    """Newlines become spaces, then the text is stripped."""
    return strip(F.replace(_c(col), F.lit("\n"), F.lit(" ")))


def ws_tokens(col) -> Column:
    """Python ``text.split()``: whitespace tokens, no empty strings."""
    return F.filter(F.split(_c(col), PY_WS + "+"), lambda w: w != "")


def lower_ws_tokens(col) -> Column:
    return ws_tokens(F.lower(_c(col)))


def alnum_tokens(col) -> Column:
    """ROUGE tokens: lower-case runs of ``[a-z0-9]``."""
    return F.filter(F.split(F.lower(_c(col)), NON_ALNUM), lambda w: w != "")


def word_count(col) -> Column:
    return F.size(ws_tokens(col)).cast("long")


def first_word(col) -> Column:
    """Lower-cased first whitespace token; NULL for a blank text."""
    return F.lower(F.get(ws_tokens(col), 0))


def sentences(col) -> Column:
    """Regex sentence split: break after . ! ? followed by whitespace.

    An approximation of a trained sentence model; swap in a pandas UDF via
    ``tessera.functions.hooks.sentence_splitter`` for exact behaviour.
    """
    marked = F.regexp_replace(_c(col), SENT_END, "$1" + SENT_MARK)
    return F.filter(F.transform(F.split(marked, SENT_MARK), strip), lambda s: s != "")


_PYTHON_SENT_END = re.compile(r"([.!?])\s+")  # Python's \s is PY_WS


def python_sentences(text: str) -> list[str]:
    """``sentences`` of a Python string, blank pieces and blanks around left in."""
    return _PYTHON_SENT_END.sub("\\1" + SENT_MARK, text).split(SENT_MARK)


def python_sentence_count(text: str) -> int:
    return sum(1 for s in python_sentences(text) if s.strip())


def sentence_count(col) -> Column:
    return F.size(sentences(col)).cast("long")


def sentence_per_line(col) -> Column:
    """One sentence per line (``<n>`` markers are left in place)."""
    return F.array_join(sentences(col), "\n")


def non_empty_lines(col) -> Column:
    """Cleaned, non-empty lines of a text, in order."""
    return F.filter(F.transform(F.split(_c(col), "\n"), strip), lambda s: s != "")


def first_line(col) -> Column:
    """The first of ``non_empty_lines``, without taking the others; NULL for a
    blank text."""
    line = strip(F.substring_index(F.ltrim(_c(col), F.lit(WS_CHARS)), "\n", 1))
    return F.when(line != "", line)


def add_prefix(col, prefix: str | None) -> Column:
    return F.concat(F.lit(prefix or ""), _c(col))


def char_len_with_newline(col) -> Column:
    """Character length as counted on a line that still has its newline."""
    return (F.length(_c(col)) + 1).cast("long")


# --- fixed values: text normalisation before scoring ----------------------
# Unicode punctuation mapped to ASCII, in natural order.
NORM_PUNCT_FROM = "‘’‚“”„«»–—…"
NORM_PUNCT_TO = "'''\"\"\"\"\"--."
# Latin letters with diacritics and their base letters, in natural order.
DIACRITICS_FROM = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿășşțţ"
                   "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝĂȘŞȚŢ")
DIACRITICS_TO = ("aaaaaaceeeeiiiinooooouuuuyyasstt"
                 "AAAAAACEEEEIIIINOOOOOUUUUYASSTT")
# --------------------------------------------------------------------------


def normalize_text(col, remove_diacritics: bool = True) -> Column:
    """Score-time normalisation: ASCII punctuation, no control characters,
    one space around punctuation runs collapsed, optional diacritic removal."""
    x = F.translate(_c(col), NORM_PUNCT_FROM, NORM_PUNCT_TO)
    x = F.regexp_replace(x, r"[\p{Cc}\p{Cf}\p{Co}]", " ")
    if remove_diacritics:
        x = F.translate(x, DIACRITICS_FROM, DIACRITICS_TO)
    x = F.regexp_replace(x, r" +([.,!?;:])", "$1")
    x = F.regexp_replace(x, PY_WS + "+", " ")
    return strip(x)
