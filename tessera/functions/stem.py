"""Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980)
with its later published extensions, applied to ROUGE tokens longer than three
characters.

Stemming is per word, so it runs inside an Arrow-batched pandas UDF over the
token arrays with a per-worker memo: each distinct word is stemmed once per
Python worker, and no vocabulary is ever broadcast.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = set("aeiou")


def _cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    m, i, n = 0, 0, len(stem)
    while i < n and _cons(stem, i):
        i += 1
    while i < n:
        while i < n and not _cons(stem, i):
            i += 1
        if i >= n:
            break
        m += 1
        while i < n and _cons(stem, i):
            i += 1
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    if n == 2:
        return not _cons(w, 0) and _cons(w, 1)
    return (n >= 3 and _cons(w, n - 3) and not _cons(w, n - 2) and _cons(w, n - 1)
            and w[-1] not in "wxy")


def _replace(w: str, rules, cond) -> str:
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if cond(stem) else w
    return w


# --- fixed values: suffix rules of the published algorithm, steps 2-4, in
# order, and the later extensions (irregular forms, bli, fulli, logi) ---------
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
          ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
          ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
          ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
          ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
          ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
          "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
_IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
              "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
              "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
              "exceed": "exceed", "succeed": "succeed"}
# ---------------------------------------------------------------------------


def _step2(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _step2(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _replace(w, _STEP2, lambda s: _measure(s) > 0)


@lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = word
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # step 1b
    extra = False
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w):
            w = w if w[-1] in "lsz" else w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and len(w) > 2 and _cons(w, len(w) - 2):
        w = w[:-1] + "i"
    w = _step2(w)
    w = _replace(w, _STEP3, lambda s: _measure(s) > 0)
    # step 4
    for suf in _STEP4:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            if _measure(stem) > 1 and (suf != "ion" or stem.endswith(("s", "t"))):
                w = stem
            if suf != "ion" or stem.endswith(("s", "t")):
                break
    # step 5a
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    # step 5b
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stem_token(tok: str) -> str:
    """ROUGE convention: only tokens longer than three characters are stemmed."""
    return porter(tok) if len(tok) > 3 else tok


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens_udf(tokens: pd.Series) -> pd.Series:
    return pd.Series([[stem_token(t) for t in toks] if toks is not None else []
                      for toks in tokens])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def stem_nested_udf(token_lists: pd.Series) -> pd.Series:
    """Stem an array of token arrays (e.g. all lines of a document) in one call."""
    return pd.Series([[[stem_token(t) for t in toks] for toks in lists] if lists is not None else []
                      for lists in token_lists])
