"""DuckDB spellings of the text rules in ``tessera.functions.text``.

Used only to write the independent oracle queries.  RE2 has no ``\\x0b`` in
``\\s``, so it is listed explicitly to match Java's class.
"""

from __future__ import annotations

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean(x: str) -> str:
    return strip(f"replace({x}, chr(10), ' ')")


def ws_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def alnum_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"


def first_word(x: str) -> str:
    return f"lower(({ws_tokens(x)})[1])"


def lines(x: str) -> str:
    return (f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: {strip('s')}), "
            f"lambda s: s <> '')")


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), "
            f"lambda s: s <> '')")


def ngrams(tok: str, n: int) -> str:
    if n == 1:
        return tok
    return (f"(CASE WHEN len({tok}) >= {n} THEN list_transform(range(1, len({tok}) - {n - 2}), "
            f"lambda i: array_to_string({tok}[i:i + {n - 1}], ' ')) ELSE []::VARCHAR[] END)")


PAIRS_CONV = """pairs_conv AS (
  SELECT u.conv_id, u.turn, u.text AS source, a.text AS target
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

DOC_LINES = f"""doc_lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, {lines('text')} AS l FROM documents))"""

DOC_GOLD = """doc_gold AS (
  SELECT d.doc_id AS sample_id, l.line AS gold, d.text AS source
  FROM documents d JOIN doc_lines l ON l.doc_id = d.doc_id AND l.line_no = 0)"""

DOC_CANDS = """doc_cands AS (
  SELECT c.doc_id AS sample_id, c.line_no - 1 AS cand_rank, c.line AS text, g.line AS gold
  FROM doc_lines c JOIN doc_lines g ON g.doc_id = c.doc_id AND g.line_no = 0
  WHERE c.line_no >= 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def ngram_match_ctes(src: str, keys: list[str], ptok: str, rtok: str, n: int, name: str) -> str:
    """CTEs ending in ``{name}(keys..., np, nr, m)``: n-gram totals and the
    clipped match count, by unnest + group + join (independent of the
    sorted-run formulation used in Spark)."""
    k = ", ".join(keys)
    return f"""{name}_t0 AS (SELECT {k}, {ptok} AS ptok, {rtok} AS rtok FROM {src}),
{name}_t AS (SELECT {k}, {ngrams('ptok', n)} AS pg, {ngrams('rtok', n)} AS rg FROM {name}_t0),
{name}_pc AS (SELECT {k}, g, count(*) AS c FROM (SELECT {k}, unnest(pg) AS g FROM {name}_t) GROUP BY ALL),
{name}_rc AS (SELECT {k}, g, count(*) AS c FROM (SELECT {k}, unnest(rg) AS g FROM {name}_t) GROUP BY ALL),
{name}_m AS (SELECT {k}, sum(least(a.c, b.c)) AS m FROM {name}_pc a JOIN {name}_rc b USING ({k}, g) GROUP BY ALL),
{name} AS (SELECT {k}, len(pg) AS np, len(rg) AS nr, coalesce(m, 0) AS m
           FROM {name}_t LEFT JOIN {name}_m USING ({k}))"""


def rouge_n_ctes(src: str, keys: list[str], pred: str, ref: str, n: int, name: str) -> str:
    return ngram_match_ctes(src, keys, alnum_tokens(pred), alnum_tokens(ref), n, name)


# fixed value: the punctuation class of the 13a tokeniser
TOK13A_PUNCT = r"([\{-~\[-` -&(-+:-@/])"


def tokens_13a(x: str) -> str:
    y = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for ent, ch in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        y = f"replace({y}, '{ent}', '{ch}')"
    y = f"(' ' || {y} || ' ')"
    y = f"regexp_replace({y}, '{TOK13A_PUNCT}', ' \\1 ', 'g')"
    y = f"regexp_replace({y}, '([^0-9])([.,])', '\\1 \\2 ', 'g')"
    y = f"regexp_replace({y}, '([.,])([^0-9])', ' \\1 \\2', 'g')"
    y = f"regexp_replace({y}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    return ws_tokens(y)


def normalize(x: str) -> str:
    from tessera.functions import text as tx
    y = f"translate({x}, '{tx.NORM_PUNCT_FROM.replace(chr(39), chr(39) * 2)}', '{tx.NORM_PUNCT_TO.replace(chr(39), chr(39) * 2)}')"
    y = f"regexp_replace({y}, '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]', ' ', 'g')"
    y = f"translate({y}, '{tx.DIACRITICS_FROM}', '{tx.DIACRITICS_TO}')"
    y = f"regexp_replace({y}, ' +([.,!?;:])', '\\1', 'g')"
    y = f"regexp_replace({y}, '{WS}+', ' ', 'g')"
    return strip(y)


def prf_cols(m: str, np_: str, nr: str, prefix: str) -> str:
    p = f"(CASE WHEN {np_} > 0 THEN {m} / {np_} ELSE 0.0 END)"
    r = f"(CASE WHEN {nr} > 0 THEN {m} / {nr} ELSE 0.0 END)"
    f = f"(CASE WHEN {p} + {r} > 0 THEN 2.0 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
    return f"{p} AS {prefix}_p, {r} AS {prefix}_r, {f} AS {prefix}_f"


def f1(m: str, np_: str, nr: str) -> str:
    p = f"(CASE WHEN {np_} > 0 THEN {m} / {np_} ELSE 0.0 END)"
    r = f"(CASE WHEN {nr} > 0 THEN {m} / {nr} ELSE 0.0 END)"
    return f"(CASE WHEN {p} + {r} > 0 THEN 2.0 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"


def seeded_hash(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 15))::BIGINT"


def lcs_len(a: str, b: str) -> str:
    """LCS length of two token lists by a row-by-row DP fold."""
    rows = f"list_transform({a}, lambda x: list_transform({b}, lambda y: CASE WHEN x = y THEN 1 ELSE 0 END))"
    n = f"len({b})"
    return (f"list_reduce({rows}, lambda r, e: list_reduce(range(1, {n} + 1), lambda acc, j: "
            f"list_append(acc, CASE WHEN e[j] = 1 THEN r[j] + 1 ELSE greatest(r[j + 1], acc[-1]) END), "
            f"[0]::BIGINT[]), list_resize([0]::BIGINT[], {n} + 1, 0))[-1]")
