"""Learned sentence boundaries and what counts sentences by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rouge as rg
from tessera.functions import text as tx
from tessera.operators import augment as au
from tessera.operators import boundaries as bd
from tessera.plans import derived
from tessera.plans import sqltext as sq
from tessera.plans.augment_queries import _DUP_SQL, _dups
from tessera.plans.catalog import register
from tessera.session import cut_lineage

R = 6


def _quoted(x: str) -> str:
    return x.replace("'", "''")


_TOKENS = f"""tk AS (SELECT key, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS r
  FROM (SELECT key, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM texts)),
tc AS (SELECT key, pos, regexp_replace(r, '^{_quoted(bd.OPEN)}+', '') AS i FROM tk),
te AS (SELECT key, pos, regexp_replace(i, '{_quoted(bd.CLOSE)}+\\z', '') AS e, regexp_replace(i, '{_quoted(bd.TRAIL)}+\\z', '') AS core FROM tc),
tw AS (SELECT key, pos, lower(regexp_replace(core, '[.?!…]+\\z', '')) AS w,
  CASE WHEN regexp_matches(e, '[?!]\\z') THEN 'final' WHEN regexp_matches(e, '\\.\\.\\z|…\\z') THEN 'ellipsis'
       WHEN regexp_matches(e, '\\.\\z') THEN 'dot' ELSE 'mid' END AS kind,
  regexp_matches(core, '(^|[^.])\\.\\z') AS dot,
  CASE WHEN regexp_matches(core, '^\\p{{Lu}}') THEN 'upper' WHEN regexp_matches(core, '^\\p{{Ll}}') THEN 'lower' ELSE 'other' END AS cs FROM te),
tt AS (SELECT key, pos, CASE WHEN regexp_matches(w, '^-?[0-9][0-9.,]*\\z') THEN '##number##' ELSE w END AS word, kind, dot, cs FROM tw),
t AS (SELECT *, lag(word) OVER o AS pw, lag(kind) OVER o AS pk, lead(word) OVER o AS nw, lead(cs) OVER o AS ncs FROM tt WINDOW o AS (PARTITION BY key ORDER BY pos))"""


def _ll(k: str, n: str, x: str) -> str:
    return f"(CASE WHEN {k} = 0 THEN 0.0 ELSE {k} * ln({x}) END + CASE WHEN {n} - {k} = 0 THEN 0.0 ELSE ({n} - {k}) * ln(1 - {x}) END)"


def _assoc(a: str, b: str, ab: str, n: str) -> str:
    rest, more = f"({n} - {a})", f"({b} - {ab})"
    return (f"(-2 * ({_ll(ab, a, f'({b} / {n})')} + {_ll(more, rest, f'({b} / {n})')}"
            f" - {_ll(ab, a, f'({ab} / {a})')} - {_ll(more, rest, f'({more} / {rest})')}))")


_MODEL = _TOKENS + f""",
tot AS (SELECT CAST(greatest(count(*), 1) AS DOUBLE) AS n, CAST(count(*) FILTER (dot) AS DOUBLE) AS d FROM t),
ct AS (SELECT word, CAST(count(*) AS DOUBLE) AS c, CAST(count(*) FILTER (dot) AS DOUBLE) AS cd FROM t GROUP BY word),
cl AS (SELECT ct.*, tot.n, tot.d, length(word) - length(replace(word, '.', '')) AS inn FROM ct, tot),
sc AS (SELECT *, CASE WHEN cd > 0 AND d < n AND regexp_matches(word, '\\p{{L}}') THEN
         -2 * ({_ll('cd', 'c', '(d / n)')} - {_ll('cd', 'c', '0.99')}) * exp(inn - length(word)) * (inn + 1) * pow(length(word) - inn, cd - c) ELSE 0.0 END AS score FROM cl),
ab AS (SELECT word FROM sc WHERE score >= 0.3),
pl AS (SELECT t.*, pk = 'dot' AND ab.word IS NULL AND NOT regexp_matches(pw, '^\\p{{L}}\\z') AND pw <> '##number##' AS clear FROM t LEFT JOIN ab ON t.pw = ab.word),
pp AS (SELECT *, CASE WHEN pk IS NULL OR pk = 'final' OR clear THEN 'first' WHEN pk = 'mid' THEN 'inside' ELSE 'unclear' END AS place FROM pl),
cs AS (SELECT word, bool_or(cs = 'lower') AS lo, bool_or(cs = 'lower' AND place = 'first') AS lo1, bool_or(cs = 'upper') AS up,
              bool_or(cs = 'upper' AND place = 'inside') AS upi, CAST(count(*) FILTER (clear) AS DOUBLE) AS after FROM pp GROUP BY word),
en AS (SELECT coalesce(sum(after), 0.0) AS ends FROM cs),
ty AS (SELECT sc.*, cs.lo, cs.lo1, cs.up, cs.upi, CASE WHEN regexp_matches(sc.word, '^\\p{{L}}') AND after > 0 AND after * n > ends * c
         THEN {_assoc('ends', 'c', 'after', 'n')} >= 30 ELSE FALSE END AS starter FROM sc JOIN cs USING (word), en),
co AS (SELECT pw, word, CAST(count(*) AS DOUBLE) AS nb FROM pp
       WHERE pk = 'dot' AND (regexp_matches(pw, '^\\p{{L}}\\z') OR pw = '##number##') AND word <> '' GROUP BY pw, word),
cc AS (SELECT co.pw, co.word FROM co JOIN ct a ON a.word = co.pw JOIN ct b ON b.word = co.word, tot
       WHERE CASE WHEN nb * tot.n > a.c * b.c THEN {_assoc('a.c', 'b.c', 'nb', 'tot.n')} ELSE 0.0 END >= 7.88)"""


def _breaks(texts: str, of: str = "k") -> str:
    """CTEs up to ``br(key, n, b)`` over another relation of (key, text), with the model of ``texts``."""
    other = _TOKENS
    for name in ("tk", "tc", "te", "tw", "tt"):
        other = other.replace(f"{name} AS (", f"{of}{name} AS (").replace(f"FROM {name})", f"FROM {of}{name})").replace(f"FROM {name} ", f"FROM {of}{name} ")
    other = other.replace("\nt AS (", f"\n{of} AS (").replace("FROM texts", f"FROM {texts}")
    begins = "(k.ncs = 'upper' AND coalesce(f.lo, FALSE) AND NOT coalesce(f.upi, FALSE))"
    return f"""{other},
{of}h AS (SELECT {of}.*, ab.word IS NOT NULL AS short, kind = 'dot' AND regexp_matches({of}.word, '^\\p{{L}}\\z') AS initial, kind = 'dot' AND {of}.word = '##number##' AS num
  FROM {of} LEFT JOIN ab ON ab.word = {of}.word WHERE kind <> 'mid' AND nw IS NOT NULL),
{of}b AS (SELECT k.key, k.pos, CASE WHEN kind = 'final' THEN TRUE WHEN (initial OR num) AND cc.word IS NOT NULL THEN FALSE
    WHEN (kind = 'ellipsis' OR kind = 'dot' AND short) AND NOT initial AND NOT num THEN {begins} OR (k.ncs = 'upper' AND coalesce(f.starter, FALSE))
    WHEN initial OR num THEN NOT (k.ncs = 'lower' AND (coalesce(f.up, FALSE) OR NOT coalesce(f.lo1, FALSE)))
         AND NOT (initial AND k.ncs = 'upper' AND NOT coalesce(f.lo, FALSE) AND NOT {begins})
    ELSE TRUE END AS b
  FROM {of}h k LEFT JOIN ty f ON f.word = k.nw LEFT JOIN cc ON cc.pw = k.word AND cc.word = k.nw)"""


_DOCS = "texts AS (SELECT doc_id AS key, text FROM documents),\n"


def _model(spark, sf):
    return bd.train(derived.documents(spark, sf))


@register("sentence_types", "P6 U2 trained", "WITH " + _DOCS + _MODEL + f"""
SELECT word, CAST(c AS BIGINT) AS n, CAST(cd AS BIGINT) AS n_dot, round(score, {R}) + 0.0 AS score, score >= 0.3 AS abbreviation, starter,
       lo AS lower, lo1 AS lower_first, up AS upper, upi AS upper_inside FROM ty""")
def sentence_types(spark, sf):
    """Every word type with its counts, abbreviation score and case flags."""
    return _model(spark, sf).types.withColumn("score", F.round("score", R) + F.lit(0.0))


@register("sentence_collocations", "U2 trained", "WITH " + _DOCS + _MODEL + "\nSELECT pw AS before, word FROM cc")
def sentence_collocations(spark, sf):
    return _model(spark, sf).collocations


@register("sentence_boundaries", "P6 P12 U2 trained", "WITH " + _DOCS + _MODEL + ",\n" + _breaks("texts", "k") + """
SELECT d.doc_id, CAST(CASE WHEN n.key IS NULL THEN 0 ELSE 1 + coalesce(g.n, 0) END AS BIGINT) AS n_sentences, coalesce(g.b, '') AS boundaries
FROM documents d LEFT JOIN (SELECT DISTINCT key FROM tk) n ON n.key = d.doc_id
LEFT JOIN (SELECT key, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS b FROM kb WHERE b GROUP BY key) g ON g.key = d.doc_id""")
def sentence_boundaries(spark, sf):
    """Sentences of every whole document, and the tokens that end one."""
    docs, model = derived.documents(spark, sf), _model(spark, sf)
    found = cut_lineage(bd.boundaries(docs, model))
    return bd.sentence_counts(docs, model, name="n_sentences", found=found).join(found, "doc_id", "left").select(
        "doc_id", "n_sentences", F.coalesce(F.array_join("boundaries", " "), F.lit("")).alias("boundaries"))


_MINED = "WITH " + _DOCS + _MODEL + ",\n" + _DUP_SQL.removeprefix("WITH ").split(",\nst AS (")[0] + """,
qs AS (SELECT CAST(id1 AS VARCHAR) || ' ' || CAST(id2 AS VARCHAR) || ' 1' AS key, q1 AS text FROM dups WHERE is_duplicate = 1
       UNION ALL SELECT CAST(id1 AS VARCHAR) || ' ' || CAST(id2 AS VARCHAR) || ' 2', q2 FROM dups WHERE is_duplicate = 1),
""" + _breaks("qs", "k") + """,
sn AS (SELECT qs.key, CASE WHEN x.key IS NULL THEN 0 ELSE 1 + coalesce(g.n, 0) END AS n FROM qs LEFT JOIN (SELECT DISTINCT key FROM ktk) x USING (key)
       LEFT JOIN (SELECT key, count(*) AS n FROM kb WHERE b GROUP BY key) g USING (key)),
st AS (SELECT id1, id2, a.n AS n1, b.n AS n2 FROM dups JOIN sn a ON a.key = CAST(id1 AS VARCHAR) || ' ' || CAST(id2 AS VARCHAR) || ' 1'
       JOIN sn b ON b.key = CAST(id1 AS VARCHAR) || ' ' || CAST(id2 AS VARCHAR) || ' 2' WHERE is_duplicate = 1)
SELECT id1, id2, CAST(n1 AS BIGINT) AS num_sent_1, CAST(n2 AS BIGINT) AS num_sent_2, CAST(abs(n1 - n2) AS BIGINT) AS sent_diff
FROM st WHERE abs(n1 - n2) >= 1 AND (n1 = 1 OR n2 = 1)"""


@register("mine_augmentation_trained", "C2 F2 F3 P6 trained", _MINED)
def mine_augmentation_trained(spark, sf):
    """The miner with sentences counted by the learned boundaries: of whole
    documents once each, and of a line and a line with the next."""
    docs, model = derived.documents(spark, sf), _model(spark, sf)
    pairs = cut_lineage(_dups(spark, sf).where(F.col("is_duplicate") == 1).select("id1", "id2", "is_duplicate"))
    whole = cut_lineage(bd.sentence_counts(docs, model))
    lines = docs.select("doc_id", tx.non_empty_lines("text").alias("_l")).select(
        F.col("doc_id").alias("id1"), F.posexplode(F.transform("_l", lambda x, i: F.struct(x.alias("a"), F.get("_l", i + 1).alias("b")))).alias("i", "p"))
    lines = lines.where(F.col("p.b").isNotNull()).select("id1", (-1 - F.col("i")).cast("long").alias("id2"), "p").join(pairs, ["id1", "id2"])
    sides = lines.select("id1", "id2", F.inline(F.array(F.struct(F.lit(1).alias("side"), F.col("p.a").alias("text")),
                                                        F.struct(F.lit(2).alias("side"), F.concat_ws(" ", "p.a", "p.b").alias("text")))))
    sides = cut_lineage(sides.withColumn("_key", F.concat_ws(" ", "id1", "id2", "side")))
    counts = sides.select("id1", "id2", "side", "_key").join(bd.sentence_counts(sides, model, "_key"), "_key")
    short = counts.groupBy("id1", "id2").agg(F.max(F.when(F.col("side") == 1, F.col("num_sent"))).alias("num_sent_1"),
                                             F.max(F.when(F.col("side") == 2, F.col("num_sent"))).alias("num_sent_2"))
    stars = pairs.where(F.col("id2") >= 0)
    for side in (1, 2):
        stars = stars.join(whole.withColumnsRenamed({"doc_id": f"id{side}", "num_sent": f"num_sent_{side}"}), f"id{side}")
    both = stars.select("id1", "id2", "num_sent_1", "num_sent_2").unionByName(short).withColumn("is_duplicate", F.lit(1))
    return au.mine(both).select("id1", "id2", "num_sent_1", "num_sent_2", "sent_diff")


@register("rouge_lsum_trained", "B3 P12 trained")
def rouge_lsum_trained(spark, sf):
    """ROUGE-Lsum of every whole document against its first line, over the
    sentences that the learned boundaries give."""
    gold, model = derived.doc_gold(spark, sf), _model(spark, sf)
    sides = gold.select(F.inline(F.array(F.struct(F.concat_ws(" ", "sample_id", F.lit("p")).alias("_key"), "sample_id", F.lit("p").alias("side"), F.col("source").alias("text")),
                                         F.struct(F.concat_ws(" ", "sample_id", F.lit("r")).alias("_key"), "sample_id", F.lit("r").alias("side"), F.col("gold").alias("text")))))
    cut = bd.with_sentences(sides, model, "_key").select(
        "sample_id", "side", F.filter(F.transform("sentences", lambda s: tx.alnum_tokens(s)), lambda t: F.size(t) > 0).alias("s"))
    both = cut.groupBy("sample_id").agg(F.max(F.when(F.col("side") == "p", F.col("s"))).alias("p"), F.max(F.when(F.col("side") == "r", F.col("s"))).alias("r"))
    s = rg.rouge_lsum_tokens(F.col("p"), F.col("r"))
    return both.select("sample_id", F.inline(F.array(s))).select(
        "sample_id", F.round("p", R).alias("rlsum_p"), F.round("r", R).alias("rlsum_r"), F.round("f", R).alias("rlsum_f"))
