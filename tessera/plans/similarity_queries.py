"""Hashed TF-IDF vectors, the sparse cosine join, and dictionary matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import mentions as mn
from tessera.operators import sparse
from tessera.operators.cluster import connected_components
from tessera.plans import derived
from tessera.plans import sqltext as sq
from tessera.plans.augment_queries import _MENTIONS, _mentions
from tessera.plans.catalog import register
from tessera.sources.tables import table

R = 6
COSINE = 0.8

_VECTORS = f"""ws AS (SELECT doc_id AS id, unnest({sq.ws_tokens('lower(text)')}) AS word FROM documents),
wc AS (SELECT id, word, count(*) AS c FROM ws GROUP BY id, word),
tc AS (SELECT id, {sq.seeded_hash('word', 0)} % {1 << sparse.BITS} AS term, sum(c) AS c FROM wc GROUP BY ALL),
tn AS (SELECT term, count(*) AS n FROM tc GROUP BY term),
tw AS (SELECT id, term, n, c * (ln((1.0 + (SELECT count(DISTINCT id) FROM tc)) / (1 + n)) + 1) AS w FROM tc JOIN tn USING (term)),
tv AS (SELECT id, term, n, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM tw)"""


def _vectors(spark, sf):
    return sparse.tfidf(derived.documents(spark, sf))


@register("tfidf_vectors", "U5", "WITH " + _VECTORS + f"""
SELECT id AS doc_id, count(*) AS n_terms, round(max(w), {R}) AS heaviest, round(sum(w), {R}) AS weight FROM tv GROUP BY id""")
def tfidf_vectors(spark, sf):
    """The vectors of all whole documents, by their figures."""
    weights = F.transform("vector", lambda t: t["weight"])
    return _vectors(spark, sf).select(F.col("id").alias("doc_id"), F.size("vector").cast("long").alias("n_terms"), F.round(F.array_max(weights), R).alias("heaviest"),
                                      F.round(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), R).alias("weight"))


_SAME = """se AS (SELECT id, min(id) OVER (PARTITION BY k) AS same FROM (SELECT id, string_agg(term || ':' || c, ' ' ORDER BY term) AS k FROM tc GROUP BY id))"""


@register("similar_documents", "U5 sparse join", "WITH " + _VECTORS + ",\n" + _SAME + f""",
p AS (SELECT a.id AS id1, b.id AS id2, sum(a.w * b.w) AS cosine FROM tv a JOIN tv b ON a.term = b.term AND a.id < b.id
      WHERE a.id IN (SELECT same FROM se) AND b.id IN (SELECT same FROM se) GROUP BY ALL)
SELECT id1, id2, round(cosine, {R}) AS cosine FROM p WHERE cosine >= {COSINE}""")
def similar_documents(spark, sf):
    """All pairs of different document vectors with a cosine of COSINE or more."""
    pairs, _ = sparse.cosine_join(_vectors(spark, sf), COSINE)
    return pairs.select("id1", "id2", F.round("cosine", R).alias("cosine"))


@register("equal_documents", "U5 sparse join", "WITH " + _VECTORS + ",\n" + _SAME + "\nSELECT id AS doc_id, same FROM se")
def equal_documents(spark, sf):
    """The first document with the same vector as each."""
    _, members = sparse.cosine_join(_vectors(spark, sf), COSINE, compare=False)
    return members.select(F.col("id").alias("doc_id"), "same")


_BLIND = "WITH RECURSIVE " + _MENTIONS + """,
ow AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([a-z]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
blinded AS (SELECT o.doc_id, array_to_string(list_transform(parts, lambda p: CASE WHEN g.ms IS NOT NULL AND list_contains(g.ms, p) THEN 'disease' ELSE p END), '') AS text
  FROM ow o LEFT JOIN (SELECT doc_id, list(mention) AS ms FROM ms WHERE score > 0.5 AND length(mention) >= 16 GROUP BY doc_id) g USING (doc_id)),
""" + _VECTORS.replace("FROM documents", "FROM blinded")


@register("cluster_blinded", "C16 C15 P13 U5", _BLIND + f""",
p AS (SELECT a.id AS s, b.id AS t FROM tv a JOIN tv b ON a.term = b.term AND a.id <> b.id GROUP BY ALL HAVING sum(a.w * b.w) >= {COSINE}),
r(v, lab) AS (SELECT DISTINCT id, id FROM tv UNION SELECT p.t, r.lab FROM r JOIN p ON p.s = r.v)
SELECT v AS doc_id, min(lab) AS cluster FROM r GROUP BY v""")
def cluster_blinded(spark, sf):
    """Documents with their own mentions blinded, embedded after that, and
    grouped by links of cosine COSINE or more."""
    vectors = sparse.tfidf(blind_own_mentions(spark, sf))
    pairs, members = sparse.cosine_join(vectors, COSINE)
    links = pairs.select("id1", "id2").unionByName(members.where(F.col("id") != F.col("same")).select(F.col("same").alias("id1"), F.col("id").alias("id2")))
    return connected_components(members.select(F.col("id").alias("doc_id")), links, "doc_id")


_LONG = "[a-z]{8,}"


def _dictionary(spark, sf):
    return table(spark, sf, "benchmark", ["text"]).select(F.explode(F.regexp_extract_all("text", F.lit(_LONG), F.lit(0))).alias("mention"))


_SPANS_SQL = f"""WITH RECURSIVE dict AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_LONG}')) AS m FROM benchmark),
pt AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS k
  FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([a-z]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents)),
ps AS (SELECT doc_id, part, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM pt),
rn AS (SELECT DISTINCT part FROM ps WHERE regexp_matches(part, '^[a-z]+$')),
hr AS (SELECT part, m, unnest(list_filter(range(1, length(part) - length(m) + 2), lambda i: part[i:i + length(m) - 1] = m)) - 1 AS s FROM rn JOIN dict ON contains(part, m)),
occ AS (SELECT doc_id, m, CAST(off + s AS BIGINT) AS s FROM ps JOIN hr USING (part)),
longest AS (SELECT doc_id, s, max(s + length(m)) AS e FROM occ GROUP BY doc_id, s),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM longest),
pick(doc_id, k, s, e, upto, kept) AS (
  SELECT doc_id, k, s, e, e, TRUE FROM ordered WHERE k = 1
  UNION ALL SELECT o.doc_id, o.k, o.s, o.e, CASE WHEN o.s >= p.upto THEN o.e ELSE p.upto END, o.s >= p.upto FROM pick p JOIN ordered o ON o.doc_id = p.doc_id AND o.k = p.k + 1),
spans AS (SELECT doc_id, s, e FROM pick WHERE kept)"""


@register("dictionary_spans", "P13 F5 dictionary", _SPANS_SQL + """
SELECT d.doc_id, count(s) AS n_mentions, coalesce(string_agg(s || '-' || e, ' ' ORDER BY s), '') AS spans
FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id""")
def dictionary_spans(spark, sf):
    """Where the long words of the benchmark stand in every whole document."""
    found = mn.mention_spans(derived.documents(spark, sf), _dictionary(spark, sf))
    written = F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", F.size("spans").cast("long").alias("n_mentions"), F.array_join(written, " ").alias("spans"))


@register("blind_dictionary", "P13 dictionary", _SPANS_SQL + """,
cuts AS (SELECT doc_id, 0 AS a, 0 AS b FROM documents UNION ALL SELECT doc_id, s, e FROM spans),
gaps AS (SELECT doc_id, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a, b) AS nxt FROM cuts)
SELECT d.doc_id, string_agg(CASE WHEN nxt IS NULL THEN substr(d.text, b + 1) ELSE substr(d.text, b + 1, nxt - b) END, 'disease' ORDER BY b) AS text
FROM gaps JOIN documents d USING (doc_id) GROUP BY d.doc_id""")
def blind_dictionary(spark, sf):
    """Every document with the dictionary's mentions blinded."""
    docs = derived.documents(spark, sf)
    return mn.blind_spans(docs, mn.mention_spans(docs, _dictionary(spark, sf)))


@register("blind_own_mentions", "P13", "WITH " + _MENTIONS + """,
ow AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([a-z]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)
SELECT o.doc_id, array_to_string(list_transform(parts, lambda p: CASE WHEN g.ms IS NOT NULL AND list_contains(g.ms, p) THEN 'disease' ELSE p END), '') AS text
FROM ow o LEFT JOIN (SELECT doc_id, list(mention) AS ms FROM ms WHERE score > 0.5 AND length(mention) >= 16 GROUP BY doc_id) g USING (doc_id)""")
def blind_own_mentions(spark, sf):
    """Every document with its own mentions of sixteen and more letters blinded."""
    m = _mentions(spark, sf).where((F.col("score") > 0.5) & (F.length("mention") >= 16))
    return mn.blind_own(derived.documents(spark, sf), m)
