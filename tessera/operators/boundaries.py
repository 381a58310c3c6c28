"""Unsupervised sentence boundaries (P6 P12 U2, after Kiss and Strunk 2006).

What a period after a word means is learned from the corpus itself:

* a word type is an *abbreviation* if a log-likelihood ratio says that it
  nearly always has a period, scaled down for long types and for occurrences
  without one, and up for inner periods;
* words that follow clear sentence ends more often than chance are *starters*;
* a number or an initial and the word after its period are a *collocation* if
  they meet more often than chance;
* the case that words have inside and at the beginning of sentences tells
  whether a word after an unclear period begins one.

All statistics come from one table: the tokens of all texts, each with the
token before it where that has a period, counted (map-side first) as they
stand and then by what they are.  Only three
totals reach the driver.  The classifier explodes the places that may be a
boundary and joins the learned types; AQE broadcasts them while they are
small.  Places that need no second look-up get a key of their own in its join,
so that they don't meet in one partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import let, once
from tessera.functions.text import strip
from tessera.session import cut_lineage

# --- fixed values: the constants of the method ------------------------------
ABBREVIATION = 0.3
COLLOCATION = 7.88
STARTER = 30.0
#: Probability of a period after an abbreviation.
ALWAYS = 0.99
# ----------------------------------------------------------------------------
SPACE = r"[\x20\x09-\x0D]"
OPEN = r"""[("'\[{“‘«¿¡]"""
CLOSE = r"""[)"'\]}”’»]"""
TRAIL = r"""[)"'\]}”’»,;:]"""
NUMBER = "##number##"
#: The characters of SPACE, OPEN and CLOSE, for trims.
WHITE, _OPEN, _CLOSE = " \t\n\x0b\f\r", "(\"'[{“‘«¿¡", ")\"']}”’»"


def pieces(text: Column) -> Column:
    """The tokens of a text, each with the white space after it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"([^\x20\x09-\x0D]+{SPACE}*)"), F.lit(1))


def token(piece: Column) -> Column:
    """(word, kind, dot, case) of a token.  ``word`` is lower-cased, without
    outer punctuation, numbers as one type; ``kind`` is what it ends with, but
    for closing quotes and brackets: dot, ellipsis, final (? or !) or mid;
    ``dot`` tells whether the word has a period, also before a comma."""
    bare = F.ltrim(F.rtrim(piece, F.lit(WHITE)), F.lit(_OPEN))

    def told(ends: Column, core: Column) -> Column:
        kind = (F.when(F.endswith(ends, F.lit("?")) | F.endswith(ends, F.lit("!")), "final")
                .when(F.endswith(ends, F.lit("..")) | F.endswith(ends, F.lit("…")), "ellipsis").when(F.endswith(ends, F.lit(".")), "dot").otherwise("mid"))
        first = F.substring(core, 1, 1)
        case = F.when(first.rlike(r"^\p{Lu}"), "upper").when(first.rlike(r"^\p{Ll}"), "lower").otherwise("other")
        word = let(F.lower(F.rtrim(core, F.lit(".?!…"))), lambda w: F.when(w.rlike(r"^-?[0-9][0-9.,]*\z"), NUMBER).otherwise(w))
        dot = F.endswith(core, F.lit(".")) & ~F.endswith(core, F.lit(".."))
        return F.struct(word.alias("word"), kind.alias("kind"), dot.alias("dot"), case.alias("case"))

    # most tokens are plain lower-case words
    plain = F.struct(F.rtrim(piece, F.lit(WHITE)).alias("word"), F.lit("mid").alias("kind"), F.lit(False).alias("dot"), F.lit("lower").alias("case"))
    other = let(bare, lambda x: let(F.struct(F.rtrim(x, F.lit(_CLOSE)).alias("ends"), F.rtrim(x, F.lit(_CLOSE + ",;:")).alias("core")),
                                    lambda y: told(y["ends"], y["core"])))
    return F.when(piece.rlike(rf"^[a-z]+{SPACE}*\z"), plain).otherwise(other)


def raw_tokens(text: Column) -> Column:
    """The tokens of a text as they stand, without white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def _may_end(raw: Column) -> Column:
    """False only for tokens of the kind mid: a test without an expression."""
    return F.contains(raw, F.lit(".")) | F.contains(raw, F.lit("?")) | F.contains(raw, F.lit("!")) | F.contains(raw, F.lit("…"))


def neighbours(texts: DataFrame, text: str = "text") -> DataFrame:
    """(before, kind, word, dot, case, n): how often each token follows a token
    that ends in that way (``kind`` null: the beginning of a text); ``before``
    is that token's word where it ends with a period, else null.  Tokens are
    counted as they stand first, and each different one is taken apart once."""
    rows = texts.select(once(_t=raw_tokens(F.col(text)))).where(F.size("_t") > 0)
    pairs = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.slice("_t", 1, F.size("_t") - 1)).alias("p"), F.col("_t").alias("t"))
    rows = rows.select(F.inline(pairs).alias("p", "t"))
    rows = rows.select(F.when(_may_end(F.col("p")) | F.col("p").isNull(), F.col("p")).otherwise("").alias("p"), "t")  # '' stands for all of the kind mid
    rows = rows.groupBy("p", "t").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("n", once(p=F.when(F.col("p") != "", token(F.col("p"))), mid=F.col("p") == "", t=token(F.col("t"))))
    kind = F.when(F.col("mid"), "mid").otherwise(F.col("p.kind"))
    return rows.select(F.when(kind == "dot", F.col("p.word")).alias("before"), kind.alias("kind"), "t.word", "t.dot", "t.case", "n").groupBy(
        "before", "kind", "word", "dot", "case").agg(F.sum("n").alias("n"))


def _log(k: Column, x: Column) -> Column:
    """k ln x, 0 where k is."""
    return F.when(k == 0, 0.0).otherwise(k * F.ln(x))


def _likelihood(k: Column, n: Column, x: Column) -> Column:
    return _log(k, x) + _log(n - k, 1 - x)


def association(a: Column, b: Column, both: Column, total: Column) -> Column:
    """Log-likelihood ratio of: b comes as often after a as elsewhere."""
    p, p1, p2 = F.try_divide(b, total), F.try_divide(both, a), F.try_divide(b - both, total - a)
    rest = total - a
    return -2 * (_likelihood(both, a, p) + _likelihood(b - both, rest, p) - _likelihood(both, a, p1) - _likelihood(b - both, rest, p2))


def is_initial(word: Column) -> Column:
    return word.rlike(r"^\p{L}\z")


@dataclass
class SentenceModel:
    """``types``: word, n, n_dot, score, abbreviation, starter and whether the
    word was seen lower (anywhere, first), upper (anywhere, inside);
    ``collocations``: before, word."""

    types: DataFrame
    collocations: DataFrame


def train(texts: DataFrame, text: str = "text") -> SentenceModel:
    """The model of all ``texts``.  Null texts have no token; nothing is
    sampled.  Without a token the tables are empty and every clear mark is a
    boundary."""
    seen = cut_lineage(neighbours(texts, text))
    n, n_dot = (F.sum("n"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)))
    total = seen.agg(F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(n_dot, F.lit(0)).alias("d")).first()
    words, dots = F.lit(float(max(total["n"], 1))), F.lit(float(total["d"]))
    counts = seen.groupBy("word").agg(n.alias("n"), n_dot.alias("n_dot"))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    p = dots / words
    ratio = -2 * (_likelihood(F.col("n_dot"), F.col("n"), p) - _likelihood(F.col("n_dot"), F.col("n"), F.lit(ALWAYS)))
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, F.col("n_dot") - F.col("n"))
    scored = counts.withColumn("score", F.when((F.col("n_dot") > 0) & (dots < words) & F.col("word").rlike(r"\p{L}"), score).otherwise(0.0))
    scored = cut_lineage(scored.withColumn("abbreviation", F.col("score") >= ABBREVIATION))

    short = scored.where("abbreviation").select(F.col("word").alias("before"), F.lit(True).alias("_short"))
    seen = seen.join(short, "before", "left")
    clear = (F.col("kind") == "dot") & F.col("_short").isNull() & ~is_initial(F.col("before")) & (F.col("before") != NUMBER)
    place = F.when(F.col("kind").isNull() | (F.col("kind") == "final") | clear, "first").when(F.col("kind") == "mid", "inside").otherwise("unclear")
    seen = seen.withColumns({"_clear": clear, "_place": place})
    upper, lower = F.col("case") == "upper", F.col("case") == "lower"
    after = F.coalesce(F.sum(F.when(F.col("_clear"), F.col("n"))), F.lit(0))
    cases = cut_lineage(seen.groupBy("word").agg(
        F.max(lower).alias("lower"), F.max(lower & (F.col("_place") == "first")).alias("lower_first"), F.max(upper).alias("upper"),
        F.max(upper & (F.col("_place") == "inside")).alias("upper_inside"), after.alias("_after")))
    ends = F.lit(float(cases.agg(F.coalesce(F.sum("_after"), F.lit(0))).first()[0]))
    count, at = F.col("n").cast("double"), F.col("_after").cast("double")
    starts = F.col("word").rlike(r"^\p{L}") & (at > 0) & (at * words > ends * count)
    starter = F.when(starts, F.coalesce(association(ends, count, at, words) >= STARTER, F.lit(False))).otherwise(False)
    types = cut_lineage(scored.join(cases, "word").select("word", "n", "n_dot", "score", "abbreviation", starter.alias("starter"),
                                                          "lower", "lower_first", "upper", "upper_inside"))

    loose = seen.where(is_initial(F.col("before")) | (F.col("before") == NUMBER)).where(F.col("word") != "")
    met = loose.groupBy("before", "word").agg(F.sum("n").cast("double").alias("_both"))
    sizes = counts.select("word", F.col("n").cast("double").alias("_n"))
    met = met.join(sizes.withColumnsRenamed({"word": "before", "_n": "_a"}), "before").join(sizes.withColumnRenamed("_n", "_b"), "word")
    often = F.col("_both") * words > F.col("_a") * F.col("_b")
    ratio = F.when(often, association(F.col("_a"), F.col("_b"), F.col("_both"), words)).otherwise(0.0)
    return SentenceModel(types, cut_lineage(met.where(ratio >= COLLOCATION).select("before", "word")))


def boundaries(texts: DataFrame, model: SentenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, boundaries): the numbers (from 0) of the tokens that end a
    sentence before another token, ascending, for texts that have any.  Keys
    must be unique."""
    rows = texts.select(F.col(key).alias("_key"), once(_t=raw_tokens(F.col(text)))).where(F.size("_t") > 1)
    pairs = F.arrays_zip(F.slice("_t", 1, F.size("_t") - 1).alias("a"), F.slice("_t", 2, F.size("_t") - 1).alias("b"))
    ends = rows.select("_key", F.posexplode(pairs).alias("at", "_p")).where(_may_end(F.col("_p.a")))
    ends = ends.select("_key", "at", once(a=token(F.col("_p.a")), b=token(F.col("_p.b")))).where(F.col("a.kind") != "mid")
    places = ends.select("_key", "at", F.col("a.kind").alias("kind"), F.col("a.word").alias("before"), "b.word", "b.case")
    short = model.types.where("abbreviation").select(F.col("word").alias("before"), F.lit(True).alias("_short"))
    places = places.join(short, "before", "left")
    dot = F.col("kind") == "dot"
    initial, number = dot & is_initial(F.col("before")), dot & (F.col("before") == NUMBER)
    short = (dot & F.col("_short").isNotNull() | (F.col("kind") == "ellipsis")) & ~initial & ~number
    places = places.withColumns({"_initial": initial, "_loose": initial | number, "_short": short})
    # no word has a blank: places that are clear match nothing, and are dealt evenly
    alone = F.concat(F.lit(" "), F.col("_key").cast("string"), F.lit(" "), F.col("at").cast("string"))
    places = places.withColumns({"_word": F.when(F.col("_loose") | F.col("_short"), F.col("word")).otherwise(alone),
                                 "_pair": F.when(F.col("_loose"), F.concat_ws(" ", "before", "word")).otherwise(alone)})
    flags = model.types.select(F.col("word").alias("_word"), "starter", "lower", "lower_first", "upper", "upper_inside")
    pairs = model.collocations.select(F.concat_ws(" ", "before", "word").alias("_pair"), F.lit(True).alias("_bound"))
    places = places.join(flags, "_word", "left").join(pairs, "_pair", "left")
    known = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("starter", "lower", "lower_first", "upper", "upper_inside")}
    upper, lower = F.col("case") == "upper", F.col("case") == "lower"
    begins = upper & known["lower"] & ~known["upper_inside"]
    goes_on = lower & (known["upper"] | ~known["lower_first"])
    name = F.col("_initial") & upper & ~known["lower"] & ~begins
    is_end = (F.when(F.col("kind") == "final", True)
              .when(F.col("_bound").isNotNull(), False)
              .when(F.col("_short"), begins | (upper & known["starter"]))
              .when(F.col("_loose"), ~goes_on & ~name)
              .otherwise(True))
    return places.where(is_end).groupBy("_key").agg(F.array_sort(F.collect_list("at")).alias("boundaries")).withColumnRenamed("_key", key)


def with_sentences(texts: DataFrame, model: SentenceModel, key: str = "doc_id", text: str = "text", name: str = "sentences") -> DataFrame:
    """``texts`` with their sentences (stripped, as they stand in the text) as
    an array; a null or blank text has none.  Keys must be unique."""
    found = boundaries(texts, model, key, text)
    rows = texts.join(found, key, "left").select("*", once(_p=pieces(F.col(text))))
    ends = F.concat(F.coalesce("boundaries", F.array().cast("array<int>")), F.array(F.size("_p") - 1))
    rows = rows.withColumn("_from", F.concat(F.array(F.lit(-1)), F.coalesce("boundaries", F.array().cast("array<int>")))).withColumn("_to", ends)
    parts = F.zip_with("_from", "_to", lambda a, b: strip(F.array_join(F.slice("_p", a + 2, b - a), "")))
    return rows.withColumn(name, F.when(F.size("_p") > 0, parts).otherwise(F.array().cast("array<string>"))).drop("_p", "_from", "_to", "boundaries")


def sentence_counts(texts: DataFrame, model: SentenceModel, key: str = "doc_id", text: str = "text", name: str = "num_sent",
                    found: DataFrame | None = None) -> DataFrame:
    """(key, name): the number of sentences of every text; ``found`` may give
    its ``boundaries``."""
    found = (boundaries(texts, model, key, text) if found is None else found).select(key, F.size("boundaries").alias("_n"))
    some = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return texts.select(key, some.alias("_some")).join(found, key, "left").select(
        key, F.when(F.col("_some"), F.coalesce("_n", F.lit(0)) + 1).otherwise(0).cast("long").alias(name))
