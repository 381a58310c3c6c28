import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import augment as au
from tessera.operators import boundaries as bd
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
CORPUS = ["We met Dr. Miller. He was late. The plan, e.g. the first part, was good. It rained."] * 30 + \
         ["The shop of J. Smith is open. She said etc. and left! \"Really?\" he asked. (No one knew.) The end."] * 30 + \
         ["On 3. May we left. In the morning it rained... and then it stopped. Dr. Brown came. the cat and the plan. we and he and she."] * 30 + \
         ["late or good or rained or open or left or asked or knew or end or stopped or came or plan or she or he or we or really went"] * 30


@pytest.fixture(scope="module")
def model(spark):
    return bd.train(spark.createDataFrame([(t,) for t in CORPUS], "text string"))


def split(spark, model, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, boundaries string").drop("boundaries")
    rows = {r.doc_id: r.sentences for r in bd.with_sentences(df, model).collect()}
    counts = {r.doc_id: r.num_sent for r in bd.sentence_counts(df, model).collect()}
    assert counts == {i: len(s) for i, s in rows.items()}
    return [rows[i] for i in range(len(texts))]


def test_abbreviations_are_learned(model):
    short = {r.word for r in model.types.where("abbreviation").collect()}
    assert {"dr", "e.g", "etc"} <= short and not short & {"late", "good", "rained", "open", "the"}


def test_sentences(spark, model):
    got = split(spark, model, [
        "We met Dr. Brown. He was late.", "It was good, e.g. the plan. The cat left.", "J. Smith left. She came.", "Really? Yes! No.",
        "(He was late.) \"The plan.\" It rained... and then it stopped.\n\nHe left", None, "", " \n ", "no mark at all", "One.Two. Three."])
    assert got[0] == ["We met Dr. Brown.", "He was late."]
    assert got[1] == ["It was good, e.g. the plan.", "The cat left."]
    assert got[2] == ["J. Smith left.", "She came."]
    assert got[3] == ["Really?", "Yes!", "No."]
    assert got[4] == ["(He was late.)", "\"The plan.\"", "It rained... and then it stopped.", "He left"]
    assert got[5:] == [[], [], [], ["no mark at all"], ["One.Two.", "Three."]]


def test_empty_corpus(spark):
    none = bd.train(spark.createDataFrame([(None,), ("",)], "text string"))
    assert none.types.count() == none.collocations.count() == 0
    assert split(spark, none, ["Dr. Brown came. He left."]) == [["Dr.", "Brown came.", "He left."]]


def test_counts_feed_the_miner(spark, model):
    pairs = spark.createDataFrame([(1, "Dr. Brown came.", "Dr. Brown came. He left.", 1), (2, "Dr. Brown came.", "He left.", 1)], "id long, q1 string, q2 string, is_duplicate int")
    for side in (1, 2):
        texts = pairs.select(F.col("id"), F.col(f"q{side}").alias("text"))
        pairs = pairs.join(bd.sentence_counts(texts, model, "id", name=f"num_sent_{side}"), "id")
    assert [(r.id, r.source, r.target) for r in au.mine(pairs).collect()] == [(1, "Dr. Brown came. He left.", "Dr. Brown came.")]


@pytest.mark.parametrize("name", ["sentence_types", "sentence_collocations", "sentence_boundaries"])
def test_against_sql(spark, name):
    catalog.load_all()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLE[name]})").fetchall()
    norm = lambda rows: sorted(repr([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)
    assert norm(map(tuple, df.select(*cols).collect())) == norm(want)


def test_rouge_lsum_over_learned_sentences(spark):
    """The whole query against the same metric over sentences cut in plain Python."""
    from tessera.functions.lcs import summary_lcs_udf
    from tessera.plans import derived

    catalog.load_all()
    got = {r.sample_id: (r.rlsum_p, r.rlsum_r, r.rlsum_f) for r in catalog.QUERIES["rouge_lsum_trained"](spark, SF).collect()}
    gold = derived.doc_gold(spark, SF)
    texts = gold.select(F.col("sample_id").alias("doc_id"), F.col("source").alias("text"))
    model = bd.train(derived.documents(spark, SF))
    cut = {r.doc_id: r.sentences for r in bd.with_sentences(texts, model).collect()}
    ref = {r.doc_id: r.sentences for r in bd.with_sentences(gold.select(F.col("sample_id").alias("doc_id"), F.col("gold").alias("text")), model).collect()}
    import re

    def tokens(sentences):
        return [t for s in sentences if (t := [w for w in re.split("[^a-z0-9]+", s.lower()) if w])]

    def union_lcs(ref_sents, pred_sents):
        from collections import Counter

        left_r, left_p, hits = Counter(w for s in ref_sents for w in s), Counter(w for s in pred_sents for w in s), 0
        for r in ref_sents:
            picked = set()
            for p in pred_sents:
                table = [[0] * (len(p) + 1) for _ in range(len(r) + 1)]
                for i, x in enumerate(r):
                    for j, y in enumerate(p):
                        table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
                i, j = len(r), len(p)
                while i and j:
                    if r[i - 1] == p[j - 1]:
                        picked.add(i - 1)
                        i, j = i - 1, j - 1
                    elif table[i][j - 1] > table[i - 1][j]:
                        j -= 1
                    else:
                        i -= 1
            for k in sorted(picked):
                if left_r[r[k]] > 0 and left_p[r[k]] > 0:
                    left_r[r[k]] -= 1
                    left_p[r[k]] -= 1
                    hits += 1
        return hits

    some = sorted(cut, key=lambda k: sum(map(len, cut[k])))[:60]
    for k in some:
        p, r = tokens(cut[k]), tokens(ref[k])
        m, n_p, n_r = union_lcs(r, p), sum(map(len, p)), sum(map(len, r))
        prec, rec = m / n_p if n_p else 0.0, m / n_r if n_r else 0.0
        f = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        assert got[k] == pytest.approx((prec, rec, f), abs=1e-5), k
    assert len(got) == len(cut) and summary_lcs_udf


def test_tokens_are_taken_apart_once_each(spark):
    """Tokens are counted as they stand before any expression looks at them."""
    df = spark.createDataFrame([(1, "Dr. No said no. (Yes!) \x0b no…\tA. 3.5 x"), (2, None), (3, " \n"), (4, "no")], "doc_id long, text string")
    plan = bd.neighbours(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "(^|[^.])" not in plan[plan.index("Contains("):]  # below the first count
    rows = df.select(F.transform(bd.pieces(F.col("text")), bd.token).alias("t")).collect()
    want = {}
    for r in rows:
        for k, t in enumerate(r.t):
            p = r.t[k - 1] if k else None
            key = (p.word if p and p.kind == "dot" else None, p and p.kind, t.word, t.dot, t.case)
            want[key] = want.get(key, 0) + 1
    assert {tuple(r)[:5]: r.n for r in bd.neighbours(df).collect()} == want


def test_places_are_taken_apart_once(spark):
    """A token of a place, or of a counted pair, stands once in the plan, below
    a generator: not again in each column and filter that uses it."""
    df = spark.createDataFrame([(1, "Dr. No said no. (Yes!)")], "doc_id long, text string")
    model = bd.train(df)
    for frame, also in ((bd.boundaries(df, model), 1), (bd.neighbours(df), 0)):  # boundaries asks for a number before once more
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("THEN " + bd.NUMBER) == 2 and plan.count(bd.NUMBER) <= 2 + 2 * also
    assert bd.with_sentences(df, model)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


@pytest.mark.parametrize("piece, want", [
    ("Dr. ", ("dr", "dot", True, "upper")), ("(\"Yes!\")\n", ("yes", "final", False, "upper")), ("e.g.,", ("e.g", "mid", True, "lower")), ("wait...", ("wait", "ellipsis", False, "lower")),
    ("3.5.", (bd.NUMBER, "dot", True, "other")), ("-1,000", (bd.NUMBER, "mid", False, "other")), (".", ("", "dot", True, "other")), ("…”", ("", "ellipsis", False, "other")), ("plain \t", ("plain", "mid", False, "lower")),
    ("“‘Éa?’”;", ("éa", "mid", False, "upper")), ("", ("", "mid", False, "other")), (None, (None, "mid", None, "other"))])
def test_token(spark, piece, want):
    assert tuple(spark.createDataFrame([(piece,)], "p string").select(F.inline(F.array(bd.token(F.col("p"))))).first()) == want
