import re

import corpus_pipeline
from test_quality import slow_base
from test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_plain_python(spark, tmpdir_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language ID", "SimHash near-dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34 " * 30, "en", "s", 180), (9003, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    columns, kept = docs.columns, [by_id(docs)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmpdir_path}/{k}")
        docs = spark.read.parquet(f"{tmpdir_path}/{k}")
        assert k == 3 or docs.columns == columns
        kept.append(by_id(docs))
    for before, after in zip(kept[:3], kept[1:4]):
        assert all(before[i] == r for i, r in after.items())
    for i, r in kept[0].items():
        n_words, _, _, _, repeated = slow_base(r.text)
        if n_words < 20 or 100 * repeated > 30 * n_words:
            assert i not in kept[1]
    assert 9002 not in kept[2] and 9001 not in kept[1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q and slow_base(kept[0][i].text)[0] >= 20]
    assert sum(i in kept[2] for i in good) >= 0.97 * len(good)
    ids = sorted(kept[2])
    low = dict(zip(ids, slow_components(ids, [slow_fingerprint(kept[2][i].text) for i in ids], 2)))
    assert sorted(kept[3]) == [i for i in ids if low[i] == i]
    assert sorted(kept[4]) == sorted(kept[3])
    assert all(r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", kept[3][i].text)) for i, r in kept[4].items())


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 50 and set(rows.columns) >= {"doc_id", "bucket", "batch_id", "batch_slot"}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_stages_keep_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for c in ("_row", "_code", "_whole", "_doc", "_key", "_text", "n_words", "lang_pred", "score", "a.b", "p_good"):
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    rows = docs.collect()
    assert len(rows) > 50 and all(r["_row"] == f"_row {r.doc_id}" and r["a.b"] == f"a.b {r.doc_id}" and r["score"] == f"score {r.doc_id}" for r in rows)
