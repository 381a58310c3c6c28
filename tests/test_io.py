import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import sinks, tabular, text
from tessera.sources.sinks import write_pairs_text, write_tsv


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_numbered_lines_multiple_splits(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "in")
    os.makedirs(d)
    for k in range(3):
        _write(os.path.join(d, f"f{k}.txt"), [f"{k}-{i}" for i in range(4000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = text.numbered_lines(spark, d).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 12000
    for r in rows:
        assert r.text.split("-")[1] == str(r.line_no)


def test_parallel_pairs_and_candidate_list(spark, tmpdir_path):
    s, t = os.path.join(tmpdir_path, "a.source"), os.path.join(tmpdir_path, "a.target")
    _write(s, ["src one", "src two", "src three"])
    _write(t, ["tgt one", "tgt two"])
    pairs = text.parallel_pairs(spark, s, t).orderBy("pair_id").collect()
    assert [(r.pair_id, r.target) for r in pairs] == [(0, "tgt one"), (1, "tgt two")]
    c = os.path.join(tmpdir_path, "c.all")
    _write(c, ["0\tfirst\textra", "1\t b ", "0\tsecond"])
    got = sorted((r.sample_id, r.cand_rank, r.text) for r in text.candidate_list(spark, c).collect())
    assert got == [(0, 0, "first"), (0, 1, "second"), (1, 0, "b")]


def test_result_files(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "result_0.txt"), ["rouge1: 40.5", "rouge2 : 20"])
    _write(os.path.join(tmpdir_path, "result_1.txt"), ["rouge1: 42.5", "rouge2: 22"])
    _write(os.path.join(tmpdir_path, "other.txt"), ["x: 1"])
    from tessera.operators.evaluation import aggregate_runs
    agg = {r.metric: r for r in aggregate_runs(text.result_files(spark, tmpdir_path)).collect()}
    assert agg["rouge1"].mean == 41.5 and agg["rouge1"].std == 1.0 and agg["rouge2"].n == 2


def test_quoted_tsv_and_labelled(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "q.tsv")
    with open(p, "w") as f:
        f.write('q_id\tNLM Question\tSummary\n1\t"line one\nline ""two"""\tS1\n2\tplain\tS2\n')
    df = tabular.read_tsv(spark, p, rename={"NLM Question": "source", "Summary": "target"})
    rows = df.orderBy("q_id").collect()
    assert rows[0].source == 'line one\nline "two"' and rows[1].target == "S2"
    lp = os.path.join(tmpdir_path, "l.tsv")
    _write(lp, ['1\tA "q\tCand\t0.5'])
    r = tabular.read_labelled_pairs(spark, lp, lower_case=True).first()
    assert (r.guid, r.source, r.candidate, r.label) == (1, 'a "q', "cand", 0.5)


def test_shards_json_and_eval_json(spark, tmpdir_path):
    for k in range(2):
        with open(os.path.join(tmpdir_path, f"rank_{k}_output.json"), "w") as f:
            json.dump([{"id": k, "pred": f"p{k}"}, {"id": k + 2, "pred": f"p{k + 2}"}], f)
    df = tabular.gather_shards(spark, tmpdir_path, expected=2)
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3]
    ev = spark.createDataFrame([({"src": ["a", "b"], "tgt": ["x", "y"]},)], "en_ru struct<src:array<string>,tgt:array<string>>")
    flat = tabular.flatten_eval_json(ev).orderBy("idx").collect()
    assert [(r.pair, r.idx, r.src, r.tgt) for r in flat] == [("en_ru", 0, "a", "x"), ("en_ru", 1, "b", "y")]


def test_write_pairs_text_alignment(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"s{i}", f"t{i}") for i in range(500)], "pair_id long, source string, target string")
    write_pairs_text(df, tmpdir_path, "train", parts=4)
    s = spark.read.text(os.path.join(tmpdir_path, "train.source")).collect()
    t = spark.read.text(os.path.join(tmpdir_path, "train.target")).collect()
    assert len(s) == len(t) == 500
    import pytest
    bad = spark.createDataFrame([(1, "a\tb")], "guid long, candidate string")
    with pytest.raises(Exception):
        write_tsv(bad, os.path.join(tmpdir_path, "bad"), reject_tabs=["candidate"])


def test_pairs_round_trip_by_content(spark, tmpdir_path):
    rows = [(i, f"s{i} \u00e9", f"t{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "pair_id long, source string, target string").repartition(7)
    write_pairs_text(df, tmpdir_path, "train", parts=4)
    back = text.parallel_pairs(spark, f"{tmpdir_path}/train.source", f"{tmpdir_path}/train.target")
    assert sorted((r.pair_id, r.source, r.target) for r in back.collect()) == rows


def test_an_empty_line_is_reported(spark, tmpdir_path):
    s, t = os.path.join(tmpdir_path, "a.source"), os.path.join(tmpdir_path, "b.target")
    _write(s, ["x", ""])
    _write(t, ["y", "z"])
    with pytest.raises(Exception, match="empty line at pair 1"):
        text.parallel_pairs(spark, s, t).collect()
    assert text.parallel_pairs(spark, s, t, validate=False).count() == 2


def test_long_candidate_list_and_a_line_without_tab(spark, tmpdir_path):
    c = os.path.join(tmpdir_path, "c.all")
    _write(c, [f"{i % 7919}\t\u2003line {i}\u2003" for i in range(60_000)])
    got = text.candidate_list(spark, c).collect()
    assert len(got) == 60_000
    seen = {}
    for i in range(60_000):
        seen[i] = (i % 7919, i // 7919)
    assert {(r.sample_id, r.cand_rank): r.text for r in got} == {seen[i]: f"line {i}" for i in range(60_000)}
    _write(c, ["1\ta", "no tab"])
    with pytest.raises(Exception, match="no tab in candidate line"):
        text.candidate_list(spark, c).collect()


def test_shards_of_lists_and_strings(spark, tmpdir_path):
    for k, rows in enumerate([[{"id": 0, "pred": ["a", "b"]}, {"id": 1, "pred": ["c"]}], [{"id": 1, "pred": ["c"]}, {"id": 2, "pred": []}]]):
        with open(os.path.join(tmpdir_path, f"rank_{k}_output.json"), "w") as f:
            json.dump(rows, f)
    got = sorted((r.id, r.cand_rank, r.pred) for r in tabular.gather_shards(spark, tmpdir_path, 2).collect())
    assert got == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    with pytest.raises(RuntimeError):
        tabular.gather_shards(spark, tmpdir_path, 3)
    other = os.path.join(tmpdir_path, "o")
    os.makedirs(other)
    with open(os.path.join(other, "rank_0_output.json"), "w") as f:
        json.dump([{"id": 5, "pred": "x"}], f)
    assert [tuple(r) for r in tabular.gather_shards(spark, other).collect()] == [(5, 0, "x")]


def test_records_translations_and_eval_json(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "r.json")
    with open(p, "w") as f:
        json.dump([{"translation": {"en": "a", "ro": "b"}}], f)
    got = tabular.project_translation(tabular.read_json_records(spark, p), "en", "ro").collect()
    assert [tuple(r) for r in got] == [("a", "b")]
    e = os.path.join(tmpdir_path, "e.json")
    with open(e, "w") as f:
        json.dump({"en-ru": {"src": ["a", "b"], "tgt": ["c", "d"]}, "ru-en": {"src": ["x"], "tgt": ["y"]}}, f)
    rows = tabular.flatten_eval_json(tabular.read_json_records(spark, e)).collect()
    assert sorted(tuple(r) for r in rows) == [("en-ru", 0, "a", "c"), ("en-ru", 1, "b", "d"), ("ru-en", 0, "x", "y")]


def test_folds_and_path_fields(spark, tmpdir_path):
    for k in (0, 1):
        for split in ("train", "val"):
            os.makedirs(os.path.join(tmpdir_path, f"fold_{k}"), exist_ok=True)
            for side in ("source", "target"):
                _write(os.path.join(tmpdir_path, f"fold_{k}", f"{split}.{side}"), [f"{side[0]}{k}{split}{i}" for i in range(3)])
    rows = text.read_folds(spark, tmpdir_path).collect()
    assert len(rows) == 12
    assert all(r.source == f"s{r.fold}{r.split}{r.pair_id}" and r.target == f"t{r.fold}{r.split}{r.pair_id}" for r in rows)
    df = spark.read.text(f"{tmpdir_path}/fold_*/val.source").select(text.path_field(r"fold_(\d+)", "fold"))
    assert sorted(r.fold for r in df.distinct().collect()) == ["0", "1"]


def test_metric_sinks(spark, tmpdir_path):
    m = spark.createDataFrame([("r", 1.5)], "b string, a double")
    sinks.append_metrics(m, f"{tmpdir_path}/m")
    sinks.append_metrics(m, f"{tmpdir_path}/m")
    assert spark.read.parquet(f"{tmpdir_path}/m").count() == 2
    sinks.write_metrics_json(m, f"{tmpdir_path}/j")
    sinks.write_metrics_json(m, f"{tmpdir_path}/j")
    assert [r.value for r in spark.read.text(f"{tmpdir_path}/j").collect()] == ['{"a":1.5,"b":"r"}']
    with pytest.raises(Exception, match="(?i)already exists"):
        write_tsv(m, f"{tmpdir_path}/j")
    u = sinks.carry_split(m, spark.createDataFrame([("s",)], "b string"))
    assert sorted(r.b for r in u.collect()) == ["r", "s"]


def test_tsv_round_trip(spark, tmpdir_path):
    rows = [(1, 'a "quoted" text', "b", 0.5), (2, "\u00e9", "c d", 1.0)]
    df = spark.createDataFrame(rows, "guid long, source string, candidate string, label double")
    write_tsv(df, f"{tmpdir_path}/t", reject_tabs=["source", "candidate"])
    assert sorted(tuple(r) for r in tabular.read_labelled_pairs(spark, f"{tmpdir_path}/t").collect()) == rows


def test_ordered_text_and_sections(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"line {i}") for i in range(500)], "k long, t string").repartition(5)
    sinks.write_ordered_text(df, f"{tmpdir_path}/o", "k", "t")
    files = sorted(f for f in os.listdir(f"{tmpdir_path}/o") if f.startswith("part"))
    lines = [x for f in files for x in open(os.path.join(tmpdir_path, "o", f)).read().splitlines()]
    assert lines == [f"line {i}" for i in range(500)]
    from tessera.operators.cluster import cluster_sections
    comp = spark.createDataFrame([(1, 1), (2, 1), (7, 7)], "doc_id long, cluster long")
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (7, "c")], "doc_id long, text string")
    sinks.write_sections(cluster_sections(comp, texts, "doc_id"), f"{tmpdir_path}/s", "doc_id")
    files = sorted(f for f in os.listdir(f"{tmpdir_path}/s") if f.startswith("part"))
    assert "".join(open(os.path.join(tmpdir_path, "s", f)).read() for f in files) == "Cluster 1\na\nb\n\nCluster 2\nc\n\n"


def test_quoted_tsv_round_trip(spark, tmpdir_path):
    rows = [(1, 'a\t"b"\nc', " x "), (2, '"', ""), (3, "plain", "\n\n")]
    df = spark.createDataFrame(rows, "id long, `long text` string, other string")
    sinks.write_quoted_tsv(df, f"{tmpdir_path}/q")
    back = tabular.read_tsv(spark, f"{tmpdir_path}/q", rename={"long text": "text"})
    assert back.columns == ["id", "text", "other"]
    assert sorted((int(r.id), r.text, r.other or "") for r in back.collect()) == rows


def test_lines_are_read_from_the_files_that_have_them(spark, tmpdir_path):
    df = spark.range(1000).select("id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("t"))
    df.repartitionByRange(5, "id").sortWithinPartitions("id").select("t").write.text(f"{tmpdir_path}/l")
    index = text.line_index(spark, f"{tmpdir_path}/l")
    assert index.count() > 1 and index.agg(F.sum("n")).first()[0] == 1000
    wanted = spark.createDataFrame([(3,), (0,), (7,), (2000,)], "line_no long")
    found = text.lines_at(spark, index, wanted)
    assert sorted(map(tuple, found.collect())) == [(0, "line 0"), (3, "line 3"), (7, "line 7")]
    assert len([f for f in found.inputFiles() if "/l/" in f]) == 1
    assert text.lines_at(spark, index, wanted.where("line_no > 1000")).count() == 0
    every = text.lines_at(spark, index, spark.range(1000).withColumnRenamed("id", "line_no"))
    assert all(r.text == f"line {r.line_no}" for r in every.collect()) and every.count() == 1000


def test_folds_of_written_folders(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"s{i}", f"t{i}") for i in range(90)], "pair_id long, source string, target string")
    for k in (0, 1):
        write_pairs_text(df.where(F.col("pair_id") % 2 == k), f"{tmpdir_path}/fold_{k}", "train", parts=3)
    rows = text.read_folds(spark, tmpdir_path).collect()
    assert sorted((r.fold, r.pair_id, r.source, r.target) for r in rows) == sorted((k, i, f"s{2 * i + k}", f"t{2 * i + k}") for k in (0, 1) for i in range(45))


def test_length_table(spark):
    from tessera.functions import hooks
    from tessera.operators import batching as bt

    df = spark.createDataFrame([(1, "a b c", "d"), (2, None, "x y"), (3, "p " * 90, "q")], "pair_id long, source string, target string")
    got = {r.pair_id: r.length for r in bt.length_table(df, cap=50).collect()}
    assert got == {1: 3, 2: 2, 3: 50}
    chars = bt.length_table(df, target=None, length=lambda c: hooks.length(lambda texts: [len(t) for t in texts], c))
    assert {r.pair_id: r.length for r in chars.collect()} == {1: 5, 2: 0, 3: 180}
    known = bt.with_lengths(df.select("pair_id", F.coalesce("source", F.lit("")).alias("source")), bt.length_table(df).where("pair_id < 3"), "pair_id", "source")
    assert {r.pair_id: r.length for r in known.collect()} == {1: 3, 2: 2, 3: 181}
