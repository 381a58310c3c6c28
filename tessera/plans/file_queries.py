"""Tables written as the formats of paired-text work and read again.

Every query writes its whole table to a folder of its own in the shared
checkpoint folder, reads it by the library's readers, and removes the folder
once the result is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import batching as bt
from tessera.operators import evaluation as ev
from tessera.operators import metrics as mt
from tessera.operators import profile, splits
from tessera.operators.cluster import cluster_sections
from tessera.operators.ordering import global_index
from tessera.plans import cluster_queries, derived, eval_queries, metric_queries  # noqa: F401
from tessera.plans import sqltext as sq
from tessera.plans.catalog import ORACLE, register
from tessera.session import Rounds
from tessera.sources import sinks, tabular, text
from tessera.sources.tables import table

_PAIRS = f"""cp AS (SELECT conv_id, turn, {sq.clean('source')} AS source, {sq.clean('target')} AS target FROM pairs_conv),
np AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS pair_id, conv_id, source, target FROM cp WHERE source <> '' AND target <> '')"""
_NUMBERED = sq.with_(sq.PAIRS_CONV, _PAIRS)


def _pairs(spark, sf):
    """(pair_id, conv_id, source, target): cleaned pairs with text on both sides."""
    p = derived.pairs_conv(spark, sf).select("conv_id", "turn", tx.clean_text("source").alias("source"), tx.clean_text("target").alias("target"))
    p = p.where((F.col("source") != "") & (F.col("target") != ""))
    return global_index(p, ["conv_id", "turn"], "pair_id").drop("turn")


@register("file_parallel_text", "S1 S2 J1 K1 F6", _NUMBERED + "SELECT pair_id, source, target FROM np")
def file_parallel_text(spark, sf):
    """Pairs as two aligned text files, joined again by line."""
    files = Rounds(spark)
    sinks.write_pairs_text(_pairs(spark, sf), files.folder, "train")
    return files.close(text.parallel_pairs(spark, f"{files.folder}/train.source", f"{files.folder}/train.target"))


@register("file_labelled_pairs", "S5 S7 K2 P11 U7", _NUMBERED + f"""
SELECT pair_id AS guid, lower(source) AS source, lower(target) AS candidate, CAST(len({sq.ws_tokens('target')}) AS DOUBLE) AS label FROM np""")
def file_labelled_pairs(spark, sf):
    """Labelled pairs without quoting, read lower-cased with four fields a line."""
    files = Rounds(spark)
    rows = _pairs(spark, sf).select(F.col("pair_id").alias("guid"), "source", F.col("target").alias("candidate"), tx.word_count("target").cast("double").alias("label"))
    sinks.write_tsv(rows, f"{files.folder}/pairs", reject_tabs=["source", "candidate"])
    return files.close(tabular.read_labelled_pairs(spark, f"{files.folder}/pairs", lower_case=True))


@register("file_candidate_list", "S6 K6 F9", sq.with_(sq.DOC_LINES, sq.DOC_CANDS) + f"""
SELECT sample_id, cand_rank, {sq.strip("split_part(text, chr(9), 1)")} AS text FROM doc_cands""")
def file_candidate_list(spark, sf):
    """Candidates as ``id <tab> text`` lines, ranked again by their order."""
    files = Rounds(spark)
    lines = derived.doc_candidates(spark, sf).select("sample_id", "cand_rank", F.concat_ws("\t", F.col("sample_id").cast("string"), "text").alias("line"))
    sinks.write_ordered_text(lines, f"{files.folder}/c.all", ["sample_id", "cand_rank"], "line")
    return files.close(text.candidate_list(spark, f"{files.folder}/c.all"))


@register("file_ingest", "C1 S3 S4 P4 P1 P2 P3", f"""
WITH w AS (SELECT doc_id, {sq.clean('text')} AS text_clean FROM documents),
f AS (SELECT *, {sq.first_word('text_clean')} AS question_word FROM w),
c AS (SELECT question_word, count(*) AS n FROM f GROUP BY question_word)
SELECT f.doc_id, text_clean, CASE WHEN c.n <= 10 THEN '<rare>' ELSE f.question_word END AS question_word_norm
FROM f LEFT JOIN c ON c.question_word = f.question_word""")
def file_ingest(spark, sf):
    """A quoted table with cells over many lines, read, renamed, cleaned, and
    its first words collapsed, as one job."""
    files = Rounds(spark)
    docs = derived.documents(spark, sf).select(F.col("doc_id").alias("q id"), F.col("text").alias("NLM Question"))
    sinks.write_quoted_tsv(docs, f"{files.folder}/docs")
    rows = tabular.read_tsv(spark, f"{files.folder}/docs", rename={"q id": "doc_id", "NLM Question": "text"})
    rows = files.cut(rows.select(F.col("doc_id").cast("long").alias("doc_id"), tx.clean_text("text").alias("text_clean")))
    words = rows.withColumn("question_word", tx.first_word("text_clean"))
    return files.close(profile.collapse_rare(words, "question_word", threshold=10, out="question_word_norm").select("doc_id", "text_clean", "question_word_norm"))


@register("file_results", "S8 K3 A4 C11", ORACLE["aggregate_runs"])
def file_results(spark, sf):
    """Each fold's scores as a file of ``metric: value`` lines, rolled up, and
    the roll-up as a table with a header."""
    files = Rounds(spark)
    scores = files.cut(eval_queries.fold_scores(spark, sf))
    for k in range(5):  # the folds
        line = F.concat_ws(": ", "metric", F.col("value").cast("string"))
        sinks.write_ordered_text(scores.where(F.col("fold") == k).select("metric", line.alias("line")), f"{files.folder}/runs/result_{k}", "metric", "line")
    merged = ev.aggregate_runs(text.result_files(spark, f"{files.folder}/runs"))
    sinks.write_tsv(merged, f"{files.folder}/merged", header=True)
    back = tabular.read_tsv(spark, f"{files.folder}/merged", quoted=False)
    return files.close(back.select("metric", *[F.col(c).cast("double").alias(c) for c in ("mean", "std", "min", "max")], F.col("n").cast("long").alias("n")))


@register("file_shards", "S9 S10 C14 T1 X1 W11 K5", ORACLE["corpus_rouge"])
def file_shards(spark, sf):
    """The gathering job: predictions dealt over four ranks, each rank's as
    JSON; gathered, put beside their gold texts in order, scored, and the
    scores as JSON."""
    files = Rounds(spark)
    cands = derived.doc_candidates(spark, sf)
    lists = cands.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_rank", "text"))), lambda c: c["text"]).alias("pred"))
    ranked = bt.round_robin_shards(lists.withColumnRenamed("sample_id", "id"), "id", 4, pad=True)
    sinks.write_shards(ranked.select("id", "pred", "shard"), f"{files.folder}/ranks", "shard")
    rows = tabular.gather_shards(spark, f"{files.folder}/ranks", expected=4, written=True)
    gold = derived.doc_gold(spark, sf).select(F.col("sample_id").alias("id"), "gold")
    scores = mt.corpus_rouge(rows.join(gold, "id"), pred="pred", ref="gold", stem=False)
    sinks.write_metrics_json(scores, f"{files.folder}/test_results.json")
    return files.close(tabular.read_json_records(spark, f"{files.folder}/test_results.json", multiline=False).select("metric", "value"))


_FIRST = sq.with_(sq.DOC_LINES, sq.DOC_CANDS.replace("WHERE c.line_no >= 1", "WHERE c.line_no = 1"))


@register("file_scores", "B9 S1 J1 K1 K5", _FIRST.rstrip() + ", " + sq.rouge_n_ctes("doc_cands", ["sample_id", "cand_rank"], "text", "gold", 1, "r1") + ", "
          + sq.rouge_n_ctes("doc_cands", ["sample_id", "cand_rank"], "text", "gold", 2, "r2") + f""",
l AS (SELECT len(pt) AS np, len(rt) AS nr, {sq.lcs_len('pt', 'rt')} AS m FROM (SELECT {sq.alnum_tokens('text')} AS pt, {sq.alnum_tokens('gold')} AS rt FROM doc_cands))
SELECT 'rouge1' AS metric, round(avg({sq.f1('m', 'np', 'nr')}) * 100, 4) AS value FROM r1
UNION ALL SELECT 'rouge2', round(avg({sq.f1('m', 'np', 'nr')}) * 100, 4) FROM r2 UNION ALL SELECT 'rougeL', round(avg({sq.f1('m', 'np', 'nr')}) * 100, 4) FROM l""")
def file_scores(spark, sf):
    """A file of predictions (each document's first candidate) scored against
    a file of gold texts, line by line, and the scores as JSON."""
    files = Rounds(spark)
    first = derived.doc_candidates(spark, sf).where(F.col("cand_rank") == 0).select(F.col("sample_id").alias("pair_id"), F.col("text").alias("source"), F.col("gold").alias("target"))
    sinks.write_pairs_text(first, files.folder, "run")
    pairs = text.parallel_pairs(spark, f"{files.folder}/run.source", f"{files.folder}/run.target")
    sinks.write_metrics_json(mt.corpus_rouge(pairs, pred="source", ref="target", stem=False), f"{files.folder}/scores.json")
    return files.close(tabular.read_json_records(spark, f"{files.folder}/scores.json", multiline=False).select("metric", "value"))


@register("file_translations", "S11 S10", _NUMBERED + "SELECT source, target FROM np")
def file_translations(spark, sf):
    """Translation records, of which one pair of languages is taken."""
    files = Rounds(spark)
    rows = _pairs(spark, sf).select(F.struct(F.col("source").alias("en"), F.col("target").alias("ro")).alias("translation"))
    rows.write.json(f"{files.folder}/r.json")
    return files.close(tabular.project_translation(tabular.read_json_records(spark, f"{files.folder}/r.json", multiline=False), "en", "ro"))


@register("file_folds", "S13 K1 K9 X4", _NUMBERED + f""",
fo AS (SELECT *, {sq.seeded_hash('conv_id', 7)} % 3 AS f FROM np),
sp AS (SELECT k AS fold, CASE WHEN f = k THEN 'val' ELSE 'train' END AS split, pair_id, source, target FROM fo, range(3) r(k))
SELECT fold, split, row_number() OVER (PARTITION BY fold, split ORDER BY pair_id) - 1 AS pair_id, source, target FROM sp""")
def file_folds(spark, sf):
    """Three folds of a train and a val part, each as two aligned files; the
    val part is carried through as it is."""
    files = Rounds(spark)
    rows = files.cut(_pairs(spark, sf).withColumn("f", splits.seeded_hash("conv_id", 7) % 3))
    for k in range(3):
        train, val = splits.fold_view(rows, k, "f")
        both = sinks.carry_split(train.withColumn("split", F.lit("train")), val.withColumn("split", F.lit("val")))
        for split in ("train", "val"):
            sinks.write_pairs_text(both.where(F.col("split") == split), f"{files.folder}/fold_{k}", split)
    return files.close(text.read_folds(spark, files.folder))


@register("file_length_table", "C19 P14 S14 W8", _NUMBERED + f""",
sp AS (SELECT *, CASE {sq.seeded_hash('pair_id', 9)} % 10 WHEN 9 THEN 'test' WHEN 8 THEN 'val' ELSE 'train' END AS split FROM np),
le AS (SELECT split, pair_id, CASE WHEN split = 'test' THEN length(source) + 1
         ELSE least(greatest(len({sq.ws_tokens('source')}), len({sq.ws_tokens('target')})), 60) END AS length FROM sp)
SELECT split, pair_id, CAST(length AS BIGINT) AS length, (row_number() OVER (ORDER BY length DESC, pair_id) - 1) // 16 AS batch_id FROM le""")
def file_length_table(spark, sf):
    """The job that saves token lengths of the train and val parts; batches of
    all pairs by them, and by characters where there is none."""
    files = Rounds(spark)
    part = splits.seeded_hash("pair_id", 9) % 10
    rows = files.cut(_pairs(spark, sf).withColumn("split", F.when(part == 9, "test").when(part == 8, "val").otherwise("train")))
    lengths = bt.length_table(rows.where(F.col("split") != "test"), cap=60).select("split", "pair_id", "length")
    lengths.write.partitionBy("split").parquet(f"{files.folder}/lengths")
    table_ = spark.read.parquet(f"{files.folder}/lengths")
    known = bt.with_lengths(rows.select("split", "pair_id", "source"), table_, "pair_id", "source")
    return files.close(bt.length_batches(known.select("split", "pair_id", "length"), "pair_id", "length", 16))


@register("file_sections", "K7 A18 C15", cluster_queries._CC_SQL.replace("SELECT v AS vec_id, min(lab) AS cluster FROM r GROUP BY v", """, cl AS (SELECT v, min(lab) AS c FROM r GROUP BY v),
nu AS (SELECT c, row_number() OVER (ORDER BY c) AS no FROM (SELECT DISTINCT c FROM cl)),
li AS (SELECT no, 0 AS kind, CAST(NULL AS BIGINT) AS v, 'Cluster ' || no AS line FROM nu UNION ALL SELECT no, 1, v, 'vector ' || v FROM cl JOIN nu USING (c)
       UNION ALL SELECT no, 2, NULL, '' FROM nu)
SELECT row_number() OVER (ORDER BY no, kind, v) - 1 AS pos, line FROM li"""))
def file_sections(spark, sf):
    """The clusters of vectors as sections of a text file, by line."""
    files = Rounds(spark)
    comp = files.cut(cluster_queries.cluster_components(spark, sf))
    names = comp.select("vec_id", F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"))
    sinks.write_sections(cluster_sections(comp, names, "vec_id"), f"{files.folder}/clusters.txt", "vec_id")
    lines = text.numbered_lines(spark, f"{files.folder}/clusters.txt")
    return files.close(global_index(lines, ["file", "line_no"], "pos").select("pos", F.col("text").alias("line")))


@register("file_lines_at", "J10 K6", sq.with_(sq.DOC_LINES) + """,
l AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line_no, line FROM doc_lines)
SELECT line_no, line AS text FROM l WHERE line_no IN (SELECT doc_id FROM labels)""")
def file_lines_at(spark, sf):
    """Lines of all documents' text by number: those that ``labels`` names."""
    files = Rounds(spark)
    sinks.write_ordered_text(derived.doc_lines(spark, sf), f"{files.folder}/lines", ["doc_id", "line_no"], "line")
    index = files.cut(text.line_index(spark, f"{files.folder}/lines"))
    wanted = table(spark, sf, "labels", ["doc_id"]).select(F.col("doc_id").alias("line_no")).distinct()
    return files.close(text.lines_at(spark, index, wanted).select("line_no", "text"))
