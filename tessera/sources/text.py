"""Line-numbered text, parallel pairs, candidate lists, result files
(S1 S2 S6 S8 S13 S14 J1 J10).

Line numbers never rely on partition order: each input split reports its
row count and first ``monotonically_increasing_id``; a split's base is the
row total of the earlier splits of the same file (one row per split), and
line = id - first id + base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.ordering import rank_within


def numbered_lines(spark: SparkSession, path: str | list[str], name: str = "line_no") -> DataFrame:
    """(file, line_no, text) with a 0-based line number per file."""
    raw = spark.read.text(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_blk"), F.monotonically_increasing_id().alias("_m"))
    splits = raw.groupBy("file", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    w = Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (raw.join(splits.select("file", "_blk", "_m0", "_base"), ["file", "_blk"])
               .select("file", (F.col("_m") - F.col("_m0") + F.col("_base")).cast("long").alias(name), "text"))


def _file_key():
    """What the two sides of a parallel text share in a file's name: the part
    number of a written folder, else the name without its last suffix."""
    name = F.regexp_extract(F.col("file"), "([^/]*)$", 1)
    part = F.regexp_extract(name, r"^part-(\d+)", 1)
    return F.when(part != "", part).otherwise(F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1))


def parallel_pairs(spark: SparkSession, source_path: str, target_path: str, prefix: str = "",
                   validate: bool = True) -> DataFrame:
    """Row i of the source file with row i of the target file (truncates to
    the shorter side); of folders, row i of part k with row i of part k.
    ``pair_id`` counts on from part to part.  ``validate`` fails the job on
    an empty line."""
    s = numbered_lines(spark, source_path, "_line").select(
        _file_key().alias("_part"), "_line", F.concat(F.lit(prefix or ""), F.col("text")).alias("source"))
    t = numbered_lines(spark, target_path, "_line").select(_file_key().alias("_part"), "_line", F.col("text").alias("target"))
    single = not any("*" in p or _is_folder(spark, p) for p in (source_path, target_path))
    if single:  # the names of two single files need not agree
        s, t = s.withColumn("_part", F.lit("")), t.withColumn("_part", F.lit(""))
    sizes = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_a")).join(t.groupBy("_part").agg(F.count(F.lit(1)).alias("_b")), "_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = sizes.select("_part", F.coalesce(F.sum(F.least("_a", "_b")).over(before), F.lit(0)).alias("_base"))
    pairs = s.join(t, ["_part", "_line"]).join(F.broadcast(bases), "_part").select(
        (F.col("_base") + F.col("_line")).cast("long").alias("pair_id"), "source", "target")
    if validate:
        ok = F.when((F.length("source") == 0) | (F.length("target") == 0),
                    F.raise_error(F.concat(F.lit("empty line at pair "), F.col("pair_id").cast("string")))
                    ).otherwise(F.lit(True))
        pairs = pairs.where(ok)
    return pairs


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def candidate_list(spark: SparkSession, path: str) -> DataFrame:
    """``sample_id \\t text`` lines -> (sample_id, cand_rank, text); rank is
    the order of appearance in the file within the sample; fields after the
    second tab are ignored.  A line without a tab fails the job."""
    lines = numbered_lines(spark, path, "_ln")
    parts = F.split(F.col("text"), "\t")
    ok = F.when(F.size(parts) < 2, F.raise_error(F.concat(F.lit("no tab in candidate line: "), F.col("text")))).otherwise(F.lit(True))
    rows = lines.where(ok).select("file", "_ln", F.trim(parts[0]).cast("long").alias("sample_id"), tx.strip(F.get(parts, 1)).alias("text"))
    ranked = rank_within(rows, ["sample_id"], ["file", "_ln"], "cand_rank")
    return ranked.select("sample_id", "cand_rank", "text")


def result_files(spark: SparkSession, directory: str) -> DataFrame:
    """``metric: value`` lines of every ``result_*`` file -> (run, metric, value)."""
    raw = spark.read.text(f"{directory.rstrip('/')}/result_*").select(
        F.col("value"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("run"))
    parts = F.split(F.col("value"), ":")
    ok = F.when(F.size(parts) != 2, F.raise_error(F.concat(F.lit("bad result line: "), F.col("value")))) \
          .otherwise(F.lit(True))
    return raw.where(F.trim("value") != "").where(ok).select(
        "run", F.trim(parts[0]).alias("metric"), F.trim(parts[1]).cast("double").alias("value"))


def path_field(pattern: str, name: str):
    """Column extracted from the input path (e.g. fold number, split name)."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias(name)


def read_folds(spark: SparkSession, directory: str) -> DataFrame:
    """``fold_{k}/{split}.{source,target}`` files, or folders of part files ->
    (fold, split, pair_id, source, target); ``pair_id`` is the line of the
    pair, counted on from part to part."""
    def side(name: str) -> DataFrame:
        lines = numbered_lines(spark, f"{directory.rstrip('/')}/fold_*/*.{name}", "_line")
        parts = rf"fold_(\d+)/([^/]+)\.{name}(?:/part-(\d+)[^/]*)?$"
        return lines.select(F.regexp_extract("file", parts, 1).cast("long").alias("fold"), F.regexp_extract("file", parts, 2).alias("split"),
                            F.regexp_extract("file", parts, 3).alias("_part"), "_line", F.col("text").alias(name))

    source = side("source")
    sizes = source.groupBy("fold", "split", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("fold", "split").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = sizes.select("fold", "split", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    pairs = source.join(side("target"), ["fold", "split", "_part", "_line"]).join(F.broadcast(bases), ["fold", "split", "_part"])
    return pairs.select("fold", "split", (F.col("_base") + F.col("_line")).alias("pair_id"), "source", "target")


def line_index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar of a folder of text: (file, first, n), the line numbers of
    each file when files are read in the order of their names.  One row per
    file; write it beside the data to read lines later."""
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n")


def lines_at(spark: SparkSession, index: DataFrame, wanted: DataFrame, number: str = "line_no") -> DataFrame:
    """``wanted`` with the ``text`` of its line numbers: only the files that
    hold some are opened.  The driver sees the index and how many lines of
    each file are wanted; numbers beyond the last line have no row."""
    files = sorted((r["first"], r["n"], r["file"]) for r in index.collect())  # one row per file
    spans = F.broadcast(spark.createDataFrame([(f, a, a + n) for a, n, f in files], "file string, _from long, _to long"))
    rows = wanted.join(spans, (F.col(number) >= F.col("_from")) & (F.col(number) < F.col("_to")))
    needed = [r["file"] for r in rows.select("file").distinct().collect()]  # of the index' files
    if not needed:
        return wanted.where(F.lit(False)).withColumn("text", F.lit(None).cast("string"))
    text = numbered_lines(spark, needed, "_at")
    return rows.withColumn("_at", F.col(number) - F.col("_from")).join(text, ["file", "_at"]).drop("file", "_at", "_from", "_to")
