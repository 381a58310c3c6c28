"""Delimited and JSON readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED_PAIR = T.StructType([
    T.StructField("guid", T.LongType()), T.StructField("source", T.StringType()),
    T.StructField("candidate", T.StringType()), T.StructField("label", T.DoubleType())])


def read_tsv(spark: SparkSession, path: str, quoted: bool = True, header: bool = True,
             rename: dict[str, str] | None = None, schema: T.StructType | None = None,
             failfast: bool = False) -> DataFrame:
    """Tab-separated text.  ``quoted``: double quotes group cells, doubled
    quotes escape, cells may span lines.  Otherwise quotes are plain text."""
    r = spark.read.option("sep", "\t").option("header", header)
    if quoted:
        r = r.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quote", '"').option("escape", '"').option("multiLine", True)
    else:
        r = r.option("quote", "\u0000")
    if schema is not None:
        r = r.schema(schema)
    if failfast:
        r = r.option("mode", "FAILFAST")
    df = r.csv(path)
    return df.withColumnsRenamed(rename) if rename else df


def read_labelled_pairs(spark: SparkSession, path: str, lower_case: bool = False,
                        label_type: str = "double") -> DataFrame:
    """``guid \\t source \\t candidate \\t label`` without header; exactly four
    fields or the job fails."""
    df = read_tsv(spark, path, quoted=False, header=False, schema=LABELLED_PAIR, failfast=True)
    if lower_case:
        df = df.withColumn("source", F.lower("source")).withColumn("candidate", F.lower("candidate"))
    return df.withColumn("label", F.col("label").cast(label_type))


def read_json_records(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return spark.read.option("multiLine", multiline).json(path)


def gather_shards(spark: SparkSession, directory: str, expected: int | None = None, written: bool = False) -> DataFrame:
    """Per-rank JSON shards (a list of {id, pred} each, or with ``written`` the
    folders of ``sinks.write_shards``) -> (id, cand_rank, pred) rows; a list of predictions is one row each, best first.  An id
    that two ranks hold (padding of the last batch) is kept once.  With
    ``expected`` the number of shard files is checked (a commit-complete
    directory replaces polling)."""
    if written:
        df = spark.read.json(f"{directory.rstrip('/')}/rank=rank_*.json")
        df = df.withColumn("_f", F.regexp_extract(F.col("_metadata.file_path"), r"rank_(\d+)\.json", 1))
    else:
        df = spark.read.option("multiLine", True).json(f"{directory.rstrip('/')}/rank_*.json")
        df = df.withColumn("_f", F.col("_metadata.file_path"))
    if expected is not None:
        n = df.select("_f").distinct().count()
        if n != expected:
            raise RuntimeError(f"expected {expected} shard files, found {n}")
    if not isinstance(df.schema["pred"].dataType, T.ArrayType):
        df = df.withColumn("pred", F.array("pred"))
    rows = df.groupBy("id").agg(F.min_by("pred", "_f").alias("pred"))
    return rows.select("id", F.posexplode("pred").alias("cand_rank", "pred")).withColumn("cand_rank", F.col("cand_rank").cast("long"))


def project_translation(df: DataFrame, src_lang: str, tgt_lang: str, col: str = "translation") -> DataFrame:
    return df.select(F.col(col)[src_lang].alias("source"), F.col(col)[tgt_lang].alias("target"))


def flatten_eval_json(df: DataFrame) -> DataFrame:
    """{pair: {src: [...], tgt: [...]}} (one object) -> (pair, idx, src, tgt)."""
    m = F.from_json(F.to_json(F.struct(*[F.col(c) for c in df.columns])),
                    "map<string, struct<src: array<string>, tgt: array<string>>>")
    e = df.select(F.explode(m).alias("pair", "v"))
    return e.select("pair", F.posexplode(F.arrays_zip("v.src", "v.tgt")).alias("idx", "z")).select(
        "pair", F.col("idx").cast("long").alias("idx"), F.col("z.src").alias("src"), F.col("z.tgt").alias("tgt"))
