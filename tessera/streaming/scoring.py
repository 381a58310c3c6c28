"""Score candidate files as they arrive (file source -> foreachBatch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import candidates as cd

CANDIDATES = T.StructType([T.StructField("sample_id", T.LongType()),
                           T.StructField("cand_rank", T.LongType()),
                           T.StructField("text", T.StringType()),
                           T.StructField("gold", T.StringType())])


def start_scoring(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                  metric: str = "rouge2", trigger_once: bool = True):
    """Every micro-batch writes the scores of its candidates to a folder of
    its own number; a batch that is run again replaces what it wrote."""
    stream = spark.readStream.schema(CANDIDATES).parquet(in_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        scored = cd.score_candidates(batch, metric).drop("gold")
        scored.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def best_so_far(spark: SparkSession, out_dir: str) -> DataFrame:
    """The best candidate of each sample over all batches: candidates of one
    sample may arrive in several."""
    return cd.pick_best(spark.read.parquet(out_dir), payload=["text"])


def batch_metrics(spark: SparkSession, out_dir: str) -> DataFrame:
    """Candidates and mean score of each batch."""
    return spark.read.parquet(out_dir).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
