import os

from tessera.streaming.scoring import batch_metrics, best_so_far, start_scoring

SCHEMA = "sample_id long, cand_rank long, text string, gold string"


def test_candidates_of_a_sample_in_two_batches(spark, tmpdir_path):
    src, out, ckpt = (os.path.join(tmpdir_path, x) for x in ("in", "out", "ckpt"))
    first = [(1, 0, "the cat sat", "the cat sat down"), (1, 1, "a dog", "the cat sat down"), (2, 0, "blue sky", "the sky is blue")]
    second = [(2, 1, "the sky is blue today", "the sky is blue"), (3, 0, "x", "y z")]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, SCHEMA).write.parquet(os.path.join(src, f"batch{k}"))
        start_scoring(spark, os.path.join(src, "*"), out, ckpt).awaitTermination(120)
    assert {r.sample_id: r.cand_rank for r in best_so_far(spark, out).collect()} == {1: 0, 2: 1, 3: 0}
    assert sorted((r.batch_id, r.n) for r in batch_metrics(spark, out).collect()) == [(0, 3), (1, 2)]
    # a batch that runs again replaces its own rows
    spark.read.parquet(os.path.join(out, "batch_id=1")).select("*").limit(0).count()
    again = spark.createDataFrame(second, SCHEMA)
    from tessera.operators import candidates as cd
    cd.score_candidates(again, "rouge2").drop("gold").write.mode("overwrite").parquet(os.path.join(out, "batch_id=1"))
    assert sorted((r.batch_id, r.n) for r in batch_metrics(spark, out).collect()) == [(0, 3), (1, 2)]
