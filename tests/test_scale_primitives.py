"""Primitives above the size at which Spark samples range boundaries."""

from pyspark.sql import functions as F

from tessera.operators.cluster import connected_components
from tessera.operators.ordering import global_index, rank_within


def test_global_index_with_payload_written_out(spark, tmpdir_path):
    n = 300_000
    df = spark.range(n, numPartitions=6).select(
        F.xxhash64("id").alias("k"), "id", F.repeat(F.lit("payload "), 4).alias("payload"))
    out = f"{tmpdir_path}/indexed"
    global_index(df, ["k", "id"], "pos").write.parquet(out)
    back = spark.read.parquet(out)
    assert back.count() == n
    r = back.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()
    assert tuple(r) == (0, n - 1, n)
    # positions follow the order key
    later = back.select(F.col("pos"), F.col("k").alias("k2")).withColumn("pos", F.col("pos") - 1)
    assert back.join(later, "pos").where(F.col("k") > F.col("k2")).count() == 0


def test_rank_within_hot_group(spark):
    df = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("g"))
    bad = rank_within(df, ["g"], ["id"], "rn").groupBy("g").agg(
        F.count("*").alias("n"), F.max("rn").alias("m"), F.count_distinct("rn").alias("d")).where(
        (F.col("n") != F.col("d")) | (F.col("m") != F.col("n") - 1))
    assert bad.count() == 0


def test_components_of_a_long_path(spark):
    v = spark.range(520).select(F.col("id").alias("vec_id"))
    e = spark.range(499).select(F.col("id").alias("id1"), (F.col("id") + 1).alias("id2"))
    for few in (0, 200, 1 << 20):  # star contraction alone, before one task, not at all
        got = connected_components(v, e.repartition(7), few=few)
        assert got.where("vec_id < 500").select("cluster").distinct().collect()[0][0] == 0
        assert got.select("cluster").distinct().count() == 21
    got = connected_components(v, e)
    assert got.where("vec_id < 500").select("cluster").distinct().collect()[0][0] == 0
    assert got.select("cluster").distinct().count() == 21


def test_components_without_edges(spark):
    v = spark.createDataFrame([(1,), (2,), (2,)], "vec_id long")
    e = spark.createDataFrame([], "id1 long, id2 long")
    assert sorted(map(tuple, connected_components(v, e).collect())) == [(1, 1), (2, 2)]
