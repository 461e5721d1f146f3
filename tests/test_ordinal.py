"""Skew-safe running sums equal plain window sums, also with one hot key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from streamfactor.operators.ordinal import ordinal, running_max, running_sum


def test_running_sum_with_hot_key(spark):
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"),
        (F.col("id") * 7919 % 10007).alias("t"), F.col("id").alias("seq"), (F.col("id") % 5).alias("v"))
    got = running_sum(df, ["k"], ["t", "seq"], F.col("v"), out="rs", partitions=8)
    w = Window.partitionBy("k").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("rs", F.sum("v").over(w))
    assert got.select("seq", "rs").exceptAll(want.select("seq", "rs")).count() == 0
    assert got.count() == 20000


def test_many_small_keys(spark):
    df = spark.range(0, 3000).select((F.col("id") % 30).alias("k"), (F.col("id") * 13 % 3001).alias("t"))
    got = ordinal(df, ["k"], ["t"], out="pos")
    w = Window.partitionBy("k").orderBy("t")
    want = df.withColumn("pos", F.row_number().over(w) - 1)
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_ordinal_global_and_hot_key_spread(spark):
    df = spark.range(0, 5000).select(F.lit(1).alias("k"), (F.col("id") * 31 % 5003).alias("t"))
    got = ordinal(df, ["k"], ["t"], out="pos", partitions=8)
    rows = sorted((r["t"], r["pos"]) for r in got.collect())
    assert [p for _, p in rows] == list(range(5000))
    staged = df.repartitionByRange(8, "k", "t").select(F.spark_partition_id().alias("p")).distinct().count()
    assert staged > 1  # the single hot key is cut over several tasks


def test_running_max(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("seq"), (F.col("id") * 7 % 101).alias("x"))
    got = {r["seq"]: r["m"] for r in running_max(df, [], ["seq"], F.col("x"), out="m", partitions=6).collect()}
    best = None
    for s in range(3000):
        assert got[s] == best
        x = s * 7 % 101
        best = x if best is None else max(best, x)


def test_running_max_within_keys(spark):
    df = spark.range(0, 4000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), F.col("id").alias("seq"), (F.col("id") * 37 % 991).alias("x"))
    got = running_max(df, ["k"], ["seq"], F.col("x"), out="m", partitions=7)
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("m", F.max("x").over(w))
    assert got.select("seq", "m").exceptAll(want.select("seq", "m")).count() == 0


def test_null_and_empty_keys(spark):
    df = spark.createDataFrame([(None, 1), ("a", 1), (None, 2), ("", 1), ("a", 2)], "k string, t int")
    got = {(r["k"], r["t"]): r["pos"] for r in ordinal(df, ["k"], ["t"], partitions=3).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", 1): 0, ("a", 2): 1, ("", 1): 0}
    assert ordinal(df.limit(0), ["k"], ["t"]).collect() == []


def test_one_range_exchange_and_integers_only(spark):
    df = spark.range(100).withColumn("x", F.lit(0.5))
    with pytest.raises(TypeError):
        running_sum(df, [], ["id"], F.col("x"))
    plan = ordinal(df, [], ["id"])._jdf.queryExecution().toString()
    assert "hashpartitioning" not in plan
