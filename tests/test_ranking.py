"""Skew-safe positions equal row_number, also when one group holds most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from growthlens.operators.ranking import positions, top_k


def test_positions_equal_row_number_under_skew(spark):
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 3 != 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),   # group 0 is hot
        (F.hash("id") % 1000).alias("score"), F.col("id").alias("p"))
    order = [F.col("score").desc(), F.col("p").asc()]
    got = positions(df, ["g"], order, "pos", num_partitions=16)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    diff = got.join(want, ["g", "p"]).where(F.col("pos") != F.col("rn")).count()
    assert got.count() == 20000 and diff == 0


def test_global_positions(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("s"), F.col("id").alias("p"))
    got = positions(df, [], [F.col("s").desc(), F.col("p")], "pos", num_partitions=8)
    assert sorted(r.pos for r in got.collect()) == list(range(1, 5001))
    top = got.where(F.col("pos") == 1).first()
    assert top.s == 4999


def test_top_k_uses_window_group_limit(spark):
    df = spark.range(0, 1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    out = top_k(df, ["g"], [F.col("v").desc()], 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert out.count() == 21
