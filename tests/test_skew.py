import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from stowage.operators import lookup, rank_within
from stowage.operators.skew import hot_keys


def skewed(spark, rows=3000, seed=5):
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(200)}", i, rng.randrange(50)) for i in range(rows)]
    return spark.createDataFrame(data, "k string, id bigint, v int")


def test_rank_of_hot_groups_equals_a_plain_window(spark):
    df = skewed(spark)
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(-F.col("v"), "id")).cast("bigint"))
    assert hot_keys(df, ["k"], 300).count() == 1
    ranked = rank_within(df, ["k"], [-F.col("v"), F.col("id")], hot_rows=300)
    assert ranked.exceptAll(plain).isEmpty() and plain.exceptAll(ranked).isEmpty()
    assert ranked.schema["rank"].dataType == plain.schema["rank"].dataType


def test_ranges_grow_with_the_group(spark):
    df = spark.range(3000).selectExpr("if(id % 10 = 0, null, 'hot') AS k", "id")
    ranked = rank_within(df, ["k"], [F.col("id")], hot_rows=20)  # hundreds of ranges, also for the null key
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("id")).cast("bigint"))
    assert ranked.exceptAll(plain).isEmpty() and ranked.count() == 3000


def test_hot_group_is_ranked_in_several_parts(spark):
    ranked = rank_within(skewed(spark), ["k"], [F.col("id")], hot_rows=300)
    assert "__bucket" in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_lookup_of_hot_keys_equals_a_plain_join(spark):
    df = skewed(spark)
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(100)], "k string, w int")
    plain = df.join(right, "k", "left").select("k", "id", "v", "w")
    salted = lookup(df, right, ["k"], F.col("id"), hot_rows=300)
    assert salted.exceptAll(plain).isEmpty() and salted.count() == df.count()


def test_lookup_of_a_hot_key_without_match(spark):
    df = skewed(spark)
    right = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, w int")
    salted = lookup(df, right, ["k"], F.col("id"), hot_rows=300)
    assert salted.filter("k = 'hot' AND w IS NULL").count() == df.filter("k = 'hot'").count()
    assert salted.count() == df.count()


def test_no_hot_key_keeps_the_plain_plan(spark):
    df = skewed(spark)
    assert hot_keys(df, ["k"]) is None
    plan = rank_within(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
