from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import skew


def test_hot_keys_are_few_and_split(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    hot = skew.hot_keys(df, ["k"])
    rows = hot.collect()
    assert [(r.k, r.n) for r in rows] == [("hot", 3000)] and rows[0].fan >= 2
    salted = skew.salted(df, hot, ["k"], F.col("id"))
    assert salted.filter("k = 'hot'").select("__tf_salt").distinct().count() == rows[0].fan
    parents = skew.replicated(spark.createDataFrame([("hot",), ("1",)], "k string"), hot, ["k"])
    assert salted.join(parents, ["k", "__tf_salt"]).count() == 3001


def test_look_up_equals_a_join(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 5 == 0, F.lit(None)).otherwise((F.col("id") % 97).cast("string")).alias("k"), "id")
    entries = df.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("k"))
    got = skew.look_up(df, entries, ["k"], "n")
    want = df.join(entries.drop("n"), "k")
    assert sorted(map(tuple, got.select("k", "id", "v").collect())) == sorted(map(tuple, want.select("k", "id", "v").collect()))
    assert skew.look_up(df.limit(0), entries.limit(0), ["k"], "n").count() == 0
