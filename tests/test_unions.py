"""A key of a union is aggregated once, whatever the children's plans."""

from pyspark.sql import functions as F

from loomspan import shared


def test_aggregate_over_a_union_of_joins(spark):
    split = spark.createDataFrame([("a", "train"), ("b", "validation"), ("c", "held_out"), ("d", "train")], "k string, part string")
    fixed = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")], "k string, v string")
    twice = fixed.withColumn("i", F.lit(1)).unionByName(fixed.filter("k = 'a' AND v = 'x'").withColumn("i", F.lit(0)))
    own = twice.join(split.filter("part = 'train'").select("k"), "k", "left_semi").groupBy("k", "v").agg(F.min("i").alias("i"))
    other = fixed.join(split, "k").filter("part <> 'held_out'").groupBy("k", "v").agg(F.count("*").alias("i"))
    shared.settle(spark)
    assert sorted(map(tuple, own.unionByName(other).collect())) == [("a", "x", 0), ("a", "x", 2), ("a", "y", 1), ("a", "y", 1), ("b", "x", 1)]
