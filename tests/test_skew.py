"""Joins with hot keys, and written tables."""

import pytest
from pyspark.sql import functions as F

from tesserine.operators.skew import keyed_join, salted_join


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_hot_key_joins_the_same_salted(spark):
    data = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    keyed = data.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how in ("inner", "left"):
        small = rows(keyed_join(data, keyed.filter("n > 1"), ["k"], "n", F.col("id"), how=how))
        assert rows(keyed_join(data, keyed.filter("n > 1"), ["k"], "n", F.col("id"), how=how, broadcast_bytes=0)) == small


def test_a_hot_key_joins_two_long_tables(spark):
    a = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    b = spark.range(60).select((F.col("id") % 20).alias("k"), F.col("id").alias("y"))
    assert rows(salted_join(a, b, ["k"], F.col("x")).select("k", "x", "y")) == rows(a.join(b, "k").select("k", "x", "y"))
    assert salted_join(a.limit(0), b, ["k"], F.col("x")).count() == salted_join(a, b.limit(0), ["k"], F.col("x")).count() == 0


def test_written_tables_are_computed_once_and_cleared(spark):
    from tesserine.session import clear_written, shared_dir, written

    a = written(spark.range(10).withColumn("r", F.rand()), "t")
    assert rows(a) == rows(a) and shared_dir(spark)
    clear_written(spark)
    assert written(spark.range(3), "t").count() == 3


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from tesserine.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return "spark://host:7077" if key == "spark.master" else default

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
