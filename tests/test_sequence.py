"""number_within gives the same numbers as a window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from basketlab.operators.sequence import number_within


def test_matches_window(spark):
    df = spark.range(0, 5000).select(
        (F.when(F.col("id") % 10 < 7, F.lit(1)).otherwise(F.col("id") % 13)).alias("g"),
        (F.col("id") * 7919 % 1000).alias("t"), F.col("id").alias("k"))
    w = Window.partitionBy("g").orderBy("t", "k")
    want = {(r.k, r.rn, r.pt) for r in df.select("k", F.row_number().over(w).alias("rn"),
                                                  F.lag("t").over(w).alias("pt")).collect()}
    got = number_within(df, ["g"], ["t", "k"], "rn", prev={"t": "pt"})
    assert {(r.k, r.rn, r.pt) for r in got.collect()} == want


def test_null_groups_and_no_rows(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (2, 5)], "g long, t long")
    assert {tuple(r) for r in number_within(df, ["g"], ["t"], "rn").collect()} == {(None, 1, 1), (None, 3, 2), (2, 5, 1)}
    assert number_within(df.limit(0), ["g"], ["t"], "rn").count() == 0
