"""Quantile sketches: rank errors within the bound, merging, odd columns."""

from pyspark.sql import functions as F

from tabletwin.operators import sketch as SK


def test_errors_and_merging(spark):
    df = spark.range(0, 50_000, 1, 8).select(F.exp(F.rand(1) * 9).alias("x"), (F.col("id") % 3).alias("few"), F.lit(None).cast("double").alias("none"),
                                              F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("id").cast("double")).alias("a`b"))
    df = df.withColumnRenamed("a`b", "half").checkpoint()
    whole = SK.sketches(df)
    parts = SK.merged(SK.sketches(df.where("few = 0")).unionByName(SK.sketches(df.where("few > 0"))))
    for t in (whole, parts):
        t = t.checkpoint()
        assert {r.column_name: r.n for r in t.collect()} == {"x": 50_000, "few": 50_000, "none": 0, "half": 25_000}
        errors = SK.rank_errors(df, t).collect()
        assert len(errors) == 27 and max(r.rank_error for r in errors) <= SK.RANK_ERROR
        assert {r.value for r in errors if r.column_name == "few"} <= {0.0, 1.0, 2.0}
        read = {r.column_name: r for r in SK.percentiles(t).collect()}
        assert read["none"].p50 is None and abs(read["half"].p50 - 25_000) <= 0.011 * 50_000


def test_no_rows(spark):
    df = spark.createDataFrame([], "x double")
    t = SK.sketches(df)
    assert [(r.n, r.p50) for r in SK.percentiles(t).collect()] == [(0, None)]
    assert SK.rank_errors(df, t).count() == 0 and SK.merged(t.limit(0)).count() == 0
