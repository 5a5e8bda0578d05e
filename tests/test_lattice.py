"""The levelwise search for dependencies against counting every pair."""

from pyspark.sql import functions as F

from tabletwin.operators import fd as FD


def frame(spark, n=4000):
    i = F.col("id")
    return spark.range(0, n, 1, 4).select(
        (i % 60).alias("a"), (i % 12).alias("b"), (i % 5).alias("c"), F.when(i % 60 != 7, i % 3).alias("d"),
        F.pmod(F.xxhash64("id"), F.lit(4)).alias("e"), F.when(i % 401 == 0, F.lit(99)).otherwise(i % 6).alias("f`g"))


def held(conf, threshold):
    return {(tuple(r.lhs), r.rhs): (round(r.confidence, 9), r.lhs_order, r.rhs_pos) for r in conf.where(F.col("confidence") >= threshold).collect()}


def test_same_pairs_with_fewer_counts(spark):
    df = frame(spark).withColumnRenamed("f`g", "f")
    cands = df.columns
    for threshold in (0.95, 0.6):
        every = held(FD.confidences(df, cands, 3), threshold)
        for rows in (200, 1_000_000):  # with and without a sample
            done = FD.Lattice()
            assert held(FD.levelwise(df, cands, 3, threshold, sample_rows=rows, done=done), threshold) == every
            assert done.implied_pairs > 0 and done.counted_sets <= 41
            if rows == 200:
                assert done.ruled_out_pairs > 0 and done.counted_sets < 41
    assert every[(("a",), "b")][0] == 1.0


def test_nulls_stop_the_short_cut(spark):
    # x -> y holds per x, but within (x, z) some groups have no y at all, and (x, n) never meet
    df = spark.createDataFrame([(1, 5, 1, None), (1, None, 2, None), (2, 6, 1, None), (2, 6, 2, None), (None, 6, 2, 3)], "x int, y int, z int, n int")
    every = held(FD.confidences(df, df.columns, 2), 0.5)
    assert held(FD.levelwise(df, df.columns, 2, 0.5), 0.5) == every
    assert every[(("x",), "y")][0] == 1.0 and every[(("x", "z"), "y")][0] == 0.75


def test_no_candidates_and_no_rows(spark):
    df = spark.createDataFrame([], "x int, y int")
    assert FD.levelwise(df, [], 2).count() == 0 and FD.levelwise(df, ["x", "y"], 2).count() == 0
    assert FD.confidences(df, ["x"]).count() == 0


def test_pairs_of_small_groups_are_ruled_out_by_whole_groups(spark, monkeypatch):
    i = F.col("id")
    df = spark.range(0, 8000, 1, 4).select(F.floor(i / 4).alias("g"), (i % 4).alias("v"), F.floor(i / 40).alias("w"))
    every = held(FD.confidences(df, df.columns), 0.95)
    counted, measure = [], FD.measure
    monkeypatch.setattr(FD, "measure", lambda coded, wanted, *a: counted.extend((s, c) for _, s, r in wanted for c in r) or measure(coded, wanted, *a))
    # a sample of one row in forty hardly ever has two rows of a group
    assert held(FD.levelwise(df, df.columns, 1, sample_rows=200), 0.95) == every
    assert (("g",), "v") not in counted and (("g",), "w") in counted and every[(("g",), "w")][0] == 1.0
