"""Plans and limits: draws are not gathered, crowded ranges are split, exact samples of repeated rows, long contract lists."""

import pytest
from pyspark.sql import functions as F

from tabletwin.functions.rng import uniform
from tabletwin.operators import contract as CT
from tabletwin.operators import fd as FD
from tabletwin.operators import synth as SY
from tabletwin.operators.fit import fit_fixed_loc
from tabletwin.operators.profile import Profiler
from tabletwin.operators.rank import draw_from_pool, exact_sample, part_of, split_points


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_neither_gathered_nor_moved(spark):
    pool = [(f"k{i}", 1 + i % 7) for i in range(500)]
    out = SY.draw_categorical(spark.range(0, 10_000, 1, 8), spark, pool, "k", 1, "t")
    assert out.select("k").distinct().count() > 450
    text = plan_of(out)
    assert "BuildRight" in text and "BuildLeft" not in text
    # the range of draws stands under no exchange: the only one is the pool's broadcast, below the join's right side
    assert text.index("Range (0, 10000") < text.index("BroadcastExchange")


def test_outlier_does_not_crowd_the_parts(spark):
    df = spark.range(20_000).select(F.when(F.col("id") == 0, F.lit(1e12)).otherwise(F.col("id").cast("double")).alias("value"))
    cuts = df.agg(split_points(16).alias("c")).first()["c"]
    sizes = [r["count"] for r in df.groupBy(part_of(F.col("value"), F.array(*[F.lit(c) for c in cuts]))).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
    p = Profiler(df).percentiles([50]).first()
    assert p["p50"] == pytest.approx(10_000.5)


def test_candidates_per_draw_stay_constant(spark):
    def candidates(n):
        pool = spark.range(n).select(F.col("id").cast("double").alias("v"), F.lit(1).cast("bigint").alias("w"))
        d = draw_from_pool(spark.range(2000), uniform(1, "x", "id"), pool, "w", ["v"], ["v"], pool_bucket=F.floor(F.col("v") / (n / 16)).cast("int"),
                           n_draw_buckets=max(1024, n), pool_rows=n)
        text = plan_of(d)
        assert d.count() == 2000
        return text
    assert candidates(2000).count("Range") == candidates(20_000).count("Range")


def test_exact_sample_of_repeated_rows(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("v"))
    for n in (0, 1, 100, 250, 777, 1000, 2000):
        assert exact_sample(df, n).count() == min(n, 1000)


def test_long_lists_are_checked(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("name"), F.col("id")).alias("name"))
    bad = df.withColumn("name", F.when(F.col("id") < 6, F.lit("nobody")).otherwise(F.col("name")))
    contract = CT.learn(df)
    for limit in (0, 100, 1_000_000):
        assert CT.check(bad, contract, "id", inline_limit=limit).where("check_name = 'isin'").count() == 6


def test_integers_above_2_53_stay_apart(spark):
    df = spark.range(1000).select((F.lit(2**60) + F.col("id") % 10).alias("a"), (F.lit(2**60) + (F.col("id") % 10) * 2).alias("b"))
    got = {(r["lhs"][0], r["rhs"]): (r["confidence"], r["n_groups"]) for r in FD.confidences(df, ["a", "b"]).collect()}
    assert got == {("a", "b"): (1.0, 10), ("b", "a"): (1.0, 10)}
    assert {r["n_unique"] for r in Profiler(df).base().collect()} == {10}


def test_fixed_loc_leaves_no_row_out(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 3.5)], "x double")
    assert fit_fixed_loc(df, "x", "lognorm", 0.0)["name"] == "empirical"
    assert fit_fixed_loc(df, "x", "lognorm", -1.0)["name"] == "lognorm"


def test_numbers_too_large_and_zero_rows(spark):
    from tabletwin.functions import requests as R
    from tabletwin.plans.request_plans import plan_from_row

    texts = spark.createDataFrame([(1, "99999999999999999999 rows"), (2, "0 rows")], "request_id bigint, prompt string")
    rows = {r["request_id"]: r for r in R.parse_requests(texts).collect()}
    assert rows[1]["n_rows"] is None and plan_from_row(rows[2]).n_rows == 0
