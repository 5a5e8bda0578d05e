"""Gamma and beta draws by numbered tries: tail shares, and the same values on any partitioning."""

import math

import pytest
from pyspark.sql import functions as F

from tabletwin.functions.cdf import cdf
from tabletwin.functions.rng import beta, gamma

N = 200_000


def upper(name, params, x):
    import numpy as np

    return 1.0 - float(cdf(name, params, np.array([x]))[0])


@pytest.mark.parametrize("name,params,points", [
    ("gamma", {"a": 2.0}, (1.0, 4.0, 8.0, 11.0)), ("gamma", {"a": 0.4}, (0.05, 0.5, 2.0, 5.0)), ("gamma", {"a": 30.0}, (20.0, 30.0, 40.0, 48.0)),
    ("beta", {"a": 2.0, "b": 3.0}, (0.1, 0.4, 0.8, 0.95)), ("beta", {"a": 0.5, "b": 0.7}, (0.001, 0.3, 0.9, 0.999))])
def test_tail_shares(spark, name, params, points):
    draw = gamma(3, "t", "id", params["a"]) if name == "gamma" else beta(3, "t", "id", params["a"], params["b"])
    df = spark.range(0, N, 1, 8).select(draw.alias("x"))
    r = df.agg(*[F.count(F.when(F.col("x") > p, 1)).alias(f"c{i}") for i, p in enumerate(points)], F.count(F.when(F.col("x") <= 0, 1)).alias("low")).first()
    for i, p in enumerate(points):
        q = upper(name, {**params, "loc": 0.0, "scale": 1.0}, p)
        assert abs(r[f"c{i}"] / N - q) <= 3 * math.sqrt(q * (1 - q) / N) + 1e-9, (p, r[f"c{i}"] / N, q)


def test_draws_do_not_depend_on_partitions(spark):
    rows = lambda parts: {r.id: (r.g, r.b) for r in spark.range(0, 500, 1, parts).select("id", gamma(1, "s", "id", 0.7).alias("g"), beta(1, "s", "id", 2.0, 0.5).alias("b")).collect()}
    assert rows(1) == rows(7)
