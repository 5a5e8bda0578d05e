"""Comparison and inspection of tables (AG16-AG26): KPIs, equal-width histograms, describe, side-by-side
describe with differences, top values, column inspector, quantiles, copied-row rate, allocation counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletwin.functions.numeric import nan_to_null, round_half_up
from tabletwin.operators.profile import Profiler
from tabletwin.session import spread

DESCRIBE_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
QUANTILE_LEVELS = [1, 5, 25, 50, 75, 95, 99]
HISTOGRAM_PAD = 0.001  # pandas widens the outer edges by 0.1 % of the range


def kpi_row(df: DataFrame, label: str, distinct_cols: Sequence[str]) -> DataFrame:
    """AG16: rows, columns, mean of the 0/1 label, distinct counts of a few columns (one aggregate)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
                  F.avg(F.col(label).cast("double")).alias("label_rate"),
                  *[F.count_distinct(c).alias(f"n_{c}") for c in distinct_cols])


def histogram(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """AG18: pandas ``cut(x, bins)`` counts: equal width, right-closed, lowest bin holds the minimum, empty
    bins kept, a constant column goes to the middle bin of a widened range. (column_name, bin, lo, hi, count).

    Rows are unpivoted to (column, x) and joined on the column name to their (min, max) row; the result
    has columns x bins rows."""
    d = spread(nan_to_null(df.select(*columns)))
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns])
    long = d.select(F.inline(arr)).where(F.col("x").isNotNull())
    mm = long.groupBy("column_name").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    const = F.col("mx") == F.col("mn")
    pad_lo = F.when(F.col("mn") == 0, F.lit(HISTOGRAM_PAD)).otherwise(F.abs(F.col("mn")) * HISTOGRAM_PAD)
    pad_hi = F.when(F.col("mx") == 0, F.lit(HISTOGRAM_PAD)).otherwise(F.abs(F.col("mx")) * HISTOGRAM_PAD)
    mm = mm.select("column_name", "mn", "mx",
                   F.when(const, F.col("mn") - pad_lo).otherwise(F.col("mn")).alias("lo0"),
                   F.when(const, F.col("mx") + pad_hi).otherwise(F.col("mx")).alias("hi0"))
    mm = mm.withColumn("w", (F.col("hi0") - F.col("lo0")) / bins)
    b = F.when(F.col("mx") == F.col("mn"), F.lit((bins + 1) // 2)).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col("x") - F.col("mn")) / F.col("w")))))
    counts = long.join(F.broadcast(mm), "column_name").groupBy("column_name", b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    grid = mm.select("column_name", "lo0", "w", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    out = grid.join(counts, ["column_name", "bin"], "left")
    return out.select("column_name", "bin", (F.col("lo0") + (F.col("bin") - 1) * F.col("w")).alias("lo"),
                      (F.col("lo0") + F.col("bin") * F.col("w")).alias("hi"),
                      F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def describe(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """AG19: pandas ``describe()`` per numeric column as (column_name, stat, value), rounded."""
    p = Profiler(df, list(columns))
    m = p.moments()
    q = p.percentiles([25, 50, 75])
    j = m.join(q, "column_name")
    arr = F.array(*[F.struct(F.lit(s).alias("stat"), F.lit(i).alias("stat_order"), e.cast("double").alias("value"))
                    for i, (s, e) in enumerate(zip(DESCRIBE_STATS, [F.col("n"), F.col("mean"), F.col("std"), F.col("min"),
                                                                    F.col("p25"), F.col("p50"), F.col("p75"), F.col("max")]))])
    out = j.select("column_name", F.inline(arr))
    return out.withColumn("value", round_half_up(F.col("value"), digits))


def compare_describe(synthetic: DataFrame, real: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AG20/JN5: describe of both sides joined by (column, stat); difference % computed on the rounded values,
    real = 0 gives NULL, 1 dp."""
    s = describe(synthetic, columns).withColumnRenamed("value", "synthetic")
    r = describe(real, columns).withColumnRenamed("value", "real").drop("stat_order")
    j = s.join(r, ["column_name", "stat"])
    diff = (F.col("synthetic") - F.col("real")) / F.when(F.col("real") != 0, F.col("real")) * 100
    return j.select("column_name", "stat", "stat_order", "synthetic", "real", round_half_up(diff, 1).alias("difference_pct"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """AG21: the k most frequent values, count desc, value asc; (value, count, rank). Exact top-k in two
    steps (per hash split, then per column), so a high-cardinality column is not ranked in one task."""
    from tabletwin.operators.topk import top_k_per_group
    vc = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("count"))
    vc = vc.withColumn("_g", F.lit(0))
    out = top_k_per_group(vc, ["_g"], [F.col("count").desc(), F.col("_v").asc()], k, split_on=F.col("_v"))
    return out.select(F.col("_v").cast("string").alias("value"), "count", F.col("rank").cast("bigint"))


def label_counts(df: DataFrame, column: str, names: dict) -> DataFrame:
    """AG22: value counts with values renamed (e.g. 0 -> 'No Claim', 1 -> 'Claim')."""
    e = None
    for k, v in names.items():
        e = (F.when(F.col(column) == F.lit(k), F.lit(v)) if e is None else e.when(F.col(column) == F.lit(k), F.lit(v)))
    e = e.otherwise(F.col(column).cast("string"))
    return df.groupBy(e.alias("label")).agg(F.count(F.lit(1)).alias("count"))


def inspect(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """AG23: type, distinct count, nulls, and mean (numeric) or mode (others; smallest of tied modes)."""
    p = Profiler(df, list(columns) if columns else None)
    base = p.base().select("column_name", "position", "dtype", "n_unique", F.col("n_missing").alias("n_null"))
    out = base
    if p.num_specs:
        out = out.join(p.moments().select("column_name", "mean"), "column_name", "left")
    else:
        out = out.withColumn("mean", F.lit(None).cast("double"))
    if p.cat_specs:
        out = out.join(p.categorical().select("column_name", "mode"), "column_name", "left")
    else:
        out = out.withColumn("mode", F.lit(None).cast("string"))
    return out


def inspect_quantiles(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """AG24: quantiles 1, 5, 25, 50, 75, 95, 99 % rounded."""
    q = Profiler(df, list(columns)).percentiles(QUANTILE_LEVELS)
    return q.select("column_name", *[round_half_up(F.col(f"p{p}"), digits).alias(f"p{p}") for p in QUANTILE_LEVELS])


def overlap_rate(synthetic: DataFrame, real: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AG25: distinct synthetic tuples also present in the real table / distinct synthetic tuples.
    Both counts come from one aggregate over the tagged union (no cross join)."""
    s = synthetic.select(*columns).distinct()
    both = s.intersect(real.select(*columns))
    tagged = s.select(F.lit(1).alias("_s")).unionByName(both.select(F.lit(0).alias("_s")))
    return tagged.agg(F.count(F.when(F.col("_s") == 1, 1)).alias("n_synthetic"),
                      F.count(F.when(F.col("_s") == 0, 1)).alias("n_copied")).select(
        "n_synthetic", "n_copied", (F.col("n_copied") / F.col("n_synthetic")).alias("copied_rate"))


def allocation_counts(df: DataFrame, key: str) -> DataFrame:
    """AG26: rows per key value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
