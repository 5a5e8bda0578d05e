"""Distribution fits for numeric columns (FT1-FT12) from sufficient statistics.

Every family is fitted by maximum likelihood with free loc and scale, from aggregates computed in Spark (no per-row work
on the driver). norm, expon and uniform are closed forms of count, mean, population std, min and max, given here;
lognorm, gamma and beta are searched for in ``fit_all``, for all columns at once.
AIC = 2k - 2 logL with k = number of parameters including loc and scale; best = lowest AIC.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletwin.functions.numeric import nan_to_null

# Fixed values that must equal the reference: candidate list, constant threshold, rounding of outputs.
CANDIDATES = ("norm", "gamma", "beta", "lognorm", "expon", "uniform")
CLOSED_FORM = ("norm", "expon", "uniform")
CONSTANT_STD = 1e-10
PARAM_NAMES = {"norm": ["loc", "scale"], "expon": ["loc", "scale"], "uniform": ["loc", "scale"],
               "lognorm": ["s", "loc", "scale"], "gamma": ["a", "loc", "scale"], "beta": ["a", "b", "loc", "scale"]}

LN_2PI = math.log(2 * math.pi)


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n, mean, std_pop, min, max): one aggregate for all columns."""
    d = nan_to_null(df.select(*columns))
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"),
                 F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    row = d.agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
        F.col(f"s{i}").alias("std_pop"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"))
        for i, c in enumerate(columns)])))


def closed_form(m: DataFrame) -> DataFrame:
    """FT1-FT4, FT8: per column and family (norm, expon, uniform): params, logL and AIC as Columns.
    Output (column_name, name, loc, scale, loglik, aic, n); constant columns give name 'constant'."""
    n = F.col("n").cast("double")
    norm = F.struct(F.lit("norm").alias("name"), F.col("mean").alias("loc"), F.col("std_pop").alias("scale"),
                    (-n / 2 * LN_2PI - n * F.log(F.col("std_pop")) - n / 2).alias("loglik"))
    esc = F.col("mean") - F.col("min")
    expon = F.struct(F.lit("expon").alias("name"), F.col("min").alias("loc"), esc.alias("scale"),
                     (-n * F.log(esc) - n).alias("loglik"))
    usc = F.col("max") - F.col("min")
    unif = F.struct(F.lit("uniform").alias("name"), F.col("min").alias("loc"), usc.alias("scale"),
                    (-n * F.log(usc)).alias("loglik"))
    x = m.where(F.col("n") > 0)
    fits = x.select("column_name", "n", "std_pop", F.explode(F.array(norm, expon, unif)).alias("f")).select(
        "column_name", "n", "std_pop", "f.*")
    fits = fits.withColumn("aic", F.lit(4.0) - 2 * F.col("loglik"))
    return fits


def best_closed_form(df: DataFrame, columns: Sequence[str], candidates: Sequence[str] = CLOSED_FORM) -> DataFrame:
    """FT10/FT11: best of the closed-form families by AIC, per column: (column_name, name, loc, scale, aic).
    Constant columns give ('constant', value) and NULL AIC; no finite candidate gives 'empirical'."""
    m = moments(df, columns)
    fits = closed_form(m).where(F.col("name").isin(*candidates))
    finite = fits.where(~F.isnan("aic") & F.col("aic").isNotNull() & (F.abs(F.col("aic")) < float("inf")) & (F.col("scale") > 0))
    best = finite.groupBy("column_name").agg(F.min_by(F.struct("name", "loc", "scale", "aic"), F.struct("aic", "name")).alias("b"))
    out = m.join(best, "column_name", "left")
    const = F.col("std_pop") < CONSTANT_STD
    return out.select(
        "column_name",
        F.when(const, F.lit("constant")).when(F.col("b").isNull(), F.lit("empirical")).otherwise(F.col("b.name")).alias("name"),
        F.when(const, F.col("min")).otherwise(F.col("b.loc")).alias("loc"),
        F.when(const, F.lit(None).cast("double")).otherwise(F.col("b.scale")).alias("scale"),
        F.when(const, F.lit(None).cast("double")).otherwise(F.col("b.aic")).alias("aic"))


def fit_column(df: DataFrame, col: str, candidates: Sequence[str] = CANDIDATES, ks: bool = False) -> dict:
    """FT1-FT12 for one column: the best family by AIC as {name, params, aic}, with ``ks`` also ks_statistic and
    ks_pvalue. Many columns at once: ``fit_all.fit_all``."""
    from tabletwin.operators.fit_all import fit_all
    from tabletwin.operators.profile import Profiler

    best = next(r for r in fit_all(Profiler(df, [col]), candidates, ks) if r["chosen"])
    params = best["params"] if best["name"] == "constant" else {k: round(float(v), 8) for k, v in best["params"].items()}
    out = {"name": best["name"], "params": params, "aic": None if best["aic"] is None else round(best["aic"], 4)}
    if ks:
        out |= {k: None if best[k] is None else round(best[k], 6) for k in ("ks_statistic", "ks_pvalue")}
    return out


def ks_statistic(cum: DataFrame, cdf: Column) -> DataFrame:
    """FT9: Kolmogorov-Smirnov D per column from the cumulative value counts (column_name, value, cum_lo,
    cum_hi, n) and a CDF Column of ``value``: max over values of max(cum_hi/n - F, F - cum_lo/n), which
    equals the sorted-sample formula with ties."""
    n = F.col("n").cast("double")
    d = F.greatest(F.col("cum_hi") / n - cdf, cdf - F.col("cum_lo") / n)
    return cum.groupBy("column_name").agg(F.max(d).alias("ks_statistic"), F.first("n").alias("n"))


def ks_pvalue(d: Column, n: Column) -> Column:
    """Asymptotic Kolmogorov p-value with Stephens' small-sample correction."""
    sn = F.sqrt(n.cast("double"))
    lam = (sn + 0.12 + 0.11 / sn) * d
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)),
                        lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    p = F.lit(2.0) * F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def fit_fixed_loc(df: DataFrame, col: str, name: str, loc: float = 0.0) -> dict:
    """lognorm with a fixed loc (SciPy ``floc``): closed form s = std(ln(x - loc)), scale = exp(mean(ln(x - loc))).
    The loc must lie below every value: otherwise no row is left out, but there is no fit ('empirical')."""
    if name != "lognorm":
        raise ValueError(name)
    x = F.col(col).cast("double")
    r = nan_to_null(df.select(col)).where(x.isNotNull()).agg(
        F.min(x).alias("least"), F.stddev_pop(F.when(x > loc, F.log(x - F.lit(loc)))).alias("s"),
        F.avg(F.when(x > loc, F.log(x - F.lit(loc)))).alias("m")).first()
    if r["least"] is None or r["least"] <= loc:
        return {"name": "empirical", "params": {}}
    return {"name": "lognorm", "params": {"s": round(r["s"], 8), "loc": float(loc), "scale": round(math.exp(r["m"]), 8)}}
