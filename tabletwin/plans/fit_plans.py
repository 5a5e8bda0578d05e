"""Registered distribution-fit queries (FT1-FT12) and their oracle SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabletwin.functions.numeric import round_doubles
from tabletwin.operators import fit as FT
from tabletwin.operators.fit_all import fit_all, fits_table, ks_statistics
from tabletwin.operators.profile import Profiler
from tabletwin.plans.registry import query
from tabletwin.plans.sqlgen import union_all
from tabletwin.plans.tables import table

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_tax_flag"]
LI_SQL = "(SELECT *, CASE WHEN l_tax >= 0 THEN 1 ELSE 0 END AS l_tax_flag FROM lineitem)"


def lineitem_fit(spark, sf):
    return table(spark, sf, "lineitem").withColumn("l_tax_flag", F.when(F.col("l_tax") >= 0, 1).otherwise(0))


def _mom_sql(src, cols):
    return union_all([f"SELECT '{c}' AS column_name, count({c}) AS n, avg({c}::DOUBLE) AS mean, stddev_pop({c}::DOUBLE) AS std_pop, "
                      f"min({c}::DOUBLE) AS mn, max({c}::DOUBLE) AS mx FROM {src}" for c in cols])


def _closed_sql(src, cols):
    m = _mom_sql(src, cols)
    return f"""WITH m AS ({m}),
f AS (SELECT column_name, 'norm' AS name, mean AS loc, std_pop AS scale, -n / 2 * ln(2 * pi()) - n * ln(std_pop) - n / 2 AS loglik FROM m WHERE n > 0
  UNION ALL SELECT column_name, 'expon', mn, mean - mn, -n * ln(mean - mn) - n FROM m WHERE n > 0
  UNION ALL SELECT column_name, 'uniform', mn, mx - mn, -n * ln(mx - mn) FROM m WHERE n > 0)
"""


@query("fit_constant", f"""SELECT column_name, std_pop < 1e-10 AS is_constant, CASE WHEN std_pop < 1e-10 THEN mn END AS value
FROM ({_mom_sql(LI_SQL, LI_NUM)})""")
def fit_constant(spark, sf):
    """FT1: a column whose population std is below 1e-10 is 'constant' with its value."""
    m = FT.moments(lineitem_fit(spark, sf), LI_NUM)
    c = F.col("std_pop") < FT.CONSTANT_STD
    return m.select("column_name", c.alias("is_constant"), F.when(c, F.col("min")).alias("value"))


@query("fit_closed_form", _closed_sql(LI_SQL, LI_NUM) + """SELECT column_name, name, round(loc, 8) AS loc, round(scale, 8) AS scale
FROM f WHERE scale > 0""")
def fit_closed_form(spark, sf):
    """FT2-FT4, FT12: norm (mean, population std), expon (min, mean - min), uniform (min, max - min)."""
    f = FT.closed_form(FT.moments(lineitem_fit(spark, sf), LI_NUM)).where(F.col("scale") > 0)
    return f.select("column_name", "name", F.round("loc", 8).alias("loc"), F.round("scale", 8).alias("scale"))


@query("fit_aic", _closed_sql(LI_SQL, LI_NUM) + """SELECT column_name, name, round(loglik, 4) AS loglik, round(4 - 2 * loglik, 4) AS aic
FROM f WHERE scale > 0""")
def fit_aic(spark, sf):
    """FT8: log-likelihood and AIC = 2k - 2 logL (k = 2: loc and scale) from the same sufficient statistics."""
    f = FT.closed_form(FT.moments(lineitem_fit(spark, sf), LI_NUM)).where(F.col("scale") > 0)
    return f.select("column_name", "name", F.round("loglik", 4).alias("loglik"), F.round("aic", 4).alias("aic"))


@query("fit_best", _closed_sql(LI_SQL, LI_NUM) + f"""SELECT m.column_name,
  CASE WHEN m.std_pop < 1e-10 THEN 'constant' ELSE b.name END AS name,
  round(CASE WHEN m.std_pop < 1e-10 THEN m.mn ELSE b.loc END, 8) AS loc,
  round(CASE WHEN m.std_pop < 1e-10 THEN NULL ELSE b.scale END, 8) AS scale,
  round(CASE WHEN m.std_pop < 1e-10 THEN NULL ELSE 4 - 2 * b.loglik END, 4) AS aic
FROM m LEFT JOIN (SELECT * FROM f WHERE scale > 0 QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY 4 - 2 * loglik, name) = 1) b
ON m.column_name = b.column_name""")
def fit_best(spark, sf):
    """FT10/FT1: lowest AIC among the closed-form families; constant columns flagged."""
    b = FT.best_closed_form(lineitem_fit(spark, sf), LI_NUM)
    return b.select("column_name", "name", F.round("loc", 8).alias("loc"), F.round("scale", 8).alias("scale"),
                    F.round("aic", 4).alias("aic"))


@query("fit_params", _closed_sql(LI_SQL, LI_NUM) + """SELECT column_name, name, param, round(value, 8) AS value FROM (
  SELECT column_name, name, 'loc' AS param, loc AS value FROM f WHERE scale > 0
  UNION ALL SELECT column_name, name, 'scale', scale FROM f WHERE scale > 0)""")
def fit_params(spark, sf):
    """FT12: parameters named (shapes..., loc, scale) as (column, family, param, value) rows."""
    f = FT.closed_form(FT.moments(lineitem_fit(spark, sf), LI_NUM)).where(F.col("scale") > 0)
    return f.select("column_name", "name", F.inline(F.array(
        F.struct(F.lit("loc").alias("param"), F.round("loc", 8).alias("value")),
        F.struct(F.lit("scale").alias("param"), F.round("scale", 8).alias("value")))))


@query("fit_lognorm", """SELECT 'value' AS column_name, round(stddev_pop(ln(value + 1.0)), 8) AS s, -1.0::DOUBLE AS loc,
  round(exp(avg(ln(value + 1.0))), 8) AS scale FROM events WHERE value IS NOT NULL""")
def fit_lognorm(spark, sf):
    """FT5 with loc fixed at -1, below every value: s = std of ln(x + 1), scale = exp(mean of ln(x + 1))."""
    f = FT.fit_fixed_loc(table(spark, sf, "events"), "value", "lognorm", -1.0)
    return spark.createDataFrame([("value", f["params"]["s"], f["params"]["loc"], f["params"]["scale"])],
                                 "column_name string, s double, loc double, scale double")


def _fits(spark, sf, wanted, cands, chosen=True):
    """Fits of columns of driver tables, all columns of a table at once."""
    rows = []
    for name, cols in wanted.items():
        rows += [r for r in fit_all(Profiler(table(spark, sf, name), cols), cands) if r["chosen"] or not chosen]
    return fits_table(spark, rows)


@query("fit_gamma")
def fit_gamma(spark, sf):
    """FT6, FT9: gamma (a, loc, scale) with free loc, on events.value and lineitem.l_extendedprice."""
    return _fits(spark, sf, {"events": ["value"], "lineitem": ["l_extendedprice"]}, ("gamma",)).drop("chosen")


@query("fit_beta")
def fit_beta(spark, sf):
    """FT7, FT9: beta (a, b, loc, scale) on lineitem.l_discount and orders.o_totalprice."""
    return _fits(spark, sf, {"lineitem": ["l_discount"], "orders": ["o_totalprice"]}, ("beta",)).drop("chosen")


@query("fit_all_candidates")
def fit_all_candidates(spark, sf):
    """FT1-FT12: best of all six families by AIC for the numeric columns of ``events`` and ``lineitem``, with KS."""
    return _fits(spark, sf, {"events": ["value"], "lineitem": ["l_quantity", "l_extendedprice"]}, FT.CANDIDATES).drop("chosen")


@query("fit_every_family")
def fit_every_family(spark, sf):
    """FT2-FT9: all six families of one column with AIC and KS numbers, and which one is chosen."""
    return _fits(spark, sf, {"events": ["value"]}, FT.CANDIDATES, chosen=False)


def _ks_sql(src, col, family):
    if family == "uniform":
        cdf = "greatest(0.0, least(1.0, (v - loc) / scale))"
        par = f"SELECT min({col}::DOUBLE) AS loc, max({col}::DOUBLE) - min({col}::DOUBLE) AS scale FROM {src}"
    else:
        cdf = "CASE WHEN v < loc THEN 0.0 ELSE 1.0 - exp(-(v - loc) / scale) END"
        par = f"SELECT min({col}::DOUBLE) AS loc, avg({col}::DOUBLE) - min({col}::DOUBLE) AS scale FROM {src}"
    return f"""WITH vc AS (SELECT {col}::DOUBLE AS v, count(*) AS c FROM {src} WHERE {col} IS NOT NULL GROUP BY 1),
cum AS (SELECT v, sum(c) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS hi, c, sum(c) OVER () AS n FROM vc),
p AS ({par}),
d AS (SELECT max(greatest(hi::DOUBLE / n - {cdf}, {cdf} - (hi - c)::DOUBLE / n)) AS d, max(n) AS n FROM cum, p)
SELECT '{col}' AS column_name, '{family}' AS name, round(d, 6) AS ks_statistic,
  round(least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: pow(-1.0, k - 1) *
    exp(-2.0 * k * k * pow((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d, 2)))))), 6) AS ks_pvalue FROM d"""


def _ks(spark, df, col, family):
    p = Profiler(df, [col])
    cum = p.cumulative_counts()
    m = FT.moments(df, [col]).first()
    loc = m["min"]
    scale = (m["max"] - m["min"]) if family == "uniform" else (m["mean"] - m["min"])
    v = F.col("value")
    if family == "uniform":
        cdf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.lit(loc)) / F.lit(scale)))
    else:
        cdf = F.when(v < F.lit(loc), F.lit(0.0)).otherwise(F.lit(1.0) - F.exp(-(v - F.lit(loc)) / F.lit(scale)))
    d = FT.ks_statistic(cum, cdf).withColumn("_p", FT.ks_pvalue(F.col("ks_statistic"), F.col("n")))
    return d.select("column_name", F.lit(family).alias("name"), F.round("ks_statistic", 6).alias("ks_statistic"),
                    F.round("_p", 6).alias("ks_pvalue"))


@query("ks_uniform", _ks_sql("lineitem", "l_discount", "uniform"))
def ks_uniform(spark, sf):
    """FT9: Kolmogorov-Smirnov statistic (ties handled by value counts) and asymptotic p-value, uniform fit."""
    return _ks(spark, table(spark, sf, "lineitem"), "l_discount", "uniform")


@query("ks_expon", _ks_sql("events", "value", "expon"))
def ks_expon(spark, sf):
    """FT9 for the exponential fit of events.value."""
    return _ks(spark, table(spark, sf, "events"), "value", "expon")


# ---- KS of all six families at parameters that moments give, against distribution functions summed up in SQL ------

KS_ALL = {"events": ["value"], "lineitem": ["l_extendedprice", "l_quantity"]}


def _moment_fits(m):
    """Parameters of all families from n, mean, population std, min and max: closed forms where there are any, else by the
    method of moments between (min - pad) and (max + pad), pad = a tenth of the range."""
    mean, var, pad = m["mean"], m["std_pop"] ** 2, (m["max"] - m["min"]) / 10
    lo, width = m["min"] - pad, m["max"] - m["min"] + 2 * pad
    y, z = mean - lo, (mean - lo) / width
    both = z * (1 - z) / (var / width ** 2) - 1
    s2 = math.log(1 + var / y ** 2)
    return {
        "norm": {"loc": mean, "scale": m["std_pop"]}, "expon": {"loc": m["min"], "scale": mean - m["min"]}, "uniform": {"loc": m["min"], "scale": m["max"] - m["min"]},
        "lognorm": {"s": math.sqrt(s2), "loc": lo, "scale": y / math.sqrt(1 + var / y ** 2)}, "gamma": {"a": y * y / var, "loc": lo, "scale": var / y},
        "beta": {"a": z * both, "b": (1 - z) * both, "loc": lo, "scale": width},
    }


def norm_cdf_sql(z: str) -> str:
    """Standard normal CDF by the series of the incomplete gamma function of 1/2 at z^2 / 2."""
    x = f"greatest(({z}) * ({z}) / 2, 1e-300)"
    return f"(0.5 + sign({z}) * 0.5 * list_sum(list_transform(range(0, 120), lambda k: exp((k + 0.5) * ln({x}) - {x} - lgamma(k + 1.5)))))"


def _ks_all_sql():
    parts = []
    for t, cols in KS_ALL.items():
        for c in cols:
            parts.append(f"""SELECT '{c}' AS column_name, {c}::DOUBLE AS v, count(*) AS cnt FROM {t} WHERE {c} IS NOT NULL GROUP BY 2""")
    gamma = "list_sum(list_transform(range(0, 400), lambda k: exp((a + k) * ln(x) - x - lgamma(a + k + 1))))"
    # the beta series converges like a power of x: beyond the mean, the other end is summed
    series = lambda a, b, x: f"list_sum(list_transform(range(0, 600), lambda k: exp(lgamma({a} + {b} + k) - lgamma({a} + k + 1) - lgamma({b}) + ({a} + k) * ln({x}) + {b} * ln(1 - {x}))))"
    return f"""WITH vc AS ({union_all(parts)}),
m AS (SELECT column_name, sum(cnt) AS n, sum(v * cnt) / sum(cnt) AS mean, min(v) AS mn, max(v) AS mx FROM vc GROUP BY 1),
s AS (SELECT m.*, var, mn - (mx - mn) / 10 AS lo, (mx - mn) * 1.2 AS width, mean - (mn - (mx - mn) / 10) AS y0 FROM m JOIN
  (SELECT vc.column_name, sum(cnt * (v - mean) * (v - mean)) / sum(cnt) AS var FROM vc JOIN m ON vc.column_name = m.column_name GROUP BY 1) q ON m.column_name = q.column_name),
cum AS (SELECT vc.column_name, v, sum(cnt) OVER (PARTITION BY vc.column_name ORDER BY v ROWS UNBOUNDED PRECEDING) AS hi, cnt, s.* EXCLUDE (column_name) FROM vc JOIN s ON vc.column_name = s.column_name),
f AS (SELECT *, y0 * y0 / var AS a, (v - lo) / (var / y0) AS x, y0 / width AS z, (y0 / width) * (1 - y0 / width) / (var / (width * width)) - 1 AS k0, ln(1 + var / (y0 * y0)) AS s2 FROM cum),
g AS (SELECT *, z * k0 AS ba, (1 - z) * k0 AS bb, (v - lo) / width AS bx FROM f),
d AS (
  SELECT column_name, n, hi, cnt, 'norm' AS name, {norm_cdf_sql('(v - mean) / sqrt(var)')} AS p FROM g
  UNION ALL SELECT column_name, n, hi, cnt, 'expon', 1 - exp(-(v - mn) / (mean - mn)) FROM g
  UNION ALL SELECT column_name, n, hi, cnt, 'uniform', (v - mn) / (mx - mn) FROM g
  UNION ALL SELECT column_name, n, hi, cnt, 'lognorm', {norm_cdf_sql('ln((v - lo) / (y0 / sqrt(1 + var / (y0 * y0)))) / sqrt(s2)')} FROM g
  UNION ALL SELECT column_name, n, hi, cnt, 'gamma', {gamma} FROM g
  UNION ALL SELECT column_name, n, hi, cnt, 'beta', CASE WHEN bx <= z THEN {series('ba', 'bb', 'bx')} ELSE 1 - {series('bb', 'ba', '(1 - bx)')} END FROM g)
SELECT column_name, name, round(max(greatest(hi::DOUBLE / n - p, p - (hi - cnt)::DOUBLE / n)), 6) AS ks_statistic FROM d GROUP BY 1, 2"""


@query("ks_all", _ks_all_sql())
def ks_all(spark, sf):
    """FT9: the KS statistic of all six families for columns of two tables, one job a table."""
    rows = []
    for name, cols in KS_ALL.items():
        p = Profiler(table(spark, sf, name), cols)
        fits = [(m["column_name"], f, params) for m in p.moment_rows() for f, params in _moment_fits(m).items()]
        rows += [(c, f, round(d, 6)) for (c, f), d in ks_statistics(p.cumulative_counts(), fits).items()]
    return spark.createDataFrame(rows, "column_name string, name string, ks_statistic double")
