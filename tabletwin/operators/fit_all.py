"""Maximum-likelihood fits of all six families for all numeric columns at once, with Kolmogorov-Smirnov numbers.

One table of trial points (column, family, end points) meets the columns' value counts in each round, and one
aggregation gives every sum that the likelihood, its gradient and its curvature need there. So the number of jobs
depends on the rounds of the slowest fit, not on the number of columns or families, and rounds read value counts, not
rows. What reaches the driver is one row of sums per trial point.

Free end points (loc; for beta also loc + scale) are searched in the logarithm of their distance from the data. The
other parameters are solved exactly for given end points, so the search is over one or two numbers: Newton steps on the
profile likelihood within a trust radius, from the best point of a coarse grid. The likelihoods of lognorm, gamma and
beta have no maximum as an end point nears the data; the distance is therefore at least ``NEAREST`` times the column's
range, and at most ``FARTHEST`` times.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletwin.functions import cdf, special
from tabletwin.operators.fit import CANDIDATES, CONSTANT_STD, LN_2PI, moments
from tabletwin.session import map_arrow

NEAREST, FARTHEST = 1e-3, 1e3
ROUNDS = 30
#: Neighbouring values whose distribution function is first bounded by its values at both ends, and what rounding may add.
BLOCK, SLACK = 64, 1e-9
#: A search ends when a step gains less than this in log-likelihood per row.
ENOUGH = 1e-9
_SEARCHED = ("lognorm", "gamma", "beta")
#: Sums over a column's rows by the distance d of a value from an end.
_SUMS = {"u": "ln(d)", "uu": "ln(d) * ln(d)", "v": "1 / d", "vv": "1 / (d * d)", "uv": "ln(d) / d", "uvv": "ln(d) / (d * d)", "y": "d"}
#: What a trial takes from the sums of its high end, and by which names.
_HIGH = {"q": "u", "r": "v", "rr": "vv"}


def trial_sums(counts: DataFrame, trials: list[tuple[int, str, float, float | None]]) -> dict[int, dict]:
    """Means of ``_SUMS`` over a column's rows for each trial (id, column, low end, high end or None). The sums of an end
    do not depend on the other, so each end of a column is summed up once, however many trials share it."""
    ends = {key: i for i, key in enumerate(dict.fromkeys((c, e) for _, c, lo, hi in trials for e in (lo, hi) if e is not None))}
    side = counts.sparkSession.createDataFrame([(i, c, e) for (c, e), i in ends.items()], "at int, column_name string, e double")
    d = counts.join(F.broadcast(side), "column_name").withColumn("d", F.abs(F.col("value") - F.col("e")))
    rows = d.groupBy("at").agg(F.sum("count").alias("n"), *[F.sum(F.col("count") * F.expr(e)).alias(k) for k, e in _SUMS.items()]).collect()
    means = {r["at"]: {k: r[k] / r["n"] for k in _SUMS} for r in rows}
    out = {}
    for trial, column, lo, hi in trials:
        if ends[column, lo] in means:
            high = {k: None for k in _HIGH} if hi is None else {k: means[ends[column, hi]][of] for k, of in _HIGH.items()}
            out[trial] = means[ends[column, lo]] | high
    return out


def lognorm_at(m: dict) -> tuple[float, np.ndarray, np.ndarray, dict]:
    """Log-likelihood per row, its derivative and second derivative by the low end, and the other parameters."""
    var = max(m["uu"] - m["u"] ** 2, 1e-300)
    d1 = 2 * (m["u"] * m["v"] - m["uv"])
    d2 = 2 * (m["vv"] - m["uvv"] - m["v"] ** 2 + m["u"] * m["vv"])
    value = -0.5 * math.log(var) - 0.5 * (LN_2PI + 1) - m["u"]
    grad = -0.5 * d1 / var + m["v"]
    curve = -0.5 * (d2 / var - (d1 / var) ** 2) + m["vv"]
    return value, np.array([grad]), np.array([[curve]]), {"s": math.sqrt(var), "scale": math.exp(m["u"])}


def gamma_at(m: dict):
    gap = math.log(m["y"]) - m["u"]
    if gap <= 0:
        return None
    a = special.gamma_shape_mle(gap)
    value = -math.lgamma(a) - a * math.log(m["y"]) + a * math.log(a) + (a - 1) * m["u"] - a
    grad = a / m["y"] - (a - 1) * m["v"]
    move = (m["v"] - 1 / m["y"]) / (1 / a - special.trigamma(a))
    curve = move / m["y"] + a / m["y"] ** 2 - move * m["v"] - (a - 1) * m["vv"]
    return value, np.array([grad]), np.array([[curve]]), {"a": a, "scale": m["y"] / a}


def beta_at(m: dict, width: float):
    """The same with both ends free: derivatives by the low and the high end."""
    shapes = special.beta_shapes_mle(m["u"] - math.log(width), m["q"] - math.log(width))
    if shapes is None:
        return None
    a, b = shapes
    s = (a + b - 1) / width
    value = (a - 1) * m["u"] + (b - 1) * m["q"] - special.lbeta(a, b) - (a + b - 1) * math.log(width)
    grad = np.array([s - (a - 1) * m["v"], (b - 1) * m["r"] - s])
    own = np.array([[s / width - (a - 1) * m["vv"], -s / width], [-s / width, s / width - (b - 1) * m["rr"]]])
    cross = np.array([[1 / width - m["v"], 1 / width], [-1 / width, m["r"] - 1 / width]])
    t = special.trigamma(a + b)
    inner = np.array([[t - special.trigamma(a), t], [t, t - special.trigamma(b)]])
    return value, grad, own - cross @ np.linalg.solve(inner, cross.T), {"a": a, "b": b}


class Search:
    """The ends of one column's family: distances from the data by their logarithms, within a box."""

    def __init__(self, column: str, family: str, low: float, high: float):
        self.column, self.family, self.low, self.high = column, family, low, high
        self.least, self.most = math.log(NEAREST * (high - low)), math.log(FARTHEST * (high - low))
        steps = np.linspace(self.least, self.most, 7 if family != "beta" else 5)
        self.trials = [np.array([s]) for s in steps] if family != "beta" else [np.array([s, t]) for s in steps for t in steps]
        self.best = None
        self.radius = 1.0
        self.done = False

    def ends(self, at: np.ndarray):
        return self.low - math.exp(at[0]), (self.high + math.exp(at[1]) if self.family == "beta" else None)

    def judged(self, at: np.ndarray, m: dict):
        lo, hi = self.ends(at)
        found = {"lognorm": lognorm_at, "gamma": gamma_at}[self.family](m) if hi is None else beta_at(m, hi - lo)
        if found is None or not math.isfinite(found[0]):
            return None
        value, grad, curve, params = found
        # chain rule: low end = low - exp(s), high end = high + exp(t)
        slope = np.exp(at) * np.array([-1.0, 1.0])[:len(at)]
        params = dict(params, loc=lo) if hi is None else dict(params, loc=lo, scale=hi - lo)
        return value, grad * slope, curve * np.outer(slope, slope) + np.diag(grad * slope), params, at

    def take(self, results: list):
        """The sums of the trials are in: move, and propose the next trial."""
        results = [r for r in results if r is not None]
        top = max(results, key=lambda r: r[0], default=None)
        if self.best is None:
            if top is None:
                self.done, self.trials = True, []
                return
            self.best = top
        elif top is None or top[0] <= self.best[0]:
            self.radius /= 4
        else:
            gain = top[0] - self.best[0]
            self.radius = min(4.0, max(self.radius, 2 * float(np.abs(top[4] - self.best[4]).max())))
            self.best = top
            if gain < ENOUGH:
                self.done = True
        _, grad, curve, _, at = self.best
        free = ~(((at <= self.least) & (grad < 0)) | ((at >= self.most) & (grad > 0)))
        if not free.any() or self.radius < 1e-9:
            self.done = True
        step = np.zeros(len(at))
        if free.any():
            # Newton, uphill also where the curve bends the wrong way
            size, axes = np.linalg.eigh(curve[np.ix_(free, free)])
            step[free] = axes @ ((axes.T @ grad[free]) / np.maximum(np.abs(size), 1e-9))
        far = float(np.abs(step).max())
        if far > self.radius:
            step *= self.radius / far
        new = np.clip(at + step, self.least, self.most)
        if float(np.abs(new - at).max()) < 1e-9:
            self.done = True
        self.trials = [] if self.done else [new]


def _searches(counts: DataFrame, searches: list[Search]) -> None:
    for _ in range(ROUNDS):
        asked = [(s, at) for s in searches if not s.done for at in s.trials]
        if not asked:
            return
        sums = trial_sums(counts, [(i, s.column, *map(lambda e: None if e is None else float(e), s.ends(at))) for i, (s, at) in enumerate(asked)])
        found: dict[int, list] = {}
        for i, (s, at) in enumerate(asked):
            found.setdefault(id(s), []).append(s.judged(at, sums[i]) if i in sums else None)
        for s in searches:
            if not s.done:
                s.take(found.get(id(s), []))


def largest_gap(name: str, params: dict, value: np.ndarray, lo: np.ndarray, hi: np.ndarray, known: float = 0.0) -> float:
    """max(hi - F, F - lo) over the values, or ``known`` if that is more. F rises, so between the ends of a block of
    sorted values the gap is bounded by the block's: only blocks that can pass the most known gap are looked at whole."""
    order = np.argsort(value, kind="stable")
    value, lo, hi = value[order], lo[order], hi[order]
    first = np.arange(0, len(value), BLOCK)
    last = np.minimum(first + BLOCK, len(value)) - 1
    p = cdf.cdf(name, params, value[np.concatenate([first, last])])
    low, high = p[:len(first)], p[len(first):]
    gap = lambda f, at: float(np.maximum(hi[at] - f, f - lo[at]).max(initial=known))
    known = max(gap(low, first), gap(high, last))
    bound = np.maximum(hi[last] - low, high - lo[first]) + SLACK
    inner = np.zeros(len(value), bool)
    for i in np.flatnonzero(~(bound <= known)):
        inner[first[i] + 1:last[i]] = True
    return gap(cdf.cdf(name, params, value[inner]), inner)


def ks_statistics(cum: DataFrame, fits: list[tuple[str, str, dict]]) -> dict[tuple[str, str], float]:
    """FT9 for many columns and families in one job: D per (column, family) from the cumulative value counts; tasks
    evaluate the distribution functions where batches of distinct values can pass what they found, one number per fit."""
    by: dict[str, list] = {}
    for column, name, params in fits:
        by.setdefault(column, []).append((name, params))

    def work(batches):
        most: dict[tuple[str, str], float] = {}
        for batch in batches:
            columns = np.array(batch.column(0).to_pylist(), object)
            value, lo, hi, n = (batch.column(i).to_numpy().astype(float) for i in range(1, 5))
            for c in set(columns.tolist()):
                at = columns == c
                for name, params in by.get(c, []):
                    most[c, name] = largest_gap(name, params, value[at], lo[at] / n[at], hi[at] / n[at], most.get((c, name), 0.0))
        if most:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in most]), pa.array([k[1] for k in most]), pa.array(list(most.values()))], ["column_name", "name", "d"])

    rows = map_arrow(cum.select("column_name", "value", "cum_lo", "cum_hi", "n"), work, "column_name string, name string, d double")
    return {(r.column_name, r["name"]): r.d for r in rows.groupBy("column_name", "name").agg(F.max("d").alias("d")).collect()}


def fit_all(profiler, candidates: Sequence[str] = CANDIDATES, ks: bool = True) -> list[dict]:
    """FT1-FT12 for every numeric column of a ``Profiler``: rows {column_name, name, params, loglik, aic, ks_statistic, ks_pvalue, chosen};
    one row per finite family, or one with name 'constant' or 'empirical'. ``chosen`` marks the lowest AIC."""
    names = [s.name for s in profiler.num_specs]
    if not names:
        return []
    stats = {r.column_name: r for r in moments(profiler.df, names).collect()}
    rows: list[dict] = []
    searches: list[Search] = []
    blank = {"loglik": None, "aic": None, "ks_statistic": None, "ks_pvalue": None, "chosen": True}

    def found(column, name, k, loglik, params):
        if math.isfinite(loglik):
            rows.append(blank | {"column_name": column, "name": name, "params": params, "loglik": loglik, "aic": 2 * k - 2 * loglik, "chosen": False})

    for c in names:
        st = stats[c]
        n = st.n
        if not n or st.std_pop is None or not all(map(math.isfinite, (st.mean, st.std_pop, st.min, st.max))):
            continue
        if st.std_pop < CONSTANT_STD:
            rows.append(blank | {"column_name": c, "name": "constant", "params": {"value": st.min}})
            continue
        if "norm" in candidates:
            found(c, "norm", 2, -n / 2 * LN_2PI - n * math.log(st.std_pop) - n / 2, {"loc": st.mean, "scale": st.std_pop})
        if "expon" in candidates and st.mean > st.min:
            found(c, "expon", 2, -n * math.log(st.mean - st.min) - n, {"loc": st.min, "scale": st.mean - st.min})
        if "uniform" in candidates and st.max > st.min:
            found(c, "uniform", 2, -n * math.log(st.max - st.min), {"loc": st.min, "scale": st.max - st.min})
        searches += [Search(c, f, st.min, st.max) for f in _SEARCHED if f in candidates and st.max > st.min]
    if searches:
        _searches(profiler.keep_value_counts(), searches)
        for s in searches:
            if s.best is not None:
                found(s.column, s.family, 4 if s.family == "beta" else 3, stats[s.column].n * s.best[0], s.best[3])
    for c in names:
        own = [r for r in rows if r["column_name"] == c]
        if not own:
            rows.append(blank | {"column_name": c, "name": "empirical", "params": {}})
        elif own[0]["name"] != "constant":
            min(own, key=lambda r: (r["aic"], r["name"]))["chosen"] = True
    fitted = [r for r in rows if r["aic"] is not None]
    if ks and fitted:
        profiler.keep_value_counts()
        d = ks_statistics(profiler.cumulative_counts(), [(r["column_name"], r["name"], r["params"]) for r in fitted])
        for r in fitted:
            key = r["column_name"], r["name"]
            if key in d:
                r["ks_statistic"], r["ks_pvalue"] = d[key], cdf.ks_pvalue(stats[key[0]].n, d[key])
    return sorted(rows, key=lambda r: (names.index(r["column_name"]), r["name"]))


def _rounded(value, digits):
    return None if value is None else round(float(value), digits)


def fits_table(spark, rows: list[dict]) -> DataFrame:
    """The rows of ``fit_all`` as a table (bounded: columns x families), rounded as the profile rounds them."""
    schema = "column_name string, name string, params map<string,double>, aic double, ks_statistic double, ks_pvalue double, chosen boolean"
    data = [(r["column_name"], r["name"], {k: _rounded(v, 8) for k, v in r["params"].items()}, _rounded(r["aic"], 4), _rounded(r["ks_statistic"], 6),
             _rounded(r["ks_pvalue"], 6), r["chosen"]) for r in rows]
    return spark.createDataFrame(data, schema)
