"""Fits with free ends, distribution functions and Kolmogorov-Smirnov numbers against plain versions."""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from tabletwin.functions import cdf
from tabletwin.operators.fit import fit_column
from tabletwin.operators.fit_all import NEAREST, Search, beta_at, fit_all, gamma_at, lognorm_at
from tabletwin.operators.profile import Profiler


def log_density(name, p, x):
    z = (x - p["loc"]) / p["scale"]
    if name == "lognorm":
        return -np.log(z * p["s"] * p["scale"] * math.sqrt(2 * math.pi)) - np.log(z) ** 2 / (2 * p["s"] ** 2)
    if name == "gamma":
        return (p["a"] - 1) * np.log(z) - z - math.lgamma(p["a"]) - math.log(p["scale"])
    return (p["a"] - 1) * np.log(z) + (p["b"] - 1) * np.log1p(-z) + math.lgamma(p["a"] + p["b"]) - math.lgamma(p["a"]) - math.lgamma(p["b"]) - math.log(p["scale"])


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    n = 3000
    return pd.DataFrame({"g": 10 + rng.gamma(2.5, 3.0, n), "b": 5 + 4 * rng.beta(2, 3, n), "l": np.round(-3 + np.exp(rng.normal(1, 0.5, n)), 3),
                         "u": rng.uniform(0, 1, n), "c": np.ones(n), "e": [None] * n}).astype(float)


def test_fits_of_all_columns(spark, frame):
    rows = fit_all(Profiler(spark.createDataFrame(frame).repartition(3)))
    by = {(r["column_name"], r["name"]): r for r in rows}
    best = {r["column_name"]: r["name"] for r in rows if r["chosen"]}
    assert best == {"g": "gamma", "b": "beta", "l": "lognorm", "u": "uniform", "c": "constant", "e": "empirical"}
    assert len(rows) == 4 * 6 + 2
    for (c, name), r in by.items():
        if name not in ("lognorm", "gamma", "beta"):
            continue
        x, p = frame[c].to_numpy(), r["params"]
        own = log_density(name, p, x).sum()
        assert own == pytest.approx(r["loglik"], rel=1e-9, abs=1e-6)
        width = x.max() - x.min()
        for k in p:  # no neighbour within the guarded box is better
            for step in (-1e-3, 1e-3):
                q = dict(p, **{k: p[k] + step * (width if k == "loc" else p[k])})
                if q["loc"] <= x.min() - NEAREST * width and (name != "beta" or q["loc"] + q["scale"] >= x.max() + NEAREST * width):
                    assert log_density(name, q, x).sum() <= own + 2e-3, (c, name, k)
        # D and p-value of every family by a plain sorted sample
        f = cdf.cdf(name, p, np.sort(x))
        n = len(x)
        d = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())
        assert r["ks_statistic"] == pytest.approx(d, abs=1e-9)
        assert r["ks_pvalue"] == pytest.approx(cdf.ks_pvalue(n, d), abs=1e-9)
    one = fit_column(spark.createDataFrame(frame[["g"]]), "g", ("gamma", "norm"), ks=True)
    assert one["name"] == "gamma" and one["ks_pvalue"] > 0.05 and one["params"]["a"] == pytest.approx(by["g", "gamma"]["params"]["a"], rel=1e-4)


def test_jobs_do_not_grow_with_columns(spark, frame):
    def jobs(cols):
        spark.sparkContext.setJobGroup(f"fit-{len(cols)}", "fit")
        rows = fit_all(Profiler(spark.createDataFrame(frame[cols])), ("lognorm",), ks=False)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{len(cols)}")), rows

    (one, _), (three, rows) = jobs(["g"]), jobs(["g", "b", "l"])
    assert len(rows) == 3 and three <= one + 4 * 20 and three < 3 * one


@pytest.mark.parametrize("family", ["lognorm", "gamma", "beta"])
def test_gradient_and_curvature(frame, family):
    """Derivatives of the profile likelihood against differences."""
    x = frame["b"].to_numpy()
    search = Search("b", family, x.min(), x.max())
    at = np.array([math.log(0.7)] * (2 if family == "beta" else 1))

    def value(at):
        lo, hi = search.ends(at)
        y = x - lo
        m = {"u": np.log(y).mean(), "uu": (np.log(y) ** 2).mean(), "v": (1 / y).mean(), "vv": (1 / y**2).mean(), "uv": (np.log(y) / y).mean(), "uvv": (np.log(y) / y**2).mean(), "y": y.mean()}
        if hi is not None:
            z = hi - x
            m |= {"q": np.log(z).mean(), "r": (1 / z).mean(), "rr": (1 / z**2).mean()}
        return search.judged(at, m)

    _, grad, curve, _, _ = value(at)
    h = 1e-4
    for i in range(len(at)):
        e = np.zeros(len(at))
        e[i] = h
        up, down = value(at + e), value(at - e)
        assert grad[i] == pytest.approx((up[0] - down[0]) / (2 * h), rel=1e-4, abs=1e-7)
        assert curve[i] == pytest.approx((up[1] - down[1]) / (2 * h), rel=1e-3, abs=1e-6)


def test_a_family_without_shapes_has_no_fit():
    assert gamma_at({"y": 1.0, "u": 0.0, "v": 1.0, "vv": 1.0}) is None
    assert beta_at({"u": math.log(0.5), "q": math.log(0.5), "v": 2, "r": 2, "vv": 4, "rr": 4}, 1.0) is None
    assert lognorm_at({"u": 0.0, "uu": 1.0, "v": 1.0, "vv": 1.0, "uv": 0.0, "uvv": 0.0})[3]["s"] == 1.0


def integral(density, lo, hi, n=200_001):
    x = np.linspace(lo, hi, n)
    y = density(x)
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


def test_distribution_functions():
    for a in (0.5, 1.0, 2.5, 40.0, 3000.0):
        for q in (0.3, 0.9, 1.0, 1.2):
            x = a * q
            got = float(cdf.gamma_cdf(a, np.array([x]))[0])
            if a >= 1:
                want = integral(lambda t: np.exp((a - 1) * np.log(np.maximum(t, 1e-300)) - t - math.lgamma(a)), 0, x)
                assert got == pytest.approx(want, abs=2e-6)
    for z in (-3.0, -0.5, 0.0, 1e-9, 0.7, 4.0, 9.0):
        assert float(cdf.norm_cdf(np.array([z]))[0]) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-14)
    for a, b in ((1.0, 1.0), (2.0, 3.0), (30.0, 4.0), (500.0, 700.0)):
        for x in (0.1, 0.4, 0.7, 0.95):
            want = integral(lambda t: np.exp((a - 1) * np.log(np.maximum(t, 1e-300)) + (b - 1) * np.log1p(-t) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)), 0, x)
            assert float(cdf.beta_cdf(a, b, np.array([x]))[0]) == pytest.approx(want, abs=2e-6)
    assert cdf.gamma_cdf(2.0, np.array([-1.0, 0.0, np.inf])).tolist() == [0, 0, 1]
    assert cdf.beta_cdf(2.0, 2.0, np.array([-1.0, 0.0, 1.0, 2.0])).tolist() == [0, 0, 1, 1]


def exact_below(n, d):
    """P(D_n < d) by the recursion over the two boundaries in exact fractions."""
    upper = [min(Fraction(1), Fraction(j, n) + d) for j in range(n)]  # the (j+1)-th smallest stays below
    lower = [max(Fraction(0), Fraction(j + 1, n) - d) for j in range(n)]
    fact = [1]
    for i in range(1, n + 1):
        fact.append(fact[-1] * i)
    p = [Fraction(1)]
    for j in range(1, n + 1):
        total = Fraction(0)
        for i in range(j, 0, -1):
            gap = upper[i - 1] - lower[j - 1]
            if gap <= 0:
                break
            total += (-1) ** (j - i) * p[i - 1] * gap ** (j - i + 1) / fact[j - i + 1]
        p.append(total)
    return float(p[n] * fact[n])


def test_exact_p_values():
    for n, ds in ((1, ("0.6", "0.9")), (2, ("0.3", "0.55")), (5, ("0.15", "0.31", "0.6")), (20, ("0.1", "0.2", "0.35")), (77, ("0.05", "0.1", "0.16")), (200, ("0.03", "0.07"))):
        for d in ds:
            assert cdf.ks_pvalue(n, float(d)) == pytest.approx(1 - exact_below(n, Fraction(d)), abs=1e-6), (n, d)
    assert cdf.ks_pvalue(50, 0.0) == 1.0 and cdf.ks_pvalue(50, 1.0) == 0.0 and cdf.ks_pvalue(10_000, 0.5) < 1e-9
    # both sides of the switch to the asymptotic series agree closely
    assert cdf.ks_pvalue(10_000, 0.009) == pytest.approx(cdf.ks_pvalue(10_001, 0.009), abs=5e-3)
    assert 0.99 < cdf.ks_pvalue(20_000, 0.001) <= 1.0


def test_errors_of_single_columns(spark):
    from tabletwin.operators.profile import declared_numbers

    rows = [("1", 2.5, "x"), ("2", None, "7"), (None, float("nan"), None), ("3", 1.5, "y")]
    df = spark.createDataFrame(rows, "a string, b double, c string")
    got = {r.column_name: r for r in declared_numbers(df, {"a": "int", "b": "double", "c": "bigint", "d": "int"}).collect()}
    assert (got["a"].n, got["a"].min, got["a"].max, got["a"].mean, got["a"].error) == (3, 1, 3, 2, None)
    assert (got["b"].n, got["b"].mean, got["b"].error) == (2, 2.0, None)
    assert got["c"].n is None and got["c"].n_bad == 2 and got["c"].error == "2 values are not bigint, the first is x"
    assert got["d"].error == "no such column"
    empty = {r.column_name: r for r in declared_numbers(df.limit(0), {"a": "int", "c": "int"}).collect()}
    assert empty["a"].n == 0 and empty["c"].error is None


def test_trials_share_the_sums_of_their_ends(spark, monkeypatch):
    """39 first trials of a column have 14 ends between them; the numbers are those of plain sums."""
    from tabletwin.operators import fit_all as module

    x = np.array([1.0, 2.0, 4.0, 7.0, 7.5])
    n = np.array([3, 1, 2, 1, 5])
    searches = [Search("x", f, float(x.min()), float(x.max())) for f in ("lognorm", "gamma", "beta")]
    trials = [(i, "x", *s.ends(at)) for i, (s, at) in enumerate((s, at) for s in searches for at in s.trials)]
    counts = spark.createDataFrame([("x", float(v), int(k)) for v, k in zip(x, n)], "column_name string, value double, count long")
    made = []
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: (made.append(len(data)), create(self, data, *a, **k))[1])
    got = module.trial_sums(counts, trials)
    assert len(trials) == 39 and made == [14] and sorted(got) == list(range(39))
    mean = lambda v: float((v * n).sum() / n.sum())
    for i, _, lo, hi in trials:
        y = x - lo
        want = {"u": np.log(y), "uu": np.log(y) ** 2, "v": 1 / y, "vv": 1 / y**2, "uv": np.log(y) / y, "uvv": np.log(y) / y**2, "y": y}
        if hi is not None:
            want |= {"q": np.log(hi - x), "r": 1 / (hi - x), "rr": 1 / (hi - x) ** 2}
        for k, v in want.items():
            assert got[i][k] == pytest.approx(mean(v), rel=1e-12), (i, k)
        assert hi is not None or got[i]["q"] is None


def test_rows_are_not_read_again_after_a_fit(spark, frame):
    """Fits write the value counts once: what follows, and the KS numbers, read those."""
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    source = spark.createDataFrame(frame[["g"]])
    p = Profiler(source.mapInArrow(passed, source.schema))
    plain = Profiler(source).percentiles().collect()
    fit_all(p, ("norm", "lognorm"))
    # moments for the fit, the value counts, and two passes of the profile's moments
    assert read.value == 4 * len(frame)
    assert p.percentiles().collect() == plain and read.value == 4 * len(frame)


def test_gaps_are_looked_for_where_they_can_be(monkeypatch):
    from tabletwin.operators import fit_all as module

    rng = np.random.default_rng(1)
    asked = []
    whole = cdf.cdf
    for n, shift in ((1, 0.0), (7, 0.3), (64, 0.0), (65, 0.0), (20_000, 0.05), (20_000, 0.0)):
        x = np.unique(np.round(rng.normal(shift, 1, n), 4))
        c = rng.integers(1, 5, len(x))
        hi = np.cumsum(c) / c.sum()
        lo = hi - c / c.sum()
        for name, params in (("norm", {"loc": 0.0, "scale": 1.0}), ("uniform", {"loc": -2.0, "scale": 3.0}), ("gamma", {"a": 30.0, "loc": -6.0, "scale": 0.2})):
            f = whole(name, params, x)
            want = max(float((hi - f).max()), float((f - lo).max()))
            order = rng.permutation(len(x))
            monkeypatch.setattr(cdf, "cdf", lambda *a: (asked.append(len(a[2])), whole(*a))[1])
            asked.clear()
            got = module.largest_gap(name, params, x[order], lo[order], hi[order])
            assert got == pytest.approx(want, abs=1e-12), (n, name)
            if n == 20_000 and name == "uniform":
                assert sum(asked) < len(x) / 4
            assert module.largest_gap(name, params, x[order], lo[order], hi[order], 0.999) == 0.999 or want > 0.999
            monkeypatch.setattr(cdf, "cdf", whole)
