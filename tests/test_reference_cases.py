"""Checks carried over from the reference's tests, as properties of our operators (FIXTURES.md)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabletwin.functions import requests as R
from tabletwin.operators import contract as CT
from tabletwin.operators import fd as FD
from tabletwin.operators import synth as SY
from tabletwin.operators.compare import histogram
from tabletwin.operators.profile import Profiler
from tabletwin.operators.rank import exact_sample, global_rank, buckets_for
from tabletwin.functions.rng import uniform


@pytest.fixture(scope="module")
def claims(spark):
    """Insurance-style rows that Spark derives from customer, nation and orders."""
    from tabletwin.plans.tables import policies

    cols = ["policy_id", "subscription_length", "customer_age", "model", "segment", "fuel_type", "airbags", "is_esc", "displacement", "claim_status"]
    return policies(spark, "/root/testdata/sf0.001").select(cols).cache()


def test_profile_shape_and_types(claims):
    p = Profiler(claims)
    meta = p.meta().first()
    assert (meta["n_rows"], meta["n_columns"]) == (claims.count(), 10)
    cat = {r["column_name"]: r for r in p.categorical().collect()}
    assert cat["model"]["cardinality"] == claims.select("model").distinct().count()
    assert cat["is_esc"]["is_binary"] is True
    assert cat["model"]["is_binary"] is False
    base = {r["column_name"]: r for r in p.base().collect()}
    assert base["model"]["type"] == "categorical" and base["customer_age"]["type"] == "numerical"
    # an int 0/1 label is numerical, so not flagged binary (the reference's rule)
    assert "claim_status" not in cat


def test_profile_matches_pandas(claims):
    pdf = claims.toPandas()
    num = {r["column_name"]: r for r in Profiler(claims).numeric().collect()}
    for c in ["subscription_length", "customer_age", "displacement"]:
        s = pdf[c].astype(float)
        assert num[c]["mean"] == pytest.approx(s.mean())
        assert num[c]["std"] == pytest.approx(s.std())
        assert num[c]["skewness"] == pytest.approx(s.skew(), abs=1e-9)
        assert num[c]["kurtosis"] == pytest.approx(s.kurt(), abs=1e-9)
        assert num[c]["median"] == pytest.approx(s.median())
    pct = {r["column_name"]: r for r in Profiler(claims).percentiles().collect()}
    for p in [1, 5, 10, 25, 50, 75, 90, 95, 99]:
        assert pct["customer_age"][f"p{p}"] == pytest.approx(round(np.percentile(pdf["customer_age"], p), 6))


def test_fd_expectations(claims):
    fds = FD.discover(claims, threshold=0.95)
    exact = {(tuple(r["lhs"]), r["rhs"]) for r in fds.where("kind = 'exact'").collect()}
    assert (("model",), "segment") in exact
    assert (("model",), "fuel_type") in exact
    assert (("is_esc",), "customer_age") not in exact
    cand = {r["column_name"]: r["is_candidate"] for r in FD.candidate_table(claims).collect()}
    assert cand["policy_id"] is False


def test_fd_confidence_equals_pandas(claims):
    pdf = claims.toPandas()
    cands = ["model", "segment", "airbags", "is_esc"]
    got = {(r["lhs"][0], r["rhs"]): r["confidence"] for r in FD.confidences(claims, cands).collect()}
    for (l, rhs), c in got.items():
        g = pdf.groupby(l)[rhs].nunique()
        assert c == pytest.approx((g == 1).sum() / len(g))


def test_contract_accepts_source_and_flags_faults(spark, claims):
    contract = CT.learn(claims)
    assert CT.check(claims, contract, "policy_id").count() == 0
    bad = claims.withColumn("customer_age", F.when(F.col("policy_id") == "POL000007", F.lit(999)).otherwise(F.col("customer_age")))
    v = CT.check(bad, contract, "policy_id").collect()
    assert [(r["column_name"], r["row_key"]) for r in v] == [("customer_age", "POL000007")]
    bad2 = claims.withColumn("model", F.when(F.col("policy_id") == "POL000003", F.lit("M99")).otherwise(F.col("model")))
    v2 = CT.check(bad2, contract, "policy_id").collect()
    assert [(r["column_name"], r["check_name"], r["failure_case"]) for r in v2] == [("model", "isin", "M99")]


def test_contract_roundtrip(spark, claims, tmp_path):
    c = CT.learn(claims)
    CT.save(c, str(tmp_path / "c"))
    back = CT.load(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, c.collect()))


@pytest.mark.parametrize("rate", [0.02, 0.06, 0.10, 0.15])
@pytest.mark.parametrize("n", [456, 1000, 100])
def test_exact_label_rate(spark, rate, n):
    """exactly round-half-even(n * rate) ones."""
    ids = spark.range(n)
    r = global_rank(ids, uniform(7, "label", "id"), "id", buckets_for(n), "rk")
    k = SY.label_count(n, rate)
    assert r.where(F.col("rk") < k).count() == round(n * rate)


def test_rank_is_permutation_and_sample_exact(spark):
    n = 5000
    ranks = [r["rk"] for r in global_rank(spark.range(n), uniform(1, "x", "id"), "id", 16, "rk").collect()]
    assert sorted(ranks) == list(range(n))
    s = exact_sample(spark.range(n).withColumn("k", F.col("id").cast("string")), 777, key="k")
    assert s.count() == 777


# Request texts and the fields they must give.
PROMPTS = [
    ("1000 rows 50% M3, 30% M4, 20% M1", {"n_rows": 1000, "allocation": "M3:percent:50.0,M4:percent:30.0,M1:percent:20.0"}),
    ("1100 rows 100 M3 rest equally", {"n_rows": 1100, "allocation": "M3:count:100", "rest": "equal"}),
    ("50 rows 100 M3", {"n_rows": 50, "allocation": "M3:count:100"}),
    ("M3=200 M4:300", {"allocation": "M3:count:200,M4:count:300"}),
    ("1000 rows petrol or diesel", {"fuel_types": "Diesel,Petrol"}),
    ("utility vehicles 200 rows", {"segment": "Utility", "n_rows": 200}),
    ("without esc 500 rows", {"safety_off": "is_esc"}),
    ("ncap 4+ vehicles 500 rows", {"ncap_min": 4}),
    ("middle aged drivers 500 rows", {"age_min": 35, "age_max": 50}),
    ("2.5k rows petrol", {"n_rows": 2500, "fuel_types": "Petrol"}),
    ("500 rows no claims", {"claim_rate": 0.0}),
    ("generate 456 rows data with 2% claim rate", {"n_rows": 456, "claim_rate": 0.02}),
    ("only M3 1000 rows", {"allocation": "M3:exclusive", "n_rows": 1000}),
    ("5k rows no M5 no M7", {"exclude": "M5,M7", "n_rows": 5000}),
    ("young drivers high risk 500 rows", {"age_min": 18, "age_max": 35, "claim_rate": 0.15}),
    ("senior drivers petrol 8% claim rate", {"age_min": 55, "age_max": 75, "claim_rate": 0.08}),
    ("2000 rows automatic with parking camera", {"transmission_type": "Automatic", "safety_on": "is_parking_camera"}),
    ("1k rows segment B2 disc brakes", {"n_rows": 1000, "segment": "B2", "rear_brakes_type": "Disc"}),
    ("3000 rows new cars low risk", {"vehicle_age_min": 0, "vehicle_age_max": 2, "claim_rate": 0.02}),
    ("1000 rows petrol or diesel age 40-60", {"age_min": 40, "age_max": 60}),
    ("500 rows 500 M3", {"allocation": None, "model": "M3"}),   # Q3 kept: the count equals the row count
    ("vehicle age 3-7", {"vehicle_age_min": 3, "vehicle_age_max": 7, "age_min": None}),   # Q4 mended
    ("old cars 100 rows", {"vehicle_age_min": 8, "age_min": None}),                        # Q5 mended
    ("manual steering", {"steering_type": "Manual", "transmission_type": None}),          # Q6 mended
    ("", {"n_rows": None, "allocation": None, "description": "Default settings"}),
]


def test_request_prompts(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PROMPTS)], "request_id bigint, prompt string")
    got = {r["request_id"]: r.asDict() for r in R.parse_requests(df).collect()}
    for i, (_, want) in enumerate(PROMPTS):
        for k, v in want.items():
            assert got[i][k] == (pytest.approx(v) if isinstance(v, float) else v), (PROMPTS[i][0], k, got[i][k])


def test_histogram_constant_and_counts(spark):
    df = spark.createDataFrame([(5.0,)] * 10 + [(None,)], "x double")
    h = {r["bin"]: r["count"] for r in histogram(df, ["x"], 15).collect()}
    assert h[8] == 10 and sum(h.values()) == 10 and len(h) == 15
    pdf = pd.DataFrame({"x": np.random.default_rng(3).normal(size=500)})
    h2 = [r["count"] for r in histogram(spark.createDataFrame(pdf), ["x"], 20).orderBy("bin").collect()]
    assert h2 == pd.cut(pdf["x"], bins=20).value_counts().sort_index().tolist()


def test_all_null_column_profile(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a bigint, b double")
    num = {r["column_name"]: r for r in Profiler(df).numeric().collect()}
    assert num["b"]["n"] == 0 and num["b"]["mean"] is None


def test_fit_fallbacks_and_families(spark):
    from tabletwin.operators.fit import fit_column
    const = spark.createDataFrame([(3.0,)] * 20, "x double")
    assert fit_column(const, "x")["name"] == "constant"
    empty = spark.createDataFrame([(None,)] * 3, "x double")
    assert fit_column(empty, "x")["name"] == "empirical"  # FT11: nothing to fit
    rng = np.random.default_rng(0)
    g = spark.createDataFrame(pd.DataFrame({"x": 10 + rng.gamma(2.5, 3.0, 4000)}))
    f = fit_column(g, "x", ("gamma", "norm", "uniform"))
    assert f["name"] == "gamma" and f["params"]["a"] == pytest.approx(2.5, rel=0.2)


def test_gamma_beta_draws_follow_the_fit(spark):
    from tabletwin.plans.synth_plans import synth_numeric_gamma_beta
    from conftest import SF_MID
    from tabletwin.operators.fit import fit_column
    from tabletwin.plans.tables import table
    d = synth_numeric_gamma_beta(spark, SF_MID)
    got = {r["family"]: r for r in d.groupBy("family").agg(F.avg("x").alias("m"), F.count("*").alias("n")).collect()}
    ev = table(spark, SF_MID, "events")
    f = fit_column(ev, "value", ("gamma",))["params"]
    assert got["gamma"]["n"] == ev.count()
    assert got["gamma"]["m"] == pytest.approx(f["loc"] + f["a"] * f["scale"], rel=0.05)
