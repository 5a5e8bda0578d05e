"""Tables for many requests at once: counts, bounds, odd plans, and rows that depend on their own request alone."""

import pytest
from pyspark.sql import functions as F

from tabletwin.functions import requests as R
from tabletwin.operators import synth as SY
from tabletwin.operators import synth_many as SM
from tabletwin.plans.request_plans import MAPPING
from tabletwin.plans.tables import policies

SF = "/root/testdata/sf0.001"
TEXTS = ["500 rows 50% M3, 30% M4, 20% M1", "300 rows 100 M3 rest equally", "50 rows 100 M3", "0 rows", "only M4 200 rows", "200 rows 30 M77 rest M5",
         "400 rows vehicle age 1-2 10% claim rate", "100 rows region c2 age 40-45", "100 rows vehicle age 900-950", "150 rows segment utility diesel no M5",
         "100 rows region c99", "120 rows 40 M3 no M5 rest M5"]


@pytest.fixture(scope="module")
def bp(spark):
    return SY.Blueprint(policies(spark, SF).checkpoint(), key="model", row_key="policy_id", label_col="claim_status", id_col="policy_id",
                        fitted=["customer_age"], empirical={"vehicle_age": None}, sampled={"region_code": ["region_density"]},
                        fit_candidates=("norm",), determined=["segment", "fuel_type", "is_esc", "ncap_rating", "transmission_type", "steering_type", "rear_brakes_type"])


def parsed(spark, texts=TEXTS, first=0):
    return R.parse_requests(spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "request_id long, prompt string"))


@pytest.fixture(scope="module")
def made(spark, bp):
    rows = SM.generate_many(parsed(spark), bp, MAPPING, 7).collect()
    return {i: [r for r in rows if r.request_id == i] for i in range(len(TEXTS))}


def per_key(rows):
    out = {}
    for r in rows:
        out[r.model] = out.get(r.model, 0) + 1
    return out


def test_counts_and_bounds(made, bp):
    keys = [k for k, _ in bp.key_pool]
    assert [len(made[i]) for i in range(len(TEXTS))] == [500, 300, 50, 0, 200, 200, 400, 100, 100, 150, 100, 120]
    assert all(sorted(r.id for r in rows) == list(range(len(rows))) for rows in made.values())
    assert per_key(made[0]) == {"M3": 250, "M4": 150, "M1": 100}
    rest = per_key(made[1])
    assert rest.pop("M3") == 100 and max(rest.values()) - min(rest.values()) <= 1 and set(rest) == set(keys) - {"M3"}
    assert per_key(made[2]) == {"M3": 50} and per_key(made[4]) == {"M4": 200} and per_key(made[5]) == {"M5": 200}
    assert sum(r.claim_status for r in made[6]) == 40 and all(0.9 <= r.vehicle_age <= 2.1 for r in made[6])
    assert all(r.region_code == "C2" and 40 <= r.customer_age <= 45 for r in made[7])
    assert {r.region_code for r in made[10]} == {"C99"} and all(r.region_density is None for r in made[10])
    got = per_key(made[11])
    assert got["M3"] == 40 and "M5" not in got


def test_an_empty_range_gives_its_lower_end(made, bp):
    top = bp.stats["vehicle_age"]["max"]
    assert all(r.vehicle_age == top for r in made[8])  # 900 and its jitter, cut at the column's maximum


def test_filters(made, bp):
    look = {r.model: r for r in bp.lookup.collect()}
    pass_ = {k for k, _ in bp.key_pool if look[k].segment == "Utility" and look[k].fuel_type == "Diesel" and k != "M5"}
    assert set(per_key(made[9])) <= (pass_ or {k for k, _ in bp.key_pool})


def test_rows_depend_on_their_request_alone(spark, bp, made, monkeypatch):
    monkeypatch.setattr(SM, "BLOCK_ROWS", 64)
    monkeypatch.setattr(SM, "RANK_PART", 37)
    monkeypatch.setattr(SM, "BROADCAST_PLANS", 0)
    alone = SM.generate_many(parsed(spark, TEXTS[1:2], 1), bp, MAPPING, 7).collect()
    assert sorted(map(repr, alone)) == sorted(map(repr, made[1]))


def test_repeated_ids_are_an_error_and_no_requests_give_no_rows(spark, bp):
    twice = parsed(spark, TEXTS[:1]).unionByName(parsed(spark, TEXTS[1:2]))
    with pytest.raises(ValueError, match="unique"):
        SM.generate_many(twice, bp, MAPPING)
    assert SM.generate_many(parsed(spark).limit(0), bp, MAPPING).count() == 0


def test_rows_of_ordinary_requests_are_not_shuffled_and_plans_not_broadcast(spark, bp, monkeypatch):
    p = spark.createDataFrame([(i, 40, 10) for i in range(50)], "request_id long, _n long, _labels long")
    plan = lambda: SM._ranked_rows(p, 7, {"_rank": "alloc", "_lab": "label"})._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(SM, "BROADCAST_PLANS", 0)
    # plans are dealt once for the rows and once for the join; two windows and the join need no more
    assert plan().count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan()
    monkeypatch.setattr(SM, "RANK_PART", 30)
    assert "Broadcast" not in plan().split("SortMergeJoin")[0]
    rows = SM._ranked_rows(p, 7, {"_rank": "alloc"}).collect()
    monkeypatch.setattr(SM, "RANK_PART", 40)
    assert sorted(SM._ranked_rows(p, 7, {"_rank": "alloc"}).select("request_id", "id", "_rank").collect()) == sorted((r.request_id, r.id, r._rank) for r in rows)


def test_requests_of_one_file_are_parsed_by_many_tasks(spark):
    d = parsed(spark, ["500 rows"] * 400)
    sizes = d.rdd.glom().map(len).collect()
    assert len(sizes) == 8 * spark.sparkContext.defaultParallelism and max(sizes) <= 30
