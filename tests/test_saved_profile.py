"""The saved profile: fits of all six families and top values, as the query and its oracle see the same small tables."""

import math
import random

import duckdb
import pytest

from tabletwin.plans.catalog import ORACLE, QUERIES

FITTED = ("dist_a", "dist_b", "dist_s", "dist_loc", "dist_scale", "aic", "ks_statistic", "ks_pvalue")


def _tables(spark, path, regions, balance):
    rng = random.Random(9)
    names = ["north", "south", "east", "west", "centre", "isles"]
    tables = {
        "region": ([(i, names[i]) for i in range(6)], "r_regionkey int, r_name string"),
        "nation": ([(i, f"n{i}", regions[i % len(regions)]) for i in range(12)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, f"c{i % 150}" if i % 7 else None, rng.choice([0, 0, 0, 1, 5, 10, 11, 11, 11, 11]), balance(rng) if i % 9 else None, rng.choice(["Yes", "No"])) for i in range(400)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("regions,balance,best", [
    ([3], lambda rng: round(rng.gammavariate(1.5, 200), 2), {"c_acctbal": {"gamma"}, "n_regionkey": {"constant"}}),
    ([0, 5], lambda rng: round(math.exp(rng.gauss(2, 0.7)), 3), {"c_acctbal": {"lognorm"}, "n_regionkey": {"beta"}, "c_nationkey": {"beta"}}),
])
def test_saved_profile_has_every_step(spark, tmp_path, regions, balance, best):
    con = _tables(spark, tmp_path, regions, balance)
    got = {r["column_name"]: r.asDict() for r in QUERIES["profile_roundtrip"](spark, str(tmp_path)).collect()}
    found = con.execute(ORACLE["profile_roundtrip"])
    names = [d[0] for d in found.description]
    want = {r["column_name"]: r for r in (dict(zip(names, x)) for x in found.fetchall())}
    assert got.keys() == want.keys() and set(names) == set(got["c_name"])
    for c, row in want.items():
        for k, v in row.items():
            same = got[c][k] == v or k in FITTED and v is not None and got[c][k] == pytest.approx(v, rel=2e-3, abs=2e-4)
            assert same or isinstance(v, float) and got[c][k] == pytest.approx(v, abs=2e-6), (c, k, got[c][k], v)
    for c, names in best.items():
        assert got[c]["dist_name"] in names, (c, got[c]["dist_name"])
    for c in ("c_custkey", "c_acctbal"):
        assert got[c]["aic"] is not None and 0 <= got[c]["ks_pvalue"] <= 1
    rows = [(r["c_name"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/customer.parquet").where("c_name is not null").groupBy("c_name").count().withColumnRenamed("count", "n").collect()]
    top = sorted(rows, key=lambda r: (-r[1], r[0]))[:100]
    assert len(rows) > 100 and list(zip(got["c_name"]["values"], got["c_name"]["value_counts"])) == top
    assert got["c_name"]["value_frequencies"] == [round(n / sum(n for _, n in rows), 6) for _, n in top]
