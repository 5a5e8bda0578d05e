"""Saved stages: skipped when done, run again when an input changes or an attempt broke; tables made from them alone."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tabletwin.operators import synth as SY
from tabletwin.plans import synth_plans as SP
from tabletwin.sources import stages as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture
def source(tmp_path, spark):
    path = str(tmp_path / "source")
    spark.range(0, 100, 1, 3).write.parquet(path)
    return path


def test_stage_runs_once_and_again_after_a_change(spark, tmp_path, source):
    built = []

    def build():
        built.append(1)
        df = spark.read.parquet(source)
        return {"total": df.agg(F.sum("id").alias("s")), "rows": df}, {"n": len(built)}

    run = lambda **params: ST.run_stage(spark, str(tmp_path / "stages"), "sums", [source], params, build)
    first, again = run(a=1), run(a=1)
    assert (first.reused, again.reused, len(built)) == (False, True, 1)
    assert again.meta == {"n": 1} and again.table("total").first().s == 4950 and again.table("rows").count() == 100
    assert not run(a=2).reused and len(built) == 2  # another parameter
    spark.range(100, 101, 1, 1).write.mode("append").parquet(source)
    changed = run(a=1)
    assert not changed.reused and changed.table("total").first().s == 5050


def test_half_written_attempts_are_not_seen(spark, tmp_path, source):
    root = str(tmp_path / "stages")

    def breaks():
        df = spark.read.parquet(source)
        return {"good": df, "bad": df.select(F.raise_error(F.lit("lost")).alias("x"))}, {}

    with pytest.raises(Exception, match="lost"):
        ST.run_stage(spark, root, "s", [source], {}, breaks)
    done = ST.run_stage(spark, root, "s", [source], {}, lambda: ({"good": spark.range(7)}, {}))
    assert not done.reused and done.table("good").count() == 7
    assert ST.run_stage(spark, root, "s", [source], {}, breaks).reused


def test_first_writer_counts(spark, tmp_path, source):
    root = str(tmp_path / "stages")

    def slow():
        ST.run_stage(spark, root, "s", [source], {}, lambda: ({"t": spark.range(1)}, {"by": "quick"}))
        return {"t": spark.range(2)}, {"by": "slow"}

    got = ST.run_stage(spark, root, "s", [source], {}, slow)
    assert got.meta == {"by": "quick"} and got.table("t").count() == 1


def test_bad_markers_and_paths_are_errors(spark, tmp_path, source):
    root = str(tmp_path / "stages")
    done = ST.run_stage(spark, root, "s", [source], {}, lambda: ({"t": spark.range(1)}, {}))
    with open(os.path.join(done.folder, ST.MARKER), "w") as f:
        f.write("{")
    os.path.exists(crc := os.path.join(done.folder, f".{ST.MARKER}.crc")) and os.remove(crc)
    with pytest.raises(ValueError, match="unreadable marker"):
        ST.run_stage(spark, root, "s", [source], {}, lambda: ({}, {}))
    with pytest.raises(Exception):
        ST.fingerprint(spark, [str(tmp_path / "none")])


def test_tables_from_artifacts_do_not_read_the_real_table(spark, tmp_path):
    sf = str(tmp_path / "sf")
    os.makedirs(sf)
    for t in SP.STAGE_INPUTS:
        shutil.copy(f"{SF}/{t}.parquet", sf)
    saved = SP.learned(spark, sf, str(tmp_path / "stages"))
    n = saved.meta["n_rows"]
    want = sorted(map(repr, SP._generated(spark, SP.blueprint(spark, sf, fitted=tuple(SP.FITTED)), n).collect()))
    shutil.move(sf, str(tmp_path / "gone"))
    made = SP._generated(spark, SY.SavedBlueprint(saved), n)
    assert all("/stages/" in f for f in made.inputFiles())
    assert sorted(map(repr, made.collect())) == want and len(want) == n


def test_wide_pools_share_out_equally(spark, monkeypatch):
    real = spark.range(0, 3000, 1, 4).select(F.expr("cast(cast(sqrt(id) * 7 as int) as string)").alias("k"), "id")
    bp = SY.Blueprint(real, key="k", row_key="id", determined=[])
    n = 5003
    plan = SY.Plan(n_rows=n, allocations=[SY.Allocation("7", "count", 100)], rest="equal", exclude=["12"])
    ids = spark.range(0, n, 1, 4)
    rows = lambda: sorted(map(tuple, SY.assign_keys(ids, bp, plan, 5, n).collect()))
    want = rows()
    monkeypatch.setattr(SY, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(SY, "POOL_ROWS", 10)
    assert rows() == want and [i for i, _ in want] == list(range(n))
    per = {}
    for _, k in want:
        per[k] = per.get(k, 0) + 1
    assert per.pop("7") == 100 and "12" not in per
    keys = [k for k, _ in sorted(real.groupBy("k").count().collect(), key=lambda r: (-r[1], r[0])) if k not in ("7", "12")]
    share, more = divmod(n - 100, len(keys))
    assert [per[k] for k in keys] == [share + (i < more) for i in range(len(keys))]
    # fewer rows than keys: the first keys in pool order get one each
    few = SY.Plan(n_rows=20, allocations=[SY.Allocation("7", "count", 5)], rest="equal")
    got = SY.assign_keys(spark.range(20), bp, few, 5, 20)
    assert {r.k for r in got.where("k <> '7'").collect()} == set([k for k, _ in sorted(real.groupBy("k").count().collect(), key=lambda r: (-r[1], r[0])) if k != "7"][:15])


def test_all_keys_excluded_means_none_is(spark):
    real = spark.createDataFrame([("a", 1), ("b", 2)], "k string, id long")
    bp = SY.Blueprint(real, key="k", row_key="id", determined=[])
    plan = SY.Plan(n_rows=10, allocations=[SY.Allocation("a", "count", 4)], exclude=["a", "b"], rest="equal")
    assert sorted(r.k for r in SY.assign_keys(spark.range(10), bp, plan, 1, 10).collect()) == ["a"] * 4 + ["b"] * 6
