"""The pipeline's stages on awkward rows and empty tables, and sharding against a plain version in Python."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tabletwin.llm import sharding
from tabletwin.llm.store import written
from tests.llm import brute, data

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["_text", "_source", "_doc_id", "_bin", "_passes", "kept", "component_id"]


def awkward(spark):
    rows = data.corpus(seed=5, n=30)
    long = " ".join(f"w{i}" for i in range(60_000))
    rows += [rows[2], rows[2], (None, rows[4][1], None, None, None), (None, None, None, None, None), (9_001, long, "en", "a", len(long)), (9_002, "", "en", None, 0), (9_003, None, None, "a", None)]
    d = spark.createDataFrame([r[:5] for r in rows], SCHEMA)
    for c in EXTRA:
        d = d.withColumn(c, F.concat(F.lit(c + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return d


def test_awkward_rows_through_all_stages(spark):
    docs = written(awkward(spark), "awkward")
    seen = [docs]
    for name, stage in P.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), name))
    for before, after in zip(seen, seen[1:-1]):
        assert after.columns == before.columns
    assert seen[-1].columns == docs.columns + ["shard"]
    rows = [df.collect() for df in seen]
    assert all(any(r.doc_id == i for r in some) for some in rows[:2] for i in (2, None)) and rows[-1]
    for before, after in zip(rows, rows[1:]):
        assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
    for r in rows[-1]:
        assert all(r[c] == f"{c}:{'none' if r.doc_id is None else r.doc_id}" for c in EXTRA)
    # one row of each group of near copies, rows without an id as they were
    near = brute.jaccard_rows([(r.doc_id, r.text) for r in {(r.doc_id, r.text): r for r in rows[1] if r.doc_id is not None}.values()])
    assert sorted(r.doc_id for r in rows[2] if r.doc_id is not None) == sorted(d for d, (_, c) in near.items() if c == d)
    assert sum(r.doc_id is None for r in rows[2]) == sum(r.doc_id is None for r in rows[1])
    assert {r.doc_id: r.shard for r in rows[-1]} == {r.doc_id: plain_shard(r.doc_id, P.SHARDS) for r in rows[-1]}


@pytest.mark.parametrize("at", range(len(P.STAGES)))
def test_empty_table(spark, at):
    docs = awkward(spark).limit(0)
    out = P.STAGES[at][1](spark, docs, SF)
    assert out.count() == 0 and out.columns[:len(docs.columns)] == docs.columns


def cost(key, shard, weight):
    digits = hashlib.md5(f"{key}|{shard}".encode()).hexdigest()[:13]
    return -math.log((int(digits, 16) + 0.5) / 2**52) / weight


def plain_shard(doc_id, shards, weights=None):
    key = "null" if doc_id is None else f"k{doc_id}"
    weights = weights or [1.0] * shards
    return min(range(shards), key=lambda s: (cost(key, s, weights[s]), s))


def test_sharding_equals_a_plain_version(spark):
    rows = [(i, None if i % 9 == 0 else f"text {i % 50} é") for i in range(500)] + [(None, "x"), (None, "y"), (3, "again"), (-7, "")]
    weights = [1.0, 2.0, 0.5, 3.0, 1.0]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), weights).collect()
    full = lambda d: (plain_shard(d, 5, weights), plain_shard(d, 6, [*weights, 1.0]))
    want = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), *full(d)) for d, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 5) for r in got)
