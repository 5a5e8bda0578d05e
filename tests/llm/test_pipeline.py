"""The pipeline, stage by stage, against plain versions on the small driver table."""

import corpus_pipeline as P
from tabletwin.llm import quality
from tabletwin.llm.store import source_table, written
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_and_columns(spark):
    docs = source_table(spark, SF, "documents")
    labels = source_table(spark, SF, "labels")
    seen = {}
    for name, stage in P.STAGES:
        seen[name] = docs
        docs = written(stage(spark, docs, SF), name)
        if name != P.STAGES[-1][0]:
            assert docs.columns == seen[name].columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    start = seen["quality"]
    verdict = quality.score(start, quality.fit(start, labels))
    assert ids(seen["near_copies"]) == {r.doc_id for r in verdict.where("kept").collect()}
    near = brute.jaccard_rows([(r.doc_id, r.text) for r in seen["near_copies"].collect()])
    assert ids(seen["decontamination"]) == {d for d, (_, c) in near.items() if c == d}
    items = [brute.words(r.text) for r in source_table(spark, SF, "benchmark").collect()]
    grams = {tuple(w[i:i + 13]) for w in items for i in range(len(w) - 12)}
    for r in seen["mixing"].collect():
        w = brute.words(r.text)
        assert not any(tuple(w[i:i + 13]) in grams for i in range(len(w) - 12))
    assert ids(docs) == ids(seen["sharding"]) and docs.count() == seen["sharding"].count()
    assert docs.where("shard < 0 or shard >= 24 or shard is null").count() == 0
