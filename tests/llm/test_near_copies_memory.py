"""What a task of the near-copy join holds, and how many files its steps write."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabletwin.llm import components, jaccard, tokens


class Sent(Exception):
    pass


def _work(monkeypatch, name, *args):
    """The function that ``name`` gives to the tasks."""
    def map_arrow(df, work, schema):
        raise Sent(work)

    monkeypatch.setattr(jaccard, "map_arrow", map_arrow)
    with pytest.raises(Sent) as sent:
        getattr(jaccard, name)(*args)
    return sent.value.args[0]


def _texts():
    rng = np.random.default_rng(5)
    vocabulary = np.array(["w%d" % i for i in range(4000)])
    return [" ".join(rng.choice(vocabulary, 400)) for _ in range(1500)]


def test_frequent_shingles_are_counted_in_bounded_memory(monkeypatch):
    texts = _texts()
    texts += texts[:400]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    monkeypatch.setattr(tokens, "_powers", {base: np.ones(1, np.uint64) for base in tokens._powers})
    monkeypatch.setattr(jaccard, "COUNT_AT_ONCE", 1 << 20)
    work = _work(monkeypatch, "frequent_shingles", None)
    tracemalloc.start()
    found = list(work([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 << 20, peak
    sets, _ = jaccard.shingle_sets(*tokens.text_buffer(batch.column(1)))
    plain = {h: n for h, n in Counter(sets.view(np.int64).tolist()).items() if n >= jaccard.SEEN_LEAST}
    assert len(plain) > 100_000 and dict(zip(*(found[0].column(i).to_pylist() for i in (0, 1)))) == plain and len(found) == 1


def test_keys_seen_often():
    for least in (1, 2, 3):
        for keys in ([], [4], [4, 4], [9, 4, 4, 2**64 - 1, 9, 9, 9, 1], [7] * 5, [3, 1, 2]):
            before, jaccard.SEEN_LEAST = jaccard.SEEN_LEAST, least
            try:
                out = jaccard._seen_often(np.array(keys, np.uint64))
            finally:
                jaccard.SEEN_LEAST = before
            want = {np.uint64(k).astype(np.int64).item(): n for k, n in Counter(keys).items() if n >= least}
            assert dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())) == want, (least, keys)


def test_steps_of_components_write_few_files(spark, monkeypatch):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 10] + [(5, 5), (305, 2)], "a long, b long")
    files = []

    def written(df, name):
        out = written_to(df, name)
        files.append(len(out.inputFiles()))
        return out

    written_to = components.written
    monkeypatch.setattr(components, "written", written)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "101")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = {r.node: r.component for r in components.components(edges).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = {i: 1 + i // 10 * 10 if i % 10 else i - 9 for i in range(1, 301)}
    assert found == want | {305: 1}
    assert max(files[1:]) <= 4 * spark.sparkContext.defaultParallelism < files[0], files
