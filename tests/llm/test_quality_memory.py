"""What a task of the quality classifier holds and is sent."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabletwin.llm import quality, tokens


def test_words_are_made_of_a_bounded_piece_of_text(monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = np.array(["w%d" % i for i in range(3000)])
    texts = [" ".join(rng.choice(vocabulary, 400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * 1500, "source": [None] * 1500, "n_chars": [len(t) for t in texts]})
    assert len("".join(texts)) > 2 << 20

    def rows():
        return [(row.tolist(), code.tolist(), extra, meta) for row, code, extra, meta in quality._pool_features([batch])]

    monkeypatch.setattr(tokens, "_powers", {base: np.ones(1, np.uint64) for base in tokens._powers})
    tracemalloc.start()
    for _ in quality._pool_features([batch]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20, peak
    # the pieces do not matter for the numbers
    small = rows()
    monkeypatch.setattr(quality, "SLICE_BYTES", 64 << 20)
    whole = rows()
    assert len(whole) == 1 < len(small)
    assert sum((c for _, c, _, _ in small), []) == whole[0][1]
    for i in (2, 3):
        assert (np.concatenate([s[i] for s in small]) == whole[0][i]).all()


def test_texts_go_to_the_tasks_once(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "x", 5), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    sent = []
    map_arrow = quality.map_arrow
    try:
        quality.map_arrow = lambda df, work, schema: (sent.append(df.columns), map_arrow(df, work, schema))[1]
        kept = quality.keep_good(docs, labels)
    finally:
        quality.map_arrow = map_arrow
    # n_chars has another type and is sent beside itself
    assert sent[-1] == ["doc_id", "text", "lang", "source", "n_chars", "_n_chars"]
    assert kept.columns == docs.columns and kept.schema == docs.schema
    same = quality.keep_good(docs.withColumn("n_chars", F.col("n_chars").cast("long")), labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in same.collect())
