"""The classifier's exchange over all unlabelled documents."""

import random

import numpy as np
from pyspark.sql import functions as F

from tabletwin.llm import quality
from tests.llm.data import sentence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_word_of_unlabelled_documents_only_reaches_the_content_view(spark):
    """Good and bad differ in layout and source; one word is found only in bad unlabelled documents beyond the 2,000 of
    least hash, which were all that the exchange once saw."""
    rng = random.Random(3)
    ids = spark.range(600, 3200).select(F.col("id").alias("doc_id"))
    early = {r.doc_id for r in ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(2000).collect()}
    docs, labels = [], []
    for i in range(3200):
        bad = i % 2
        text = sentence(rng, 60)
        if i >= 600 and bad and i not in early:
            text += " zyxword"
        text = text.upper() + " ### ###" if bad else text
        docs.append((i, text, "en", "dump" if bad else "book", len(text)))
        if i < 600:
            labels.append((i, 1 - bad, 0))
    d = spark.createDataFrame(docs, SCHEMA).repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    head = quality.fit(d, lab)["quality"]
    buf = np.frombuffer(b"zyxword", np.uint8)
    code = quality.word_codes(buf, np.array([0, len(buf)]))[1][0]
    assert code in head.words and head.content[np.searchsorted(head.words, code)] < 0
    got = quality.score(d, quality.fit(d, lab)).collect()
    assert all((r.p_quality > 0.5) == (r.doc_id % 2 == 0) for r in got)


def test_words_and_newton_sums_equal_one_plain_fit(spark):
    """Word choice and Newton fit in Spark against the same over all rows in memory."""
    rng = random.Random(21)
    docs, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        text = sentence(rng, 50) + (" spam offer" if bad and rng.random() < 0.8 else " story") + (f" rare{i % 7}" if rng.random() < 0.3 else "")
        docs.append((i, text, "en" if i % 5 else "de", "dump" if bad else "book", len(text)))
        if i < 400:
            labels.append((i, int(not bad), int(i % 4 == 0)))
    d = spark.createDataFrame(docs, SCHEMA).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    s = quality.draw_sample(d, lab)
    pool = quality.unlabelled(d, lab)
    given = s.labels["quality"].astype(float)
    use = ~s.held
    words = quality.telling_words(*s.counts(np.where(use, given, -1)))
    first = quality.Views(words, quality.logistic(s.presence(words)[use], given[use]), quality.logistic(s.meta[use], given[use]), np.array([20.0, 0.0, 20.0, 0.0]))
    # all rows in memory
    row, code, extra, meta, at = [], [], [], [], 0
    for r in pool.orderBy("doc_id").toArrow().to_batches():
        for a, b, e, m in quality._pool_features([r]):
            row.append(a + at)
            code.append(b)
            extra.append(e)
            meta.append(m)
            at += len(m)
    row, code, extra, meta = map(np.concatenate, (row, code, extra, meta))
    y = quality.pseudo_labels([first], row, code, extra, meta)
    assert all((y[0] == c).sum() > 5 for c in (0, 1))
    own = np.where(use, given, -1)[s.row]
    all_codes, all_y = np.concatenate([s.word, code]), np.concatenate([own, y[0][row]])
    codes, place = np.unique(all_codes, return_inverse=True)
    per = np.stack([np.bincount(place[all_y == c], minlength=len(codes)) for c in (0, 1)]).astype(float)
    rows = np.array([((given == c) & use).sum() + (y[0] == c).sum() for c in (0, 1)], float)
    got = quality.chosen_words(quality.pool_counts(pool, {"quality": [first]}, s.table))["quality"]
    assert got.tolist() == quality.telling_words(codes, per, rows).tolist() and len(got) > 2
    ready = quality.compact(pool, {"quality": [first]}, {"quality": got})
    k, x = ("quality", 0), s.presence(got)[use].astype(np.float32)
    x_pool = np.zeros((len(meta), len(got) + quality.N_EXTRA), np.float32)
    spot = np.minimum(np.searchsorted(got, code), len(got) - 1)
    hit = got[spot] == code
    x_pool[row[hit], spot[hit]] = 1
    x_pool[:, len(got):] = extra
    some = y[0] >= 0
    start = {k: np.zeros(x.shape[1] + 1)}
    fitted = quality.newton({k: (x, given[use])}, ready, {"quality": got}, start)[k]
    plain = quality.newton({k: (np.concatenate([x, x_pool[some]]), np.concatenate([given[use], y[0][some]]))}, ready.limit(0), {"quality": got}, start)[k]
    assert np.allclose(fitted, plain, atol=2e-3)
