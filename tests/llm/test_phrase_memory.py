"""What goes back to the shards of the phrase index beyond the limit of rows, and what a task holds."""

import re
import tracemalloc
from collections import Counter

import numpy as np

from tabletwin.llm import phrases
from tests.llm.test_tokens_clusters_phrases import phrase_rows, plain_phrases


def _spots_set(bits, columns):
    one, two = phrases.sieve_spots(columns, 8 * len(bits))
    at = lambda x: bits[x >> 3] >> (x & 7).astype(np.uint8) & 1
    return (at(one) & at(two)).astype(bool)


def test_sieves_hold_every_listed_phrase(spark, monkeypatch):
    """Every listed phrase passes, few others do, and the size has a bound whatever the number of phrases."""
    g = np.random.Generator(np.random.PCG64(3))
    listed = [tuple(int(x) << 33 | int(x) for x in p) for p in np.unique(g.integers(0, 900, (5000, 3)), axis=0)]
    df = spark.createDataFrame(listed, "w0 long, w1 long, w2 long").repartition(3)
    columns = [np.array(x) for x in zip(*listed)]
    others = [np.array(x) for x in zip(*[(a, c, b) for a, b, c in listed if (a, c, b) not in set(listed[:50])])]
    bits = phrases.sieve(df, 3, len(listed))
    assert len(bits) * 8 == 1 << 17 and _spots_set(bits, columns).all()
    assert _spots_set(bits, others).mean() < 0.05
    monkeypatch.setattr(phrases, "SIEVE_MOST", 1 << 15)
    least = phrases.sieve(df, 3, len(listed))
    assert len(least) * 8 == 1 << 15 and _spots_set(least, columns).all()


def test_results_do_not_depend_on_what_passes_a_sieve(spark, monkeypatch):
    """With sieves that let everything pass the phrases are the same; no list of phrases goes to the shards."""
    rows = phrase_rows(7)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    asked = []

    def everything(found, level, n):
        asked.append(level)
        return np.full(1 << 12, 255, np.uint8)

    monkeypatch.setattr(phrases, "sieve", everything)
    monkeypatch.setattr(phrases, "SHARD", 200)
    listed = phrases._listed
    monkeypatch.setattr(phrases, "_listed", lambda words, longer: listed(words, longer) if not longer else 1 / 0)
    seen = Counter((lang or "und", w) for lang, t in rows for w in re.split(r"[.,;:!?\s]+", (t or "").lower()) if w)
    n_words = sum(n >= 4 for n in seen.values())
    for side_rows in (0, n_words):  # words joined shard by shard, words in one list
        got = sorted(tuple(r) for r in phrases.collocations(docs, 4, 50, side_rows=side_rows).collect())
        assert got == plain_phrases(rows, 4, 50)
    assert set(asked) >= {2, 3}


def test_growth_looks_at_few_rows_at_once(monkeypatch):
    """The growth of a shard's phrases in many steps: the same counts, and less memory than rows of the whole shard."""
    g = np.random.Generator(np.random.PCG64(4))
    text = np.append((g.pareto(0.9, 300_000) * 4).astype(np.int64) % 3000, 0)
    shard = phrases.Shard(phrases.burrows_wheeler(text), phrases.burrows_wheeler(text[::-1].copy()))
    single = np.flatnonzero(shard.size >= 30)
    single = single[single > 0]

    def counted(at_once):
        monkeypatch.setattr(phrases, "AT_ONCE", at_once)
        tracemalloc.start()
        found, n = phrases.counts_in(shard, single, phrases.Listed([single[:, None]], len(shard.size)), 2)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return dict(zip(map(tuple, found.tolist()), n.tolist())), peak

    (whole, most), (steps, less) = counted(1 << 30), counted(1 << 14)
    assert whole == steps and len(whole) > 10_000
    assert less < most / 2, (less, most)
