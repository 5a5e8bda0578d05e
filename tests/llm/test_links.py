"""All links of the near-copy join, by brute force over every pair of texts."""

import random
from collections import Counter

from tabletwin.llm import jaccard
from tests.llm import brute
from tests.llm.data import sentence


def near_copies():
    rng = random.Random(11)
    base = sentence(rng, 160).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(30)}"
        texts.append(" ".join(w[: rng.choice([140, 150, 160])]))
    texts += texts[:7] + [sentence(rng, 40) for _ in range(15)] + ["a b c", "a b c d", "", "a B c"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def brute_links(rows):
    """Links (a, b) between the least ids of equal sets."""
    rep = {}
    for d, t in sorted(rows):
        s = brute.shingles(t)
        if s:
            rep.setdefault(s, d)
    reps = sorted((d, s) for s, d in rep.items())
    return {(a, b) for i, (a, s) in enumerate(reps) for b, t in reps[i + 1:] if 100 * len(s & t) >= 80 * len(s | t)}, rep


def test_all_links_and_counts(spark, monkeypatch):
    # every route: frequent shingles, tiles in blocks, arrays in blocks
    for name, value in (("FREQUENT_LEAST", 3), ("SMALL_TILE", 3), ("TILE_BLOCK", 6), ("PAIR_BLOCK", 4), ("COUNT_BLOCK", 5)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies()
    want, rep = brute_links(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    links = jaccard.join(docs).links.collect()
    sets = {d: s for s, d in rep.items()}
    assert sorted((r.a, r.b) for r in links) == sorted(want)
    assert all(r.common == len(sets[r.a] & sets[r.b]) for r in links)
    per = Counter(x for pair in want for x in pair)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.component_rows(docs).collect()}
    parts = brute.jaccard_rows(rows)
    assert got == {d: (*parts[d], per[rep[brute.shingles(t)]] if brute.shingles(t) else 0) for d, t in rows}
    assert len(want) > 2 * len(rep)  # far more links than span the components


def test_counts_of_one_block_and_of_many(spark, monkeypatch):
    """Components within one tile, and components whose bands of size are several blocks."""
    rows = near_copies()
    want, rep = brute_links(rows)
    per = Counter(x for pair in want for x in pair)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    j = jaccard.join(docs, spanning=True)
    for block in (512, 9, 1):
        monkeypatch.setattr(jaccard, "COUNT_BLOCK", block)
        got = {r.rep: r.n_links for r in jaccard.link_counts(j).collect()}
        assert got == dict(per)


def test_bands_hold_all_links():
    import math

    band = lambda n: math.floor(math.log(n) / math.log(jaccard.BAND))
    for n in list(range(1, 3000)) + [10**k for k in range(4, 12)]:
        assert band(n * 5 // 4) - band(n) <= 1
