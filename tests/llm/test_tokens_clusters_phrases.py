"""Byte-level BPE, centroid clustering and phrase mining against plain versions."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabletwin.llm import bitplane, bpe, phrases, queries
from tabletwin.llm.store import source_table
from tests.llm.data import DOC_SCHEMA, WORDS, corpus, sentence

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
sha = lambda b: hashlib.sha256(b).hexdigest()


# ---- byte-level BPE

@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_row(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())


ODD_TEXTS = ["  two  spaces \n\n and\ttabs \r\n", " leading", "trailing ", "a b  c \x1c d\x85 e", "don't we'll I'VE 's", "中文没有空格的句子。" * 40, "日本語テキスト한국어", "\U0001f600\U0001f468‍\U0001f469 emoji",
             "x" * 3000, "ab" * 2000, "0123456789" * 300, "<|endoftext|> as text", "́́ combining", "é\n é", " ", "\n", "   ", "!!!???...", "عربي نص 123٤٥٦", "a" * 9 + " " * 50 + "b"]


def test_bpe_equals_the_library(spark, library):
    rows = [(r[0], r[1]) for r in corpus()] + [(5000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(tokens, RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: (r.n_tokens, sha(r.ids), sha(r.decoded)) for r in back.collect()}
    assert got == {d: bpe_row(library, t) for d, t in rows}


def test_bpe_query(spark, library):
    want = {r.doc_id: bpe_row(library, r.text) for r in source_table(spark, SF, "documents").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_bpe(spark, SF).collect()}
    assert got == want


def test_bpe_random_pieces(library, monkeypatch):
    """Random bytes of few letters, where many merges compete, and small memories that are emptied often."""
    monkeypatch.setattr(bpe, "MEMORY", 50)
    enc = bpe.encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    rng = random.Random(6)
    for alphabet in ("ab", "aeinrst", "éèabc", "zqxj", "的一是不", "0123", "\u0000\u0001~"):
        for n in (1, 2, 5, 17, 60, 400):
            for _ in range(30):
                text = "".join(rng.choice(alphabet) for _ in range(n))
                assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode_ordinary(text), text


def merged(ranks, piece):
    """Merges one by one: lowest rank first, then leftmost."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1))
        if rank == math.inf:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_bpe_small_vocabularies():
    """Made vocabularies, also with tokens that no merges lead to, on all short strings."""
    rng = random.Random(12)
    tried = 0
    for _ in range(16):
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 272:
            new = rng.choice(tokens[97:100] + tokens[256:]) + rng.choice(tokens[97:100] + tokens[256:])
            if new not in tokens and len(new) < 9:
                tokens.append(new)
        for odd in (b"abcabca", b"ccbbaabb"):
            if odd not in tokens:
                tokens.append(odd)
        ranks = {t: i for i, t in enumerate(tokens)}
        try:
            enc = bpe.Encoder(ranks, r"(?s:.+)")
        except ValueError as e:  # such a vocabulary cannot come from training
            assert "follow the merges" in str(e)
            continue
        tried += 1
        for n in range(1, 9):
            for _ in range(150):
                piece = bytes(rng.choice(b"abc") for _ in range(n))
                assert enc.encode_piece(piece) == merged(ranks, piece), piece
    assert tried >= 10
    with pytest.raises(ValueError):
        bpe.Encoder({b"a": 0}, ".")


def test_bpe_cases(spark):
    d = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, "", 3), (2, "x", 4), (2, "x", 4)], "doc_id long, text string, ids int")
    out = bpe.encode(d, RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and sorted(r.n_tokens for r in out.collect()) == [0, 0, 1, 1, 2]
    assert bpe.decode(bpe.encode(d.limit(0), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0
    named = bpe.encode(d.withColumn("doc_id", F.lit("k")), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id for r in named.collect()} == {"k"}
    with pytest.raises(ValueError):
        bpe.decode(out, RANKS, public_tokenizers.PATTERN, into="ids")


# ---- centroid clustering

def plain_clusters(rows, k, rounds, salt="2:"):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    code = lambda i: hashlib.sha256(f"{salt}{i}".encode()).hexdigest() if i is not None else "~"
    cents = [v for _, v in sorted(kept, key=lambda r: code(r[0]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in out:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha(",".join(map(str, cents[j])).encode())) for i, j, d in out), key=str)


def test_bit_planes_are_exact():
    g = np.random.Generator(np.random.PCG64(4))
    for lo, hi in ((-1, 1), (0, 1), (-256, 257), (-bitplane.LARGEST, bitplane.LARGEST), (5, 6)):
        a, b = g.integers(lo, hi, (50, 64)), g.integers(lo, hi, (7, 64))
        assert (bitplane.unpack(bitplane.pack(a)) == a).all()
        assert (bitplane.dots(bitplane.pack(a), bitplane.pack(b)) == a @ b.T).all()


def test_clusters(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(64)]) for i in range(220)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(60)] + [(400, [0.0] * 64), (401, [-3.5] * 64), (402, [900.25] * 64)]
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [1.0] * 63 + [None]), (505, [1.0] * 63 + [math.nan]), (506, [math.inf] + [1.0] * 63), (None, [0.25] * 64)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label string, norm int").repartition(3)
    out = bitplane.cluster(df, 12, 5, "2:")
    got = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, sha(",".join(map(str, r.centroid)).encode())) for r in out.collect()), key=str)
    assert got == plain_clusters(rows, 12, 5)


def test_cluster_cases(spark, duck):
    few = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (2, [1.5] * 64)], "vec_id int, embedding array<double>")
    out = bitplane.cluster(few, 40, 5, "2:").collect()
    assert len(out) == 3 and {r.inertia for r in out} == {0}
    assert bitplane.cluster(few.limit(0), 40, 5, "2:").count() == 0
    with pytest.raises(Exception, match="too large"):
        bitplane.cluster(few.union(spark.createDataFrame([(3, [1e9] * 64)], few.schema)), 2, 1, "2:").count()
    want = sorted(duck.execute(queries.ORACLE["op12_bitplane_clusters"]).fetchall())
    assert sorted(tuple(r) for r in queries.op12_bitplane_clusters(spark, SF).collect()) == want


# ---- phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_phrases(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score)"""
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            c.update(tuple(w[i:i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = [p for p, a in c.items() if len(p) > 1 and a >= least]
        gone = {p[i:i + k] for p in cand for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c[p] >= 80 * c[p[i:i + k]]}
        found = []
        for p in cand:
            if p not in gone:
                score, k = min((2_000_000 * c[p] // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((lang, " ".join(p), c[p], c[p[:k]], c[p[k:]], total[lang], score))
        found.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i + 1, *x[1:]) for i, x in enumerate(found[:top])]
    return sorted(out)


def phrase_rows(seed=8):
    rng = random.Random(seed)
    fixed = ["new york city hall", "as well as", "in spite of", "United Nations", "une école française", "to be or not"]
    rows = []
    for i in range(160):
        bits = []
        for _ in range(rng.randrange(1, 40)):
            bits.append(rng.choice(fixed) if rng.random() < 0.4 else rng.choice(WORDS[:25]))
            bits.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "; ", "\n", "!? ", " "]))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(bits)))
    return rows + [("en", None), ("en", ""), ("xx", "a b"), ("en", ". , ;"), ("en", "the the the the the " * 30), ("yy", "one two three four five " * 40)] + rows[:9]


@pytest.mark.parametrize("side_rows,shard", [(None, None), (0, 300), (None, 40)])
def test_phrases(spark, monkeypatch, side_rows, shard):
    """Lists sent to all shards or joined shard by shard; one shard or many per task."""
    if shard:
        monkeypatch.setattr(phrases, "SHARD", shard)
    rows = phrase_rows()
    docs = spark.createDataFrame([(r[0], r[1], i, "x") for i, r in enumerate(rows)], "lang string, text string, n int, word string").repartition(4)
    for least, top in ((30, 2000), (4, 25)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, least, top, side_rows=side_rows).collect())
        assert got == plain_phrases(rows, least, top)
        assert len(got) > 8


def test_phrases_of_equal_hash_are_told_apart(spark, monkeypatch):
    """A first hash of two bits, so that nearly all words share it with others."""
    whole = phrases.tokens.span_hashes

    def weak(buf, starts, ends):
        h = whole(buf, starts, ends)
        return h & np.uint64(3) if len(buf) and not (buf >= 128).mean() > 0.5 else h

    rows = [(lang, re.sub(r"[^\x00-\x7f]", "e", t) if t else t) for lang, t in phrase_rows(2)]
    monkeypatch.setattr(phrases.tokens, "span_hashes", weak)
    buf = np.frombuffer(" ".join(WORDS[:40]).encode(), np.uint8)
    h, h2, starts, ends = phrases.word_codes(buf, np.array([0, len(buf)]))
    assert len(set(h.tolist())) <= 5 and len(set(h2.tolist())) == 41
    first, text = phrases.numbered(h, h2)
    assert len(first) == 41 and len(set(text.tolist())) == 41


def test_index_counts_all_short_phrases():
    """Both interval texts against plain counts, growing on either side."""
    rng = random.Random(5)
    text = [0]
    for _ in range(60):
        text += [rng.randrange(1, 6) for _ in range(rng.randrange(0, 9))] + [0]
    t = np.array(text, np.int64)
    shard = phrases.Shard(phrases.burrows_wheeler(t), phrases.burrows_wheeler(t[::-1].copy()))
    for order in ((True, False, True), (False, True, False), (True, True, True), (False, False, False)):
        got = shard.words(np.arange(1, 6))
        for k, left in zip((2, 3, 4), order):
            got = shard.grow(got, left)
            want = Counter(tuple(text[i:i + k]) for i in range(len(text) - k + 1) if 0 not in text[i:i + k])
            assert {tuple(p): n for p, n in zip(got[0].tolist(), got[3].tolist())} == want


def test_phrase_query_and_empty(spark):
    rows = [(r.lang, r.text) for r in source_table(spark, SF, "documents").collect()]
    assert sorted(tuple(r) for r in queries.op13_collocations(spark, SF).collect()) == plain_phrases(rows, 30, 2000)
    none = spark.createDataFrame([], DOC_SCHEMA)
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, sentence(random.Random(1), 20), "en", "s", 1)], DOC_SCHEMA)).count() == 0


def test_counts_of_shards_are_added_up_in_a_task(spark, monkeypatch):
    """A phrase that every shard of a task holds leaves the task once, whatever the number of shards; a small limit of
    held rows only adds rows."""
    rows = [("en", "one two three four five six. " * 10)] * 30 + [("de", "one two three four five six. " * 10)] * 20
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(20)  # a task makes its own shards
    shards = phrases.index(docs).coalesce(1)
    assert shards.count() >= 20
    each = shards.select("lang", F.explode("words").alias("w")).select("lang", "w.h", "w.h2").distinct()
    words = each.withColumn("id", F.dense_rank().over(Window.orderBy("lang", "h")).cast("long") * (1 << 33))
    base = shards.join(F.broadcast(phrases._listed(words, {})), "lang").drop("lang", "shard")
    totals = lambda df: sorted((r.w0, r.w1, r.n) for r in df.groupBy("w0", "w1").agg(F.sum("n").alias("n")).collect())
    local = phrases._level(base, 2)
    assert local.count() == 10 and {n for *_, n in totals(local)} == {300, 200}
    monkeypatch.setattr(phrases, "HELD_ROWS", 4)
    many = phrases._level(base, 2)
    assert many.count() > 10 and totals(many) == totals(local)


def test_phrases_are_placed_by_their_words():
    """Membership in the listed phrases of a shard, and sums over shards, against plain sets."""
    g = np.random.Generator(np.random.PCG64(11))
    alive = [np.array([[1], [2], [3], [5], [6]])]
    alive.append(np.array([[a, b] for a in (1, 2, 3, 5, 6) for b in (1, 2, 3, 5, 6) if g.random() < 0.5]))
    pairs = set(map(tuple, alive[1].tolist()))
    alive.append(np.array([[a, b, c] for a, b in pairs for c in (1, 2, 3, 5, 6) if (b, c) in pairs and g.random() < 0.5]))
    listed = phrases.Listed(alive, 7)
    for k in (1, 2, 3):
        have = set(map(tuple, alive[k - 1].tolist()))
        tried = g.integers(1, 7, (400, k))
        assert listed.holds(tried).tolist() == [tuple(p) in have for p in tried.tolist()]
    assert listed.holds(np.zeros((0, 3), np.int64)).tolist() == []
    held, want = [], Counter()
    for _ in range(5):
        ids = np.sort(g.choice(1 << 60, 5, replace=False)) if not held else held[0][2]
        found = np.array(sorted({tuple(p) for p in g.integers(1, 6, (60, 4)).tolist()}))
        n, symbol = g.integers(1, 9, len(found)), g.permutation(5) + 1
        held.append((found, n, ids, symbol))
        name = dict(zip(symbol.tolist(), ids.tolist()))
        for p, c in zip(found.tolist(), n.tolist()):
            want[tuple(name[x] for x in p)] += c
    found, n, ids, symbol = phrases.together(held)
    assert Counter({tuple(ids[p].tolist()): c for p, c in zip(found, n.tolist())}) == want and len(n) == len(want)


def test_stable_order_of_large_keys():
    g = np.random.Generator(np.random.PCG64(2))
    for top in (1, 50, 1 << 40, (1 << 62) + 5):
        key = g.integers(0, top, 300)
        assert phrases.stable_order(key).tolist() == np.argsort(key, kind="stable").tolist()
    assert phrases.stable_order(np.zeros(0, np.int64)).tolist() == []
