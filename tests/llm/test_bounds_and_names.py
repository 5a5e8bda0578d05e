"""Items of every length, long spelled-out addresses, columns with clashing names, the order of rules, a ledger that is there."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletwin.llm import decontam, mixing, pii, queries, rules, secrets, sharding


def words(rng, n, stem="w"):
    return [f"{stem}{rng.randrange(10**6)}" for _ in range(n)]


def marked(spark, docs, items):
    out = decontam.mark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {r.doc_id: list(r.item_ids) for r in out.where("contaminated").collect()}


def test_verbatim_items_of_every_length(spark):
    rng = random.Random(1)
    items = [(n, " ".join(words(rng, n))) for n in range(1, 19)]
    docs = [(n, " ".join(words(rng, 25) + t.split() + words(rng, 25))) for n, t in items]
    docs += [(100 + n, t) for n, t in items] + [(200 + i, " ".join(words(rng, 60, "clean"))) for i in range(20)]
    assert marked(spark, docs, items) == {k: [k % 100] for k, _ in docs if k < 200}


def test_short_items_against_all_placings(spark):
    """Every placing of the allowed differences is found, and no placing of one more."""
    rng = random.Random(2)
    items, docs, want = [], [], {}
    for n in range(6, 13):
        item = words(rng, n)
        items.append((n, " ".join(item)))
        for d in (decontam.allowed(n), decontam.allowed(n) + 1):
            for at in itertools.combinations(range(n), d):
                text = ["other" if i in at else w for i, w in enumerate(item)]
                key = len(docs)
                docs.append((key, " ".join(words(rng, 15) + text + words(rng, 15))))
                if d == decontam.allowed(n):
                    want[key] = [n]
    assert marked(spark, docs, items) == want


def test_parts_cover_an_item():
    for n in range(1, decontam.MIN_TOKENS):
        parts = decontam.parts_of(n)
        assert [i for a, k in parts for i in range(a, a + k)] == list(range(n)) and len(parts) == decontam.allowed(n) + 1


def test_spelled_out_addresses_are_whole():
    w = pii.fit([])
    for address in ("ann.lee [at] mail [dot] example [dot] org", "j.smith (at) example (dot) co (dot) uk"):
        text = f"please write to {address} today"
        assert (16, 16 + len(address), "email") in pii.added_spans(text, pii.base_spans(text), w), address


def test_known_entities_are_candidates_at_any_length():
    host = ".".join("abcdefghijklmnopqrstuvw")
    text = f"mail x@{host}.org now"
    (span,) = pii.base_spans(text)["email"]
    cases = [c for c in pii.training_cases([text]) if any(c[0].spans[k][1] - c[0].spans[k][0] > pii.MAX_TOKENS for k, _ in c[1])]
    assert cases and span[1] - span[0] > 40


CLASH = ["_source", "_passes", "_cut", "_copies", "_copy", "_bin", "_k", "_first", "_N", "Key`s"]


def clashing(spark):
    rows = [(i, " ".join(["word"] * (i % 7)) if i % 5 else None, f"s{i % 3}") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in CLASH:
        d = d.withColumn(c, F.concat(F.lit(c + ":"), F.col("doc_id")))
    return d


def test_mixing_keeps_clashing_columns(spark):
    d = clashing(spark)
    plain = mixing.repeated(d.select("doc_id", "text", "source"))
    out = mixing.repeated(d)
    assert out.columns == d.columns
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in plain.collect()) and got
    assert all(r[c] == f"{c}:{r.doc_id}" for r in got for c in CLASH)


def test_sharding_keeps_clashing_columns(spark):
    d = clashing(spark)
    out = sharding.shard(d, [1.0] * 5)
    plain = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(d.select("doc_id", "text"), [1.0] * 5).collect()}
    got = out.collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == plain
    assert all(r[c] == f"{c}:{r.doc_id}" for r in got for c in CLASH)


def sample(n=64):
    texts = [("word " * (20 + i)).encode() for i in range(n)]
    return rules.Texts(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))


def test_order_by_rejections_per_second_of_what_is_left():
    seen = []

    def rule(name, work, bad):
        def rejects(t):
            seen.append((name, t.n))
            np.sort(np.random.default_rng(0).random(work))
            return bad(t)
        return rules.QualityRule(name, rejects)

    # "same" rejects what "cheap" rejects: beside it, it has nothing left and comes last although it is cheaper than "dear"
    rest = lambda t: t.get("n_words")
    rs = (rule("dear", 200_000, lambda t: rest(t) > 75), rule("cheap", 10, lambda t: rest(t) < 60), rule("same", 60_000, lambda t: rest(t) < 50))
    t, base = rules.counted(sample())
    order = rules.run_order(t, rs)
    assert order == ["cheap", "dear", "same"]
    by = {r.name: r for r in rs}
    spent = {}
    for way in (order, order[::-1]):
        seen.clear()
        verdict = rules.cascade(t.again(), [by[n] for n in way])
        spent[tuple(way)] = (sum(n for _, n in seen), (verdict >= 0).tolist())
    assert spent[tuple(order)][0] < spent[tuple(order[::-1])][0] and spent[tuple(order)][1] == spent[tuple(order[::-1])][1]


def test_known_counts_are_not_charged():
    made = []

    class Counting(rules.Texts):
        def count_n_symbols(self):
            made.append(1)
            return super().count_n_symbols()

    t, _ = rules.counted(Counting(sample().buf, sample().offsets))
    rules.run_order(t, rules.CASCADE)
    assert len(made) == 1


def test_query_with_a_ledger_gives_what_a_scan_without_one_gives(spark, tmp_path):
    rows = [(i, ["token=abcdef", "nothing", "AKIA" + "A" * 20, None, "", "f" * 30][i % 6]) for i in range(30)] + [(None, "secret: qwerty1"), (3, "password=letmein9")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op8_secrets(spark, str(tmp_path)).collect()
    plain = secrets.scan(spark.read.parquet(str(tmp_path / "documents.parquet"))).select("doc_id", secrets.digest(F.col("spans")).alias("spans")).collect()
    assert sorted((str(r.doc_id), r.spans) for r in out) == sorted((str(r.doc_id), r.spans) for r in plain)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op8_secrets(spark, str(tmp_path / "none")).count() == 0


def test_recorded_contents_are_not_scanned_again(spark, tmp_path):
    path = str(tmp_path / "ledger")
    d = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "x")], "doc_id long, text string")
    secrets.record(d.where("doc_id < 3"), path)
    ledger = spark.read.schema(secrets.LEDGER_SCHEMA).parquet(path)
    assert secrets.new_findings(d, ledger).select("blob").distinct().count() == 1
    secrets.record(d, path)
    assert secrets.new_findings(d, spark.read.schema(secrets.LEDGER_SCHEMA).parquet(path)).count() == 0


def test_classifier_fits_hold_the_dense_rows_of_one_view_at_a_time(spark, monkeypatch):
    import weakref

    from tabletwin.llm import quality
    n, rng = 3000, np.random.default_rng(1)
    good = rng.integers(0, 2, n)
    row = np.repeat(np.arange(n, dtype=np.int32), 400)
    word = (rng.integers(0, 500, len(row)) * (1 + good[row])).astype(np.int32)
    both = np.unique((row.astype(np.int64) << quality.WORD_BITS) | word)
    row, word = (both >> quality.WORD_BITS).astype(np.int32), (both & ((1 << quality.WORD_BITS) - 1)).astype(np.int32)
    labels = {h: good for h in quality.HEADS}
    s = quality.Sample(row, word, np.zeros((n, quality.N_EXTRA)), rng.random((n, quality.N_META)), labels, np.arange(n) % 4 == 0, None)
    words = quality.telling_words(*s.counts(np.where(s.held, -1, good)))
    some = rng.random(n) < 0.3
    assert len(words) > 400 and np.array_equal(s.presence(words, some), s.presence(words)[some])
    made, alive, presence = [], [], quality.Sample.presence

    def seen(*a):
        alive.append(sum(r() is not None for r in made))
        x = presence(*a)
        made.append(weakref.ref(x))
        return x

    monkeypatch.setattr(quality.Sample, "presence", seen)
    quality.co_train(s, None, rounds=0)
    assert len(alive) >= 2 and max(alive) == 0
