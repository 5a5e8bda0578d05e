"""Removal of long word repeats across documents by recompression.

A text is a sequence of word hashes. Rounds name runs and pairs: first each run of two equal words becomes one symbol,
then, twice, neighbouring symbols are paired if the left one's name is of the left class and the right one's of the
right class. A name is a hash of what it stands for, so all tasks give equal content equal names without a shared
dictionary. Whether symbols merge depends on their neighbours only; hence inside two equal windows of 50 words all
symbols agree but those within 8 words of the ends, and the least name that starts between words 8 and 34 of a
window is the same wherever the window's words occur, and so are the 24 words around it, whose hash is the key. Runs of three and more equal words merge with nothing; windows
that hold part of one are found by the run's ends, and windows inside one by its word.

These keys (one for about 14 words) are what is shuffled. A key in two documents reveals possible repeats;
only windows with such a key are then verified by a 96-bit hash of their 50 words: a window is removed if its words
start in a document with a smaller id. Documents with equal word sequences are settled by one hash each. Windows
that recur within a task's share are reduced there before the shuffle, so a passage that a third of all documents
has arrives once from each task.

Cases: null and empty texts have no words; texts below 50 words lose nothing; rows without an id are compared with
nothing; rows that repeat an id never remove from each other; very long texts are read whole; an empty table gives
an empty result; further columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabletwin.llm import tokens as tk
from tabletwin.llm.store import broadcast_if, map_arrow, written

WINDOW = 50
ROUNDS = 2
#: Longest symbol (a named run of two, paired ROUNDS times), and the words next to a window's end that may differ.
LONGEST = 2 << ROUNDS
EDGE = 8
SPAN = WINDOW - 2 * EDGE - LONGEST + 1
#: Words from EDGE before a chosen symbol to the last that every window choosing it holds.
AROUND = 2 * EDGE + LONGEST
#: Windows held in a task before those that recur among them are reduced.
AT_ONCE = 400_000
#: Side tables with up to this many numbers are broadcast (8 bytes each); larger ones are joined by a shuffle.
BROADCAST_NUMBERS = 2_000_000
BROADCAST_GROUPS = 500_000
_NONE = np.uint64(2**64 - 1)
_POS = np.uint64(2**30 - 1)
_C1, _C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)


def symbols(h: np.ndarray, row: np.ndarray, rounds: int = ROUNDS):
    """(first word, name, frozen) of the symbols after the rounds, and (first, length) of runs of three and more."""
    n = len(h)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), np.zeros(0, bool), z, z
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    long_run = length >= 3
    in_long = np.repeat(long_run, length)
    at = np.flatnonzero(new | in_long)
    name, frozen = h[at].copy(), in_long[at]
    double = np.zeros(n, bool)
    double[first[length == 2]] = True
    two = double[at]
    name[two] = tk.mix(name[two] * _C1 + np.uint64(2))
    for r in range(rounds):
        left = (tk.mix(name + np.uint64((r + 1) * int(_C2) % 2**64)) & np.uint64(1)).astype(bool)
        pair = left[:-1] & ~left[1:] & ~frozen[:-1] & ~frozen[1:] & (row[at[1:]] == row[at[:-1]])
        i = np.flatnonzero(pair)
        name[i] = tk.mix(name[i] * _C1 + name[i + 1] * _C2 + np.uint64(r + 1))
        keep = np.ones(len(at), bool)
        keep[i + 1] = False
        at, name, frozen = at[keep], name[keep], frozen[keep]
    return at, name, frozen, first[long_run], length[long_run]


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = v, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    more = width - have
    return np.minimum(out[:len(out) - more], out[more:]) if more else out


class Slice:
    """Words of some whole texts, their windows and keys."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        starts, ends, self.first = tk.word_bounds(buf, offsets)
        self.h = tk.span_hashes(buf, starts, ends)
        self.n_words = np.diff(self.first)
        self.rows = len(self.n_words)
        self.row = np.repeat(np.arange(self.rows), self.n_words)

    def content_keys(self):
        """Two hashes of each row's word sequence."""
        out = []
        for salt in (np.uint64(0), np.uint64(0x6A09E667F3BCC909)):
            pos = np.arange(len(self.h)) - np.repeat(self.first[:-1], self.n_words)
            c = np.zeros(len(self.h) + 1, np.uint64)
            np.cumsum(tk.mix(tk.mix(self.h ^ salt) + pos.astype(np.uint64) * _C2), out=c[1:])
            out.append(tk.mix((c[self.first[1:]] - c[self.first[:-1]]) ^ self.n_words.astype(np.uint64)).view(np.int64))
        return out

    def find(self):
        """(window starts, the word their key stands at or -1, keys of all words) and the marks that runs set."""
        n = len(self.h)
        at, name, frozen, run, length = symbols(self.h, self.row)
        v = np.full(n, _NONE)
        v[at] = np.where(frozen, _NONE, tk.mix(name + _C1) & ~_POS)
        v = (v & ~_POS) | np.arange(n, dtype=np.uint64)
        starts = np.arange(max(0, n - WINDOW + 1))
        starts = starts[self.row[starts] == self.row[starts + WINDOW - 1]] if len(starts) else starts
        least = sliding_least(v, SPAN)[starts + EDGE] if len(starts) else np.zeros(0, np.uint64)
        place = np.where((least | _POS) == _NONE, -1, (least & _POS).astype(np.int64))
        # every window that chose a symbol holds the words around it: they make its key
        around = np.zeros(n, np.uint64)
        if n >= AROUND:
            around[EDGE:n - AROUND + EDGE + 1] = tk.window_hashes(self.h, AROUND)
        marks = []
        if len(run):
            row, lo = self.row[run], self.first[self.row[run]]
            hi = self.first[self.row[run] + 1]
            last = run + length - 1
            s = run > lo
            marks.append((run[s] + 1 - WINDOW + 1, run[s] - 1, tk.mix(self.h[run[s] - 1] * _C1 + self.h[run[s]] + np.uint64(11)), row[s]))
            e = last + 1 < hi
            marks.append((last[e] + 2 - WINDOW, last[e], tk.mix(self.h[last[e] + 1] * _C2 + self.h[last[e]] + np.uint64(13)), row[e]))
            w = length >= WINDOW
            marks.append((run[w], last[w] - WINDOW + 1, tk.mix(self.h[run[w]] + np.uint64(17)), row[w]))
        return starts, place, around, marks

    def keys(self):
        """Distinct (row, key) pairs of all texts with a window, by row."""
        starts, place, around, marks = self.find()
        use = np.ones(len(starts), bool)
        use[1:] = place[1:] != place[:-1]
        use &= place >= 0
        rows, keys = [self.row[starts[use]]], [around[place[use]]]
        for _, _, key, row in marks:
            fits = self.n_words[row] >= WINDOW
            rows.append(row[fits])
            keys.append(key[fits])
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        return row[new], key[new]

    def revealed(self, shared_row: np.ndarray, shared_key: np.ndarray) -> np.ndarray:
        """Starts of the windows with a key that is shared (the pairs say which keys of which rows are)."""
        starts, place, around, marks = self.find()
        known = np.sort(_keyed(shared_row, shared_key))

        def is_shared(row, key):
            if len(known) == 0 or len(row) == 0:
                return np.zeros(len(row), bool)
            x = _keyed(row, key)
            return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x

        change = np.ones(len(starts), bool)
        change[1:] = (place[1:] != place[:-1]) | (self.row[starts[1:]] != self.row[starts[:-1]])
        head = np.flatnonzero(change)
        ok = is_shared(self.row[starts[head]], around[place[head]]) & (place[head] >= 0)
        hit = np.zeros(len(self.h) + 1, bool)
        hit[starts] = np.repeat(ok, np.diff(np.append(head, len(starts))))
        for lo, hi, key, row in marks:
            yes = is_shared(row, key)
            lo = np.maximum(lo, self.first[row])
            hi = np.minimum(hi, self.first[row + 1] - WINDOW)
            yes &= lo <= hi
            d = np.zeros(len(self.h) + 2, np.int64)
            np.add.at(d, lo[yes], 1)
            np.add.at(d, hi[yes] + 1, -1)
            hit |= np.cumsum(d)[:len(hit)] > 0
        return np.flatnonzero(hit)


def _keyed(row, key):
    return tk.mix(key.astype(np.uint64) + row.astype(np.uint64) * _C2)


KEY_SCHEMA = "doc_id long, n_words long, k1 long, k2 long, keys array<long>"


def _key_work(batches):
    for batch in batches:
        for lo, hi, part, off in tk.slices(*tk.text_buffer(batch.column(1))):
            s = Slice(part, off)
            row, key = s.keys()
            k1, k2 = s.content_keys()
            first = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(s.n_words, pa.int64()), pa.array(k1), pa.array(k2),
                 pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(key.view(np.int64)))], names=[c.split()[0] for c in KEY_SCHEMA.split(", ")])


WINDOW_SCHEMA = "doc_id long, k1 long, x int, w1 long, w2 int, sure boolean"


def _reduced(parts):
    """Windows of one share: those with a smaller document in the share are settled, the others go on."""
    doc, k1, x, w1, w2 = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((doc, w2, w1))
    doc, k1, x, w1, w2 = doc[order], k1[order], x[order], w1[order], w2[order]
    new = np.ones(len(doc), bool)
    new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
    sure = np.empty(len(doc), bool)
    sure[order] = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    # rows leave in the order of the texts: neighbours share what a column repeats
    doc, k1, x, w1, w2 = (np.concatenate(c) for c in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(k1), pa.array(x, pa.int32()), pa.array(w1), pa.array(w2, pa.int32()), pa.array(sure)],
                                      names=[c.split()[0] for c in WINDOW_SCHEMA.split(", ")])


def _window_work(batches):
    parts, held = [], 0
    for batch in batches:
        shared = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
        ends = shared.offsets.to_numpy()
        values = shared.values.to_numpy().view(np.uint64)
        ids = batch.column(0).to_numpy()
        for lo, hi, part, off in tk.slices(*tk.text_buffer(batch.column(1))):
            s = Slice(part, off)
            counts = np.diff(ends[lo:hi + 1])
            at = s.revealed(np.repeat(np.arange(hi - lo), counts), values[ends[lo]:ends[hi]])
            if len(at) == 0:
                continue
            row = s.row[at]
            k1, _ = s.content_keys()
            w1 = tk.window_hashes(s.h, WINDOW)[at]
            w2 = tk.window_hashes(tk.mix(s.h ^ _C2), WINDOW)[at] >> np.uint64(32)
            parts.append((ids[lo:hi][row], k1[row], (at - s.first[row]).astype(np.int32), w1.view(np.int64), w2.astype(np.uint32).view(np.int32)))
            held += len(at)
            if held >= AT_ONCE:
                yield _reduced(parts)
                parts, held = [], 0
    if parts:
        yield _reduced(parts)


def beside(docs: DataFrame, side: DataFrame, numbers: int, how: str) -> DataFrame:
    """Join on doc_id; the side table is broadcast if its ``numbers`` are few, else both are shuffled."""
    return docs.join(F.broadcast(side) if numbers <= BROADCAST_NUMBERS else side, "doc_id", how)


def removed_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, cover, whole): words to remove in the row of that id and content; ``whole``: all of them."""
    table = written(map_arrow(docs, _key_work, KEY_SCHEMA), "keys")
    table = table.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    least = written(table.groupBy("n_words", "k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"), "least")
    copies = written(table.select("doc_id", "n_words", "k1", "k2").join(broadcast_if(least, BROADCAST_GROUPS), ["n_words", "k1", "k2"]).where(F.col("doc_id") > F.col("least"))
                     .select("doc_id", "k1").distinct(), "copies")
    alone = written(beside(table.select("doc_id", "k1", "keys"), copies.select("doc_id", F.col("k1").alias("c")), copies.count() * 2, "left")
                    .where(F.col("c").isNull() | (F.col("c") != F.col("k1")))
                    .select("doc_id", F.explode("keys").alias("key")), "occurrences")
    # the groups are reduced before the shuffle; the join back can be split at keys that very many documents have
    shared = alone.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where(F.col("lo") < F.col("hi")).select("key")
    needed = written(alone.join(shared, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("key").alias("shared")), "shared")
    numbers = needed.agg(F.sum(F.size("shared"))).first()[0] or 0
    found = written(map_arrow(beside(docs.where("doc_id is not null"), needed, numbers, "inner").select("doc_id", "text", "shared"), _window_work, WINDOW_SCHEMA), "windows")
    open_ = found.where(~F.col("sure")).withColumn("least", F.min("doc_id").over(W.partitionBy("w1", "w2")))
    gone = found.where("sure").select("doc_id", "k1", "x").union(open_.where(F.col("doc_id") > F.col("least")).select("doc_id", "k1", "x"))
    gone = map_arrow(gone.groupBy("doc_id", "k1").agg(F.collect_list("x").alias("xs")), _cover_work, COVER_SCHEMA)
    whole = copies.select("doc_id", "k1", F.array().cast("array<int>").alias("cover"), F.lit(True).alias("whole"))
    # windows of a row that is a copy can also turn up beside another text of the same id: the copy's mark settles it
    gone = gone.join(copies, ["doc_id", "k1"], "left_anti").select("doc_id", "k1", "cover", F.lit(False).alias("whole"))
    return gone.union(whole)


COVER_SCHEMA = "doc_id long, k1 long, cover array<int>"


def _cover_work(batches):
    """Window starts of a row to the words they cover, as merged intervals."""
    for batch in batches:
        covers = []
        for xs in batch.column(2):
            x = xs.values.to_numpy().astype(np.int64)
            covers.append(tk.merged(x, x + WINDOW).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(covers, pa.list_(pa.int32()))], names=["doc_id", "k1", "cover"])


RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def cleaned(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = written(removed_windows(docs), "gone")
    numbers = gone.agg(F.sum(F.size("cover") + 4)).first()[0] or 0
    side = gone.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "whole", "cover")).alias("gone"))

    def work(batches):
        for batch in batches:
            marks = batch.column(2)
            for lo, hi, part, off in tk.slices(*tk.text_buffer(batch.column(1))):
                s = Slice(part, off)
                k1 = s.content_keys()[0]
                raw = part.tobytes()
                removed, digests, texts = [], [], []
                for i in range(hi - lo):
                    w = raw[off[i]:off[i + 1]].split()
                    cut = marks[lo + i].as_py() if marks[lo + i].is_valid else []
                    own = [m for m in cut if m["k1"] == k1[i]]
                    if any(m["whole"] for m in own):
                        w, n = [], len(w)
                    elif own:
                        mask = tk.inside(np.concatenate([np.asarray(m["cover"], np.int64) for m in own]), len(w))
                        w, n = [w[j] for j in np.flatnonzero(~mask)], int(mask.sum())
                    else:
                        n = 0
                    kept = b" ".join(w)
                    removed.append(n)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept.decode("utf-8", "replace"))
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(s.n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols.append(pa.array(texts, pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    joined = beside(docs, side, numbers, "left").select("doc_id", "text", "gone")
    return map_arrow(joined, work, RESULT_SCHEMA + (", kept string" if with_text else ""))


CLEAN_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
k AS (SELECT x.doc_id, x.i, md5(array_to_string(d.w[x.i:x.i + 49], ' ')) AS h FROM x JOIN d USING (doc_id)),
m AS (SELECT h, min(doc_id) AS least FROM k GROUP BY h),
g AS (SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + 50)) AS j FROM k JOIN m USING (h) WHERE k.doc_id > m.least),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
r AS (SELECT u.doc_id, sha256(string_agg(u.word, ' ' ORDER BY u.j)) AS s FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.j = g.j GROUP BY u.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, coalesce(r.s, sha256('')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)
"""
