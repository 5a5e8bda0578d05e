"""Removal of 100-byte repeats by a hash-compared suffix sort.

Every 100-byte window contains an anchor: the position of its least 24-byte hash (the leftmost one), which is at the
same place in every equal window. Anchors (about one in 39 bytes) are shuffled by their hash; those that occur once
are done. For the others the windows that chose them are cut out with their bytes (at most 176), and per anchor hash
the suffixes that start at the anchors are sorted: a mergesort whose comparisons find the common extension of two
suffixes by binary search over prefix polynomial hashes, and decide by the byte behind it. Neighbours' common lengths
give the classes of equal right parts for every offset of the anchor in the window; windows are equal if their left
parts are equal too. All equalities that hashes claim are verified on the bytes; a collision repeats the sort with
another base. A window is removed if an equal one starts earlier (smaller id, or the same document before it).

Skew: equal texts are settled by two hashes of the whole text; equal cuts within a task's share are settled there;
anchors with ``HOT`` documents or more send single windows with 128-bit hashes, which Spark groups, instead of cuts.

Cases: null and empty texts have no bytes; rows without an id are compared with nothing; rows that repeat an id are
parts of one document in the order of their content hash, equal ones never remove from each other; very long texts
are read whole; an empty table gives an empty result; further columns are dropped.
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

WIDTH = 100
GRAM = 24
REACH = WIDTH - GRAM + 1
LONGEST = WIDTH + REACH - 1
SLICE = 1 << 20
#: Documents from which on an anchor's windows are grouped one by one.
HOT = 20_000
#: Cuts held in a task before equal ones among them are settled.
AT_ONCE = 50_000
BROADCAST_NUMBERS = 2_000_000
BROADCAST_KEYS = 2_000_000
BROADCAST_GROUPS = 500_000
_POS = np.uint64(2**30 - 1)
_LOW = np.uint64(1)


def gram_hashes(buf: np.ndarray, salt: int = 0) -> np.ndarray:
    return tk.window_hashes(tk.BYTE_CODE[buf] ^ np.uint64(salt), GRAM)


def anchors(buf: np.ndarray, offsets: np.ndarray):
    """(row, anchor, first window, last window, key) of each run of windows with the same anchor, byte positions."""
    n = len(buf) - WIDTH + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    if len(buf) > int(_POS):
        raise ValueError("a single text of a gigabyte or more")
    h = gram_hashes(buf)
    packed = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    least, have = packed, 1
    while have * 2 <= REACH:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    least = np.minimum(least[:n], least[REACH - have:REACH - have + n])
    at = (least & _POS).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    lo, hi = offsets[:-1], offsets[1:] - WIDTH + 1
    ok = hi > lo
    np.add.at(inside, lo[ok], 1)
    np.add.at(inside, hi[ok], -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    # windows of neighbouring texts never choose the same anchor, but runs end where a text's windows end
    first = np.flatnonzero(new)
    stop = np.zeros(n, bool)
    stop[:-1] = inside[:-1] & ((at[1:] != at[:-1]) | ~inside[1:])
    stop[-1] = inside[-1]
    last = np.flatnonzero(stop)
    anchor = at[first]
    return np.searchsorted(offsets, first, side="right") - 1, anchor, first, last, h[anchor] & ~_LOW


def content_keys(buf: np.ndarray, offsets: np.ndarray):
    """Two hashes of each whole text."""
    out = []
    for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
        c = np.zeros(len(buf) + 1, np.uint64)
        pos = (np.arange(len(buf)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64)
        np.cumsum(tk.mix(pos * np.uint64(0x9E3779B97F4A7C15) + (tk.BYTE_CODE[buf] ^ salt)), out=c[1:])
        out.append(tk.mix((c[offsets[1:]] - c[offsets[:-1]]) ^ np.diff(offsets).astype(np.uint64)).view(np.int64))
    return out


KEY_SCHEMA = "doc_id long, n_bytes long, k1 long, k2 long, keys array<long>"


def _key_work(batches):
    for batch in batches:
        for lo, hi, part, off in tk.slices(*tk.text_buffer(batch.column(1)), limit=SLICE):
            row, _, _, _, key = anchors(part, off)
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            head = np.flatnonzero(new)
            twice = np.diff(np.append(head, len(row))) > 1
            row, key = row[head], key[head] | twice.astype(np.uint64)  # the lowest bit: more than one anchor in this text
            k1, k2 = content_keys(part, off)
            first = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off), pa.int64()), pa.array(k1), pa.array(k2),
                 pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(key.view(np.int64)))], names=[c.split()[0] for c in KEY_SCHEMA.split(", ")])


SETTLED, CUT, SINGLE = 0, 1, 2
CUT_SCHEMA = "kind int, key long, doc_id long, k1 long, at int, x1 int, x2 int, w1 long, w2 long, body binary"
_NAMES = [c.split()[0] for c in CUT_SCHEMA.split(", ")]


def _first_of(keys, order_by):
    """Index of the least row (by ``order_by``) among those with equal ``keys``, for every row."""
    order = np.lexsort((*reversed(order_by), *reversed(keys)))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys]) if len(order) else True
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def _cut_batch(parts):
    """Rows of one share; cuts or windows equal to an earlier one in the share are settled and lose their bytes."""
    kind, key, doc, k1, at, x1, x2, w1, w2 = (np.concatenate([p[i] for p in parts]) for i in range(9))
    bodies = [b for p in parts for b in p[9]]
    least = _first_of([kind, key, at - x1, x2 - x1, w1, w2], [doc, k1, at])
    gone = np.flatnonzero((doc != doc[least]) | (k1 != k1[least]) | (at != at[least]))
    gone = gone[[bodies[i] == bodies[least[i]] for i in gone]] if len(gone) else gone
    kind = kind.copy()
    kind[gone] = SETTLED
    for i in gone:
        bodies[i] = None
    cols = [pa.array(kind, pa.int32()), pa.array(key), pa.array(doc), pa.array(k1), *[pa.array(c, pa.int32()) for c in (at, x1, x2)], pa.array(w1), pa.array(w2), pa.array(bodies, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def _cut_work(batches):
    parts, held = [], 0
    for batch in batches:
        shared = batch.column(2)
        ends, values = shared.offsets.to_numpy(), shared.values.to_numpy().view(np.uint64)
        ids = batch.column(0).to_numpy()
        for lo, hi, part, off in tk.slices(*tk.text_buffer(batch.column(1)), limit=SLICE):
            row, at, x1, x2, key = anchors(part, off)
            counts = np.diff(ends[lo:hi + 1])
            side = values[ends[lo]:ends[hi]]
            mark = lambda r, k: tk.mix((k & ~_LOW) + r.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            known = mark(np.repeat(np.arange(hi - lo), counts), side)
            order = np.argsort(known)
            known, hot = known[order], (side[order] & _LOW).astype(bool)
            if len(known) == 0 or len(row) == 0:
                continue
            place = np.minimum(np.searchsorted(known, mark(row, key)), len(known) - 1)
            hit = known[place] == mark(row, key)
            row, at, x1, x2, key, hot = row[hit], at[hit], x1[hit], x2[hit], key[hit], hot[place[hit]]
            k1 = content_keys(part, off)[0]
            raw, start = part.tobytes(), off[:-1]
            for single in (False, True):
                use = np.flatnonzero(hot == single)
                if len(use) == 0:
                    continue
                if single:
                    each = x2[use] - x1[use] + 1
                    a = np.repeat(x1[use], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    b, use = a, np.repeat(use, each)
                else:
                    a, b = x1[use], x2[use]
                w1, w2 = _span_hash(part, a, b + WIDTH, 0), _span_hash(part, a, b + WIDTH, 0x452821E638D01377)
                r, s = row[use], start[row[use]]
                anchor = a if single else at[use]
                bodies = [None] * len(a) if single else [raw[i:j] for i, j in zip(a, b + WIDTH)]
                parts.append((np.full(len(a), SINGLE if single else CUT), np.zeros(len(a), np.int64) if single else key[use].view(np.int64), ids[lo:hi][r], k1[r],
                              anchor - s, a - s, b - s, w1.view(np.int64), w2.view(np.int64), bodies))
                held += len(a) if not single else len(a) // 8
            if held >= AT_ONCE:
                yield _cut_batch(parts)
                parts, held = [], 0
    if parts:
        yield _cut_batch(parts)


def _span_hash(buf, a, b, salt):
    codes = tk.mix(tk.BYTE_CODE ^ np.uint64(salt))
    pw, inv = tk._power_table(tk.BASE, len(buf)), tk._power_table(tk._INV_BASE, len(buf))
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(codes[buf] * pw[:len(buf)], out=c[1:])
    return tk.mix((c[b] - c[a]) * inv[a])


# ---- the suffix sort ----------------------------------------------------------------------------------------

class Suffixes:
    """Suffixes (first and last byte of each) of one buffer, compared by prefix polynomial hashes."""

    def __init__(self, buf: np.ndarray, first: np.ndarray, end: np.ndarray, salt: int = 0):
        self.buf, self.first, self.length = buf, first, end - first
        self.codes = tk.mix(tk.BYTE_CODE ^ np.uint64(salt))
        self.inv = tk._power_table(tk._INV_BASE, len(buf))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.codes[buf] * tk._power_table(tk.BASE, len(buf))[:len(buf)], out=self.sums[1:])

    def hash(self, a: np.ndarray, length) -> np.ndarray:
        return (self.sums[a + length] - self.sums[a]) * self.inv[a]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j: the largest at which the prefixes' hashes agree."""
        a, b = self.first[i], self.first[j]
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.hash(a, mid) == self.hash(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j (a prefix before what it begins)."""
        k = self.common(i, j)
        end_i, end_j = k >= self.length[i], k >= self.length[j]
        last = len(self.buf) - 1
        byte = self.buf[np.minimum(self.first[i] + k, last)] < self.buf[np.minimum(self.first[j] + k, last)]
        return np.where(end_i | end_j, end_i & ~end_j, byte)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within their groups (rows of a group are consecutive), by a bottom-up mergesort.

        Runs of a group are merged pairwise, all pairs at once: an element's place is its place in its own run plus
        the number of elements of the other run before it, found by binary search."""
        n = len(group)
        order = np.arange(n)
        if n == 0:
            return order
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(edge, n))
        start = np.repeat(edge, size)
        stop = start + np.repeat(size, size)
        place = np.arange(n) - start
        run, widest = 1, int(size.max())
        while run < widest:
            live = np.flatnonzero(stop - start > run)
            own = place[live] // run
            left = own % 2 == 0
            other = start[live] + np.where(left, own + 1, own - 1) * run
            lo = np.minimum(other, stop[live])
            hi = np.minimum(other + run, stop[live])
            base = lo.copy()
            me = order[live]
            while (open_ := lo < hi).any():
                at = np.flatnonzero(open_)
                mid = (lo[at] + hi[at]) >> 1
                them, mine = order[mid], me[at]
                # equal suffixes keep their order: the left run's come first
                before = np.where(left[at], self.less(them, mine), ~self.less(mine, them))
                lo[at] = np.where(before, mid + 1, lo[at])
                hi[at] = np.where(before, hi[at], mid)
            pair = start[live] + (own // 2) * 2 * run
            new = order.copy()
            new[pair + place[live] % run + (lo - base)] = me
            order = new
            run *= 2
        return order


def repeats(body: list[bytes], key, doc, k1, at, x1, x2):
    """(row, first window, last window) runs of windows that an earlier row's window equals. Rows come by key."""
    n = len(key)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((at, k1, doc))] = np.arange(n)
    same = np.lexsort((at, k1, doc))
    tie = np.zeros(n, bool)
    tie[1:] = (doc[same][1:] == doc[same][:-1]) & (k1[same][1:] == k1[same][:-1]) & (at[same][1:] == at[same][:-1])
    rank[same] = np.maximum.accumulate(np.where(tie, 0, np.arange(n)))  # equal rows of one id are not earlier than each other
    buf = np.frombuffer(b"".join(body), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(b) for b in body])])
    anchor = begin[:-1] + (at - x1)
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
    for salt in (0, 0xBE5466CF34E90C6C, 0xC0AC29B7C97C50DD, 0x3F84D5B5B5470917):
        s = Suffixes(buf, anchor, begin[1:], salt)
        order = s.sort(group)
        lcp = np.zeros(n, np.int64)
        near = group[order][1:] == group[order][:-1]
        i, j = order[:-1][near], order[1:][near]
        lcp[1:][near] = s.common(i, j)
        if not _agree(buf, anchor[i], anchor[j], lcp[1:][near]):
            continue
        found = _equal_windows(s, buf, group, order, lcp, rank, anchor, at - x1, at - x2)
        if found is not None:
            break
    else:
        raise RuntimeError("hash collisions under four bases")
    row, offset = found
    if len(row) == 0:
        return row, row, row
    x = at[row] - offset
    o = np.lexsort((x, row))
    row, x = row[o], x[o]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (x[1:] != x[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1
    return row[head], x[head], x[tail]


def _agree(buf, a, b, length) -> bool:
    """Whether bytes a.. and b.. are equal over the lengths."""
    if len(a) == 0:
        return True
    last = len(buf) - 1
    step = np.arange(int(length.max()))
    inside = step[None, :] < length[:, None]
    return bool(((buf[np.minimum(a[:, None] + step, last)] == buf[np.minimum(b[:, None] + step, last)]) | ~inside).all())


def _equal_windows(s, buf, group, order, lcp, rank, anchor, most, least):
    """(row, offset of the anchor in the window) of windows with an earlier equal; None if a hash lied."""
    rows, offsets = [], []
    fresh = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    for o in range(int(most.max()) + 1 if len(most) else 0):
        # equal right parts: neighbours in the suffix order with a common extension of 100 - o bytes
        part = np.empty(len(order), np.int64)
        part[order] = np.cumsum(fresh | (lcp < WIDTH - o))
        use = np.flatnonzero((least <= o) & (o <= most))
        if len(use) < 2:
            continue
        left = s.hash(anchor[use] - o, o)
        first = use[_first_of([part[use], left], [rank[use]])]
        hit = rank[first] < rank[use]
        if not _agree(buf, anchor[use[hit]] - o, anchor[first[hit]] - o, np.full(int(hit.sum()), WIDTH)):
            return None
        rows.append(use[hit])
        offsets.append(np.full(int(hit.sum()), o))
    z = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(offsets)) if rows else (z, z)


INTERVAL_SCHEMA = "doc_id long, k1 long, x1 int, x2 int"


def _sort_work(batches):
    """Rows arrive sorted by key; whole groups are sorted together."""
    held = None
    for batch in batches:
        batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if len(batch) == 0:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        held = batch.slice(cut)
        if cut:
            yield _sorted_batch(batch.slice(0, cut))
    if held is not None and len(held):
        yield _sorted_batch(held)


def _sorted_batch(batch):
    key, doc, k1, at, x1, x2 = (batch.column(c).to_numpy() for c in ("key", "doc_id", "k1", "at", "x1", "x2"))
    at, x1, x2 = (c.astype(np.int64) for c in (at, x1, x2))
    row, a, b = repeats(batch.column("body").to_pylist(), key, doc, k1, at, x1, x2)
    return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(k1[row]), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "k1", "x1", "x2"])


def _beside(docs, side, numbers, how):
    return docs.join(F.broadcast(side) if numbers <= BROADCAST_NUMBERS else side, "doc_id", how)


def removed_windows(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, k1, cover, whole): bytes to remove in the row of that id and content; ``whole``: all of them."""
    table = written(map_arrow(docs, _key_work, KEY_SCHEMA), "anchors")
    table = table.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= WIDTH))
    least = written(table.groupBy("n_bytes", "k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"), "least")
    copies = written(table.select("doc_id", "n_bytes", "k1", "k2").join(broadcast_if(least, BROADCAST_GROUPS), ["n_bytes", "k1", "k2"]).where(F.col("doc_id") > F.col("least"))
                     .select("doc_id", "k1").distinct(), "copies")
    alone = (_beside(table.select("doc_id", "k1", "keys"), copies.select("doc_id", F.col("k1").alias("c")), copies.count() * 2, "left")
             .where(F.col("c").isNull() | (F.col("c") != F.col("k1"))).select("doc_id", F.explode("keys").alias("v")))
    alone = alone.select("doc_id", F.expr("v & -2").alias("key"), F.expr("v & 1").alias("twice"))
    # counts are reduced before the shuffle; the join back can be split at anchors that very many documents have
    shared = (alone.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("twice").alias("twice"), F.count(F.lit(1)).alias("n"))
              .where((F.col("lo") < F.col("hi")) | (F.col("twice") == 1)).select("key", (F.col("n") >= hot).cast("long").alias("hot")))
    shared = written(shared, "shared")
    needed = written(alone.join(broadcast_if(shared, BROADCAST_KEYS), "key")
                     .groupBy("doc_id").agg(F.collect_set(F.expr("key | hot")).alias("shared")), "needed")
    # the keys grow with the corpus at every size: both sides are shuffled unless Spark itself finds the keys tiny
    cuts = written(map_arrow(docs.where("doc_id is not null").join(needed, "doc_id").select("doc_id", "text", "shared"), _cut_work, CUT_SCHEMA), "cuts")
    by_sort = map_arrow(cuts.where(F.col("kind") == CUT).select("key", "doc_id", "k1", "at", "x1", "x2", "body").repartition("key").sortWithinPartitions("key"), _sort_work, INTERVAL_SCHEMA)
    one = cuts.where(F.col("kind") == SINGLE).withColumn("o", F.struct("doc_id", "k1", "x1"))
    one = one.withColumn("first", F.min("o").over(W.partitionBy("w1", "w2"))).where(F.col("o") > F.col("first"))
    cols = ["doc_id", "k1", "x1", "x2"]
    gone = by_sort.union(cuts.where(F.col("kind") == SETTLED).select(*cols)).union(one.select(*cols))
    gone = gone.groupBy("doc_id", "k1").agg(F.collect_list("x1").alias("x1"), F.collect_list("x2").alias("x2"))
    gone = map_arrow(gone, _cover_work, COVER_SCHEMA)
    gone = gone.join(copies, ["doc_id", "k1"], "left_anti").select("doc_id", "k1", "cover", F.lit(False).alias("whole"))
    return gone.union(copies.select("doc_id", "k1", F.array().cast("array<int>"), F.lit(True)))


COVER_SCHEMA = "doc_id long, k1 long, cover array<int>"


def _cover_work(batches):
    """Runs of window starts of a row to the bytes they cover, as merged intervals."""
    for batch in batches:
        covers = []
        for a, b in zip(batch.column(2), batch.column(3)):
            covers.append(tk.merged(a.values.to_numpy().astype(np.int64), b.values.to_numpy().astype(np.int64) + WIDTH).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(covers, pa.list_(pa.int32()))], names=["doc_id", "k1", "cover"])


RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cleaned(docs: DataFrame, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = written(removed_windows(docs, hot), "gone")
    numbers = gone.agg(F.sum(F.size("cover") + 4)).first()[0] or 0
    side = gone.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "whole", "cover")).alias("gone"))

    def work(batches):
        for batch in batches:
            marks = batch.column(2)
            for lo, hi, part, off in tk.slices(*tk.text_buffer(batch.column(1)), limit=SLICE):
                k1 = None
                removed, spans, digests, texts = [], [], [], []
                for i in range(hi - lo):
                    b = part[off[i]:off[i + 1]]
                    n = count = 0
                    if marks[lo + i].is_valid:
                        k1 = content_keys(part, off)[0] if k1 is None else k1
                        own = [m for m in marks[lo + i].as_py() if m["k1"] == k1[i]]
                        if any(m["whole"] for m in own):
                            b, n, count = b[:0], len(b), 1
                        elif own:
                            mask = tk.inside(np.concatenate([np.asarray(m["cover"], np.int64) for m in own]), len(b))
                            n, count = int(mask.sum()), int((mask[1:] & ~mask[:-1]).sum() + mask[0])
                            b = b[~mask]
                    kept = b.tobytes()
                    removed.append(n)
                    spans.append(count)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept)
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
                names = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
                if with_text:
                    cols.append(pa.array(texts, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    joined = _beside(docs, side, numbers, "left").select("doc_id", "text", "gone")
    return map_arrow(joined, work, RESULT_SCHEMA + (", kept binary" if with_text else ""))
