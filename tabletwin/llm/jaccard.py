"""Exact n-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

A document's set holds the distinct 5-word shingles of its whole lower-cased text (fewer words: all of them as one).
Two documents link if their sets' Jaccard similarity is 0.8 or more. Linked sets share a shingle among the first
n // 5 + 1 of each in any common order, so documents meet in tiles: one for each such shingle, sorted by set size.
In a tile a document meets only those in its size band (sizes within a factor 0.8) that its shingle's rank allows.
Pairs that pass are bounded from above by bit counts: each set has a parity bitmap, as wide as its size band asks,
and two sets differ in at least as many shingles as their bitmaps differ in bits. Large tiles do so before they give
pairs away. What is left is decided by exact
intersection of the sorted arrays.

Shingles in very many documents come last in the order, so tiles stay small; the list of these is bounded. Equal
sets are one node. Every pair of nodes that shares a tile is bounded and decided, so all links between different sets
come out, also those within a large group of near copies (whose number grows with the square of the group). Tiles of
many documents are dealt into blocks, and each pair of blocks is a task's tile of its own. A pair meets once in most
cases: a tile leaves it out if one of the first shingles of both, before the tile's, has already made it meet.

Components need only a spanning set of links (``keep_one``, ``component_rows``): near copies are first joined along
stars around the least and the largest member of equal min-hashes, and tiles then compare only documents that no link
has joined yet.

The number of links of each document needs no links as rows (``link_counts``). Every link lies within a component, so a
component's documents are dealt into bands of size and these into blocks; each pair of blocks whose sizes can link is
a tile of its own, where bitmaps bound and sorted arrays decide all its pairs, and one number per document leaves it.
A pair of documents meets in exactly one tile. A large group of near copies is spread over its tiles, and what travels
is its arrays, once for each tile of their block.

``join(docs).links`` lists all links between class representatives; their number, as that of any such list, grows
with the square of a group of near copies.

Cases: null and empty texts have empty sets and link with nothing; rows without an id link with nothing and have no
component; rows that repeat an id are one document; very long texts are read whole; an empty table gives an empty
result; further columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabletwin.llm import tokens as tk
from tabletwin.llm.components import components
from tabletwin.llm.store import broadcast_if, in_fewer_files, map_arrow, written

SHINGLE = 5
#: Similar: 100 * intersection >= 80 * union, that is 9 * intersection >= 4 * (sum of sizes).
NUM, DEN = 9, 4
#: At most this many frequent shingles are broadcast (12 bytes each); they come last in the order of shingles.
FREQUENT = 1 << 18
FREQUENT_LEAST = 8
#: Shingles counted at once in a task; those seen less than SEEN_LEAST times there count as rare.
COUNT_AT_ONCE = 4_000_000
SEEN_LEAST = 2
#: Bytes of text that a task turns into shingles at a time: arrays of eight bytes for each of them are made on the way.
SLICE_BYTES = 1 << 18
#: Widths of the bitmaps, in bits.
BITS = (64, 4096)
#: Ids up to this many are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Groups of equal sets up to this many are broadcast.
BROADCAST_GROUPS = 500_000
MINHASHES = 3
#: Tiles with more documents than this compare bitmaps before they give pairs away.
SMALL_TILE = 8
#: Tiles with more documents than this are dealt into blocks of about this many.
TILE_BLOCK = 512
#: The first shingles by which a tile knows that a pair has met before.
HEAD = 4
#: Documents of a block of a component (and at most BLOCK_SHINGLES shingles); bands of size by this factor, a little more
#: than 1.25, so that documents that link are in one band or in neighbouring ones.
COUNT_BLOCK, BAND = 512, 1.26
#: Documents and shingles of one block whose arrays meet those of another (or its own) in a task.
PAIR_BLOCK, BLOCK_SHINGLES = 64, 1 << 20


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the index of each row's first (rows + 1 entries)."""
    starts, ends, first = tk.word_bounds(buf, offsets)
    h = tk.span_hashes(tk.LOWER[buf], starts, ends)
    n_rows, n_words = len(offsets) - 1, np.diff(first)
    row = np.repeat(np.arange(n_rows), n_words)
    grams = tk.gram_hashes(h, SHINGLE)
    inside = row[:len(grams)] == row[SHINGLE - 1:] if len(grams) else np.zeros(0, bool)
    rows, keys = [row[:len(grams)][inside]], [grams[inside]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(n_words == n)
        if len(short):
            whole = tk.gram_hashes(h, n) if n > 1 else tk.mix(h)
            rows.append(short)
            keys.append(tk.mix(whole[first[short]] + np.uint64(n)))
    row, key = np.concatenate(rows), np.concatenate(keys)
    out, count = [], np.zeros(n_rows + 1, np.int64)
    order = np.argsort(row, kind="stable")
    row, key = row[order], key[order]
    at = np.searchsorted(row, np.arange(n_rows + 1))
    for i in range(n_rows):
        s = np.sort(key[at[i]:at[i + 1]])
        if len(s) > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
        count[i + 1] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(count)


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _seen_often(keys: np.ndarray) -> pa.RecordBatch:
    """(h, n): the keys seen SEEN_LEAST times or more. ``keys`` is sorted in place, as a task's largest array."""
    keys.sort()
    edge = np.ones(len(keys) + 1, bool)
    np.not_equal(keys[1:], keys[:-1], out=edge[1:-1])
    far = max(len(keys) - SEEN_LEAST + 1, 0)  # a run that starts there or later is too short
    long = keys[:far] == keys[SEEN_LEAST - 1:]
    first, last = np.flatnonzero(edge[:far] & long), np.flatnonzero(edge[SEEN_LEAST:] & long) + SEEN_LEAST - 1
    return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(last - first + 1, pa.int64())], names=["h", "n"])


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, ranks): the most frequent shingles, at most FREQUENT of them."""
    def work(batches):
        held, n = np.empty(COUNT_AT_ONCE, np.uint64), 0
        for batch in batches:
            for _, _, part, off in tk.slices(*tk.text_buffer(batch.column(1)), SLICE_BYTES):
                s, _ = shingle_sets(part, off)
                if n + len(s) > len(held):
                    held = np.concatenate([held[:n], s])
                held[n:n + len(s)] = s
                n += len(s)
                if n >= COUNT_AT_ONCE:
                    yield _seen_often(held[:n])
                    n = 0
        if n:
            yield _seen_often(held[:n])

    seen = map_arrow(docs, work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST)
    top = seen.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by_hash = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(len(h))
    return h[by_hash], rank[by_hash].astype(np.int32)


SET_SCHEMA = "doc_id long, n long, k1 long, k2 long, minhash array<long>, bitmap binary, prefix array<long>"


def band_bits(n: int) -> int:
    return min(max(BITS[0], 1 << max(0, int(n) - 1).bit_length()), BITS[1])


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of band_bits(n) classes."""
    bits = band_bits(len(s))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(a: bytes, n_bytes: int) -> np.ndarray:
    """A parity bitmap at a smaller width: its parts added modulo 2."""
    return np.bitwise_xor.reduce(np.frombuffer(a, np.uint8).reshape(-1, n_bytes), axis=0)


def fewest_different(a: bytes, b: bytes) -> int:
    """Sets with these bitmaps differ in at least so many shingles."""
    w = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, w) ^ fold(b, w)).sum())


def may_link(n_a: int, n_b: int, different: int) -> bool:
    """Whether the overlap's upper bound (n_a + n_b - different) / 2 suffices."""
    return NUM * (n_a + n_b - different) >= 2 * DEN * (n_a + n_b)


def sets(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Size, content keys, min-hashes, bitmap and prefix of each document's set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    salts = [np.uint64(0xA24BAED4963EE407 * (2 * i + 1) % 2**64) for i in range(MINHASHES)]

    def work(batches):
        often, rank = shared.value
        for batch in batches:
            for lo, hi, part, off in tk.slices(*tk.text_buffer(batch.column(1)), SLICE_BYTES):
                s, first = shingle_sets(part, off)
                n = np.diff(first)
                full = np.flatnonzero(n)
                cols = [np.zeros(hi - lo, np.int64) for _ in range(2)]
                mins = np.zeros((hi - lo, MINHASHES), np.int64)
                if len(full):
                    at = first[full]
                    cols[0][full] = np.add.reduceat(tk.mix(s), at).view(np.int64)
                    cols[1][full] = np.add.reduceat(tk.mix(s ^ np.uint64(0x5851F42D4C957F2D)), at).view(np.int64)
                    for k, salt in enumerate(salts):
                        mins[full, k] = np.minimum.reduceat(tk.mix(s ^ salt), at).view(np.int64)
                place = np.full(len(s), -1, np.int64)
                if len(often):
                    i = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    hit = often[i] == s
                    place[hit] = rank[i[hit]]
                maps, prefixes, ends = [], [], [0]
                for r in range(hi - lo):
                    a, b = first[r], first[r + 1]
                    maps.append(bitmap(s[a:b]))
                    take = (b - a) // 5 + 1 if b > a else 0
                    own, p = s[a:b], place[a:b]
                    rare = own[p < 0]
                    if len(rare) >= take:
                        chosen = rare[:take]
                    else:
                        late = np.flatnonzero(p >= 0)
                        chosen = np.concatenate([rare, own[late[np.argsort(p[late])][:take - len(rare)]]])
                    prefixes.append(chosen)
                    ends.append(ends[-1] + len(chosen))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(cols[0]), pa.array(cols[1]),
                     pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * MINHASHES, pa.int32()), pa.array(mins.ravel())),
                     pa.array(maps, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes).view(np.int64)))],
                    names=[c.split()[0] for c in SET_SCHEMA.split(", ")])

    return map_arrow(docs, work, SET_SCHEMA)


def arrays(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles): the sorted shingles of the documents whose id is in ``ids`` (doc_id, distinct)."""
    def work(batches):
        for batch in batches:
            for lo, hi, part, off in tk.slices(*tk.text_buffer(batch.column(1)), SLICE_BYTES):
                s, first = shingle_sets(part, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([s[first[i]:first[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], names=["doc_id", "shingles"])

    small = ids.count() <= BROADCAST_IDS
    return map_arrow(docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi"), work, "doc_id long, shingles binary").dropDuplicates(["doc_id"])


def by_bitmap(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave enough overlap."""
    def work(batches):
        for batch in batches:
            n_a, n_b = (batch.column(c).to_pylist() for c in ("n_a", "n_b"))
            m_a, m_b = (batch.column(c).to_pylist() for c in ("m_a", "m_b"))
            ok = [may_link(x, y, fewest_different(p, q)) for x, y, p, q in zip(n_a, n_b, m_a, m_b)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda s: nodes.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bitmap").alias(f"m_{s}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    joined = joined.where(F.least("n_a", "n_b") * 5 >= F.greatest("n_a", "n_b") * 4)
    return map_arrow(joined.select("a", "b", "n_a", "n_b", "m_a", "m_b"), work, "a long, b long")


def by_arrays(pairs: DataFrame, sets_of: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection, with the intersection's size."""
    def work(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            common, ok = [], []
            for i in range(len(batch)):
                s, t = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), max(len(t) - 1, 0))
                both = int((t[at] == s).sum()) if len(t) else 0
                common.append(both)
                ok.append(NUM * both >= DEN * (len(s) + len(t)))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64())], names=["a", "b", "common"])
            yield out.filter(pa.array(ok, pa.bool_()))

    side = lambda s, name: sets_of.select(F.col("doc_id").alias(s), F.col("shingles").alias(name))
    return map_arrow(pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y"), work, "a long, b long, common long")


def by_blocks(pairs: DataFrame, sets_of: DataFrame, part: DataFrame) -> DataFrame:
    """What ``by_arrays`` gives, with arrays sent once for each pair of blocks: ``part`` (doc_id, n, part) has the part of
    every node; a part's documents are dealt into blocks."""
    def work(batches):
        key, own = None, None
        for batch in batches:
            k = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])) if len(k) else [0]
            out = []
            for lo, hi in zip(edge[:-1], edge[1:]):
                if key is None or k[lo] != key:
                    key, own = k[lo], Block()
                rows = batch.slice(lo, hi - lo)
                sent = rows.filter(rows.column("b").is_null())
                own.add(sent.column("a").to_pylist(), [np.frombuffer(x, np.uint64) for x in sent.column("shingles").to_pylist()])
                asked = rows.filter(rows.column("b").is_valid())
                if len(asked):
                    out.append(own.links(asked.column("a").to_numpy(), asked.column("b").to_numpy()))
            if out:
                a, b, common = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(common)], names=["a", "b", "common"])

    size = part.groupBy("part").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PAIR_BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    block = part.join(size, "part").select("doc_id", F.xxhash64("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), "blocks")).alias("block")).dropDuplicates(["doc_id"])
    side = lambda s: block.select(F.col("doc_id").alias(s), F.col("block").alias(f"k_{s}"))
    keyed = pairs.join(side("b"), "b").join(side("a"), "a").select(F.xxhash64(F.least("k_a", "k_b"), F.greatest("k_a", "k_b")).alias("k"), "a", "b")
    keyed = written(keyed, "keyed")
    wanted = keyed.select("k", "a").union(keyed.select("k", "b")).distinct()
    sent = wanted.join(sets_of.withColumnRenamed("doc_id", "a"), "a").select("k", "a", F.lit(None).cast("long").alias("b"), "shingles")
    both = sent.union(keyed.select("k", "a", "b", F.lit(None).cast("binary")))
    return map_arrow(both.repartition("k").sortWithinPartitions("k", F.col("b").asc_nulls_first()), work, "a long, b long, common long")


class Block:
    """The sorted arrays of the documents of two blocks and the exact intersections of their pairs."""

    def __init__(self):
        self.at, self.sets, self.table = {}, [], None

    def add(self, ids, sets):
        for i, s in zip(ids, sets):
            self.at[i] = len(self.sets)
            self.sets.append(s)

    def _all(self) -> np.ndarray:
        """Intersection sizes of all pairs of two, a slice of the shingles at a time."""
        m = len(self.sets)
        code, doc = np.concatenate(self.sets), np.repeat(np.arange(m), [len(s) for s in self.sets])
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order]
        out = np.zeros((m, m))
        # shingles of one document only are in no intersection of two
        same = code[1:] == code[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        code, doc = code[shared], doc[shared]
        if len(code) == 0:
            return out.astype(np.int64)
        column = np.cumsum(np.concatenate([[False], code[1:] != code[:-1]]))
        for lo in range(0, int(column[-1]) + 1, 4096):
            s, e = np.searchsorted(column, [lo, lo + 4096])
            x = np.zeros((m, 4096), np.float32)
            x[doc[s:e], column[s:e] - lo] = 1
            out += x @ x.T
        return out.astype(np.int64)

    def links(self, a, b):
        """The pairs that link, and their common shingles."""
        x, y = np.array([self.at[i] for i in a.tolist()]), np.array([self.at[i] for i in b.tolist()])
        if self.table is None and len(x) > 4 * len(self.sets):
            self.table = self._all()
        if self.table is not None:
            common = self.table[x, y]
        else:
            common = np.zeros(len(x), np.int64)
            for i, (p, q) in enumerate(zip(x, y)):
                s, t = sorted((self.sets[p], self.sets[q]), key=len)
                common[i] = (t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()
        n = np.array([len(s) for s in self.sets])
        ok = NUM * common >= DEN * (n[x] + n[y])
        return a[ok], b[ok], common[ok]


def star_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) between the least and the largest node of each group of equal min-hashes and its other members."""
    hashes = nodes.select("doc_id", F.posexplode("minhash").alias("k", "m"))
    groups = hashes.groupBy("k", "m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where(F.col("lo") < F.col("hi"))
    joined = hashes.join(groups, ["k", "m"])
    pair = lambda p: joined.select(F.least("doc_id", p).alias("a"), F.greatest("doc_id", p).alias("b"))
    return pair("lo").union(pair("hi")).where(F.col("a") != F.col("b")).distinct()


def tile_pairs(nodes: DataFrame) -> DataFrame:
    """Distinct pairs of nodes (doc_id, n, bitmap, prefix, part) of different parts that share a tile, by size and rank."""
    rows = nodes.select("doc_id", "part", "n", F.posexplode("prefix").alias("rank", "h"))
    rows = rows.select("h", "doc_id", "part", F.expr("n * 4294967296 + rank").alias("tag"))
    tile = W.partitionBy("h")
    # tiles of one part, single documents among them, end here: nothing in them is left to decide
    rows = rows.withColumn("lo", F.min("part").over(tile)).withColumn("hi", F.max("part").over(tile)).withColumn("size", F.count(F.lit(1)).over(tile))
    rows = written(rows.where(F.col("lo") < F.col("hi")).drop("lo", "hi"), "mixed")
    by_tile = lambda df: df.repartition("h").sortWithinPartitions("h", "tag")
    small = rows.where(F.col("size") <= SMALL_TILE).select("h", "doc_id", "part", "tag")
    large = rows.where(F.col("size") > SMALL_TILE).select("h", "doc_id", "part", "tag").join(nodes.select("doc_id", "bitmap"), "doc_id").select("h", "doc_id", "part", "tag", "bitmap")
    pairs = map_arrow(by_tile(small), _tile_work, "a long, b long").union(map_arrow(by_tile(large), _tile_work, "a long, b long"))
    return pairs.distinct()


def every_pair(nodes: DataFrame) -> DataFrame:
    """Distinct pairs of nodes (doc_id, n, bitmap, prefix) that share a tile, by size, rank and bitmap."""
    rows = nodes.select("doc_id", "n", F.posexplode("prefix").alias("rank", "h"))
    # tiles are counted by a reduction, so no tile's rows gather; single documents end here
    size = rows.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = rows.join(size, "h").select("h", "doc_id", F.expr("n * 4294967296 + rank").alias("tag"), "size")
    rows = written(rows, "shared")
    head = nodes.select("doc_id", "n", F.expr(f"transform(slice(prefix, 1, {HEAD}), x -> lpad(hex(x), 16, '0'))").alias("words"), "bitmap")
    head = head.select("doc_id", "n", F.unhex(F.concat_ws("", "words")).alias("head"), "bitmap")
    # rows of one id with different texts keep the head and bitmap of their own size
    of = rows.withColumn("n", F.shiftright("tag", 32))
    by_tile = lambda df: df.repartition("h").sortWithinPartitions("h", "tag")
    small = of.where(F.col("size") <= SMALL_TILE).join(head.drop("bitmap"), ["doc_id", "n"]).select("h", "doc_id", F.col("doc_id").alias("part"), "tag", "head")
    large = of.where(F.col("size") > SMALL_TILE)
    blocks = F.ceil(F.col("size") / TILE_BLOCK)
    large = large.withColumn("mine", F.pmod(F.xxhash64("doc_id", F.lit(3)), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    # within one block documents differ, between two blocks only those of different blocks are compared
    large = large.select(F.xxhash64("h", F.least("mine", "other"), F.greatest("mine", "other")).alias("h"), "doc_id", "n", "tag",
                         F.when(F.col("mine") == F.col("other"), F.col("doc_id")).otherwise(F.col("mine")).alias("part"))
    large = large.join(head, ["doc_id", "n"]).select("h", "doc_id", "part", "tag", "head", "bitmap")
    few = by_bitmap(map_arrow(by_tile(small), _tile_work, "a long, b long").distinct(), nodes)
    return few.union(map_arrow(by_tile(large), _tile_work, "a long, b long")).distinct()


def _tile_work(batches):
    """Rows (h, doc_id, part, tag[, head][, bitmap]) sorted by h and tag; whole tiles are compared together."""
    held = None
    for batch in batches:
        if held is not None and len(held):
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if len(batch) == 0:
            continue
        h = batch.column(0).to_numpy()
        cut = int(np.searchsorted(h, h[-1]))
        held = batch.slice(cut)
        if cut:
            yield from _tile_batches(batch.slice(0, cut))
    if held is not None and len(held):
        yield from _tile_batches(held)


def _allowed(x, y, n, rank, part):
    """Mask of index pairs (x before y in the tile, so n[x] <= n[y]) that can link and are not joined yet."""
    most = np.minimum(rank[x], rank[y]) + np.minimum(n[x] - rank[x], n[y] - rank[y])
    return (part[x] != part[y]) & (5 * n[x] >= 4 * n[y]) & (NUM * most >= DEN * (n[x] + n[y]))


def _heads(batch, rank) -> tuple[np.ndarray, np.ndarray] | None:
    """The first shingles of each row that come before the tile's; two sets of fillers that equal nothing."""
    if "head" not in batch.schema.names:
        return None
    own = np.zeros((len(batch), HEAD), ">u8")
    for i, raw in enumerate(batch.column("head").to_pylist()):
        v = np.frombuffer(raw, ">u8")
        own[i, :len(v)] = v
    before = np.arange(HEAD) < rank[:, None]
    own = own.astype(np.uint64)
    return np.where(before, own, np.uint64(1)), np.where(before, own, np.uint64(2))


def _unmet(heads, x, y):
    """Mask of index pairs that no tile of their first shingles has seen."""
    if heads is None:
        return np.ones(len(x), bool)
    met = np.zeros(len(x), bool)
    for i in range(HEAD):
        left = heads[0][x, i]
        for j in range(HEAD):
            met |= left == heads[1][y, j]
    return ~met


class Bitmaps:
    """Bitmaps of a tile's documents in size order: equal widths are consecutive."""

    def __init__(self, maps: list[bytes]):
        self.width = np.array([len(m) for m in maps])
        edge = np.flatnonzero(np.concatenate([[True], self.width[1:] != self.width[:-1], [True]]))
        self.bands = [(a, b, np.frombuffer(b"".join(maps[a:b]), np.uint8).reshape(b - a, -1)) for a, b in zip(edge[:-1], edge[1:])]
        self.folded = {}

    def _at(self, band: int, width: int) -> np.ndarray:
        if (band, width) not in self.folded:
            m = self.bands[band][2]
            m = np.bitwise_xor.reduce(m.reshape(len(m), -1, width), axis=1)
            self.folded[band, width] = np.ascontiguousarray(m).view(np.uint64)
        return self.folded[band, width]

    def different(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Least differences between document i and documents lo..hi-1."""
        out = np.zeros(hi - lo, np.int64)
        mine = next(k for k, (a, b, _) in enumerate(self.bands) if a <= i < b)
        for k, (a, b, _) in enumerate(self.bands):
            s, e = max(a, lo), min(b, hi)
            if s < e:
                w = int(min(self.width[i], self.width[a]))
                v = self._at(mine, w)[i - self.bands[mine][0]]
                out[s - lo:e - lo] = np.bitwise_count(self._at(k, w)[s - a:e - a] ^ v).sum(1)
        return out


def _tile_batches(batch):
    h, doc, part, tag = (batch.column(i).to_numpy() for i in range(4))
    n, rank = tag >> 32, tag & 0xFFFFFFFF
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    heads = _heads(batch, rank)
    found_a, found_b, held = [], [], 0
    if "bitmap" not in batch.schema.names:
        # small tiles: all of a batch at once, one distance after the other
        tile = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        for step in range(1, SMALL_TILE):
            x = np.flatnonzero(tile[:-step] == tile[step:])
            if len(x) == 0:
                break
            x = x[_allowed(x, x + step, n, rank, part)]
            x = x[_unmet(heads, x, x + step)]
            found_a.append(doc[x])
            found_b.append(doc[x + step])
    else:
        # large tiles: documents outside the tile's main part against the band of sizes that they may link with
        for lo, hi in zip(edge[:-1], edge[1:]):
            maps = Bitmaps(batch.column("bitmap").slice(lo, hi - lo).to_pylist())
            _, inverse, counts = np.unique(part[lo:hi], return_inverse=True, return_counts=True)
            main = inverse == counts.argmax()
            sizes = n[lo:hi]
            for i in np.flatnonzero(~main):
                a = lo + int(np.searchsorted(5 * sizes, 4 * sizes[i]))
                b = lo + int(np.searchsorted(4 * sizes, 5 * sizes[i], side="right"))
                me = lo + i
                other = np.arange(a, b)
                other = other[(other > me) | main[other - lo]]
                first, second = np.minimum(other, me), np.maximum(other, me)
                ok = _allowed(first, second, n, rank, part)
                first, second = first[ok], second[ok]
                ok = _unmet(heads, first, second)
                first, second = first[ok], second[ok]
                if len(first) == 0:
                    continue
                seen = np.where(first == me, second, first)
                differ = maps.different(i, a - lo, b - lo)[seen - a]
                ok = NUM * (n[first] + n[second] - differ) >= 2 * DEN * (n[first] + n[second])
                found_a.append(doc[first[ok]])
                found_b.append(doc[second[ok]])
                held += int(ok.sum())
                if held > 500_000:
                    yield _pair_batch(found_a, found_b)
                    found_a, found_b, held = [], [], 0
    if found_a:
        yield _pair_batch(found_a, found_b)


def _pair_batch(found_a, found_b):
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return pa.RecordBatch.from_arrays([pa.array(lo[new]), pa.array(hi[new])], names=["a", "b"])


@dataclass
class Join:
    members: DataFrame  # doc_id, n, rep (least id with the same set; itself if the set is empty), copied
    links: DataFrame  # a, b, common: all links between representatives (spanning: enough of them for every component)
    parts: DataFrame  # node, component: representatives with links
    arrays: DataFrame  # doc_id, shingles: the sorted shingles of the representatives that were compared, all in parts


def join(docs: DataFrame, spanning: bool = False) -> Join:
    """All links; with ``spanning`` only as many as the components need."""
    docs = _ids(docs)
    table = written(sets(docs, frequent_shingles(docs)), "sets")
    key = ["n", "k1", "k2"]
    full = table.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # groups are reduced before the shuffle; only those of two rows or more are joined back
    copies = full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    copies = written(in_fewer_files(copies, table.count()), "copies")
    marked = table.join(broadcast_if(copies, BROADCAST_GROUPS), key, "left")
    rep = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    members = written(marked.select("doc_id", "n", rep.alias("rep"), F.col("rep").isNotNull().alias("copied")), "members")
    single = marked.where((F.col("n") > 0) & F.col("doc_id").isNotNull() & (F.col("rep").isNull() | (F.col("rep") == F.col("doc_id"))))
    # an id can stand for more than one row: equal rows, or other texts under the same id
    own = single.drop("rep", "k1", "k2")
    nodes = written(own if _unique(members) else own.dropDuplicates(["doc_id", "n", "minhash"]), "nodes")

    stars = written(by_bitmap(star_pairs(nodes), nodes), "stars")
    ends = lambda p: p.select(F.col("a").alias("doc_id")).union(p.select("b")).distinct()
    known = written(arrays(docs, ends(stars)), "arrays")
    first = written(by_arrays(stars, known), "links")
    part = components(first)

    parted = (nodes.select("doc_id", "n", "bitmap", "prefix").join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left")
              .select("doc_id", "n", "bitmap", "prefix", F.coalesce("component", "doc_id").alias("part")))
    more = written(by_bitmap(tile_pairs(parted), nodes) if spanning else every_pair(nodes), "tiles")
    missing = ends(more).join(known.select("doc_id"), "doc_id", "left_anti")
    known = known.union(written(arrays(docs, missing), "arrays"))
    if spanning:
        links = first.union(written(by_arrays(more, known), "links"))
        return Join(members, links, written(components(links.union(_same_id(members))), "parts"), known)
    links = written(by_blocks(more, known, parted.select("doc_id", "n", "part")), "links")
    # components need one link between two parts
    of = lambda s: part.select(F.col("node").alias(s), F.col("component").alias(f"c_{s}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a != b").distinct()
    edges = first.select("a", "b").union(between).union(_same_id(members).select("a", "b"))
    return Join(members, links, written(components(edges), "parts"), known)


def _unique(members: DataFrame) -> bool:
    return members.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() == 0


def _same_id(members: DataFrame) -> DataFrame:
    """Links between the representatives of rows that share an id."""
    per = members.where(F.col("n") > 0).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    return per.where(F.col("a") < F.col("b")).select("a", "b", F.lit(0).cast("long").alias("common"))


def _component_rows(j: Join) -> DataFrame:
    out = j.members.alias("m").join(j.parts.alias("p"), F.col("m.rep") == F.col("p.node"), "left")
    return out.select("m.doc_id", F.col("m.n").alias("n_shingles"), F.coalesce("p.component", "m.rep").alias("component_id"), "m.rep")


def _tile_links(shingles: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Links of each document of a tile: with all others of side 0, or with those of the other side (1, 2)."""
    order = np.argsort([len(s) for s in shingles], kind="stable")
    held, side = [shingles[i] for i in order], side[order]
    n = np.array([len(s) for s in held])
    maps = Bitmaps([bitmap(s) for s in held])
    x, y = [], []
    for i in range(len(held)):
        hi = int(np.searchsorted(4 * n, 5 * n[i], side="right"))
        other = np.arange(i + 1, hi)
        other = other[(side[i] == 0) | (side[other] != side[i])]
        if len(other):
            differ = maps.different(i, i + 1, hi)[other - i - 1]
            other = other[NUM * (n[i] + n[other] - differ) >= 2 * DEN * (n[i] + n[other])]
        if len(other):
            x.append(np.full(len(other), i))
            y.append(other)
    found = np.zeros(len(held), np.int64)
    if x:
        block = Block()
        block.add(range(len(held)), held)
        a, b, _ = block.links(np.concatenate(x), np.concatenate(y))
        np.add.at(found, a, 1)
        np.add.at(found, b, 1)
    out = np.zeros(len(held), np.int64)
    out[order] = found
    return out


TILE = ["component", "band", "kind", "i", "j"]


def link_counts(j: Join) -> DataFrame:
    """(rep, n_links) of every representative with links: the links with other representatives."""
    size = F.octet_length("shingles") / 8
    nodes = j.parts.join(j.arrays.select(F.col("doc_id").alias("node"), size.cast("long").alias("n")), "node").where("n > 0")
    nodes = written(nodes.select("node", "component", "n", F.floor(F.log(F.col("n")) / F.log(F.lit(BAND))).cast("int").alias("band")), "sized")
    room = lambda c, s: F.ceil(F.greatest(c / COUNT_BLOCK, s / BLOCK_SHINGLES)).cast("long")
    per = nodes.groupBy("component", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    whole = per.groupBy("component").agg(room(F.sum("c"), F.sum("s")).alias("all"))
    per = written(per.join(whole, "component").select("component", "band", room(F.col("c"), F.col("s")).alias("blocks"), "all"), "bands")
    own = nodes.join(per, ["component", "band"]).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")))
    # a component of one block's size is a tile as it is
    small = own.where("all = 1").select("node", "component", F.lit(-1).alias("band"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"))
    large = own.where("all > 1")
    to = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    inner = large.select("*", to("blocks").alias("other")).select(
        "node", "component", "band", F.lit(0).alias("kind"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"))
    next_to = lambda step: large.join(per.select("component", (F.col("band") - step).alias("band"), F.col("blocks").alias("theirs")), ["component", "band"])
    above = next_to(1).select("*", to("theirs").alias("other")).select("node", "component", "band", F.lit(1).alias("kind"), F.col("mine").alias("i"), F.col("other").alias("j"), F.lit(1).alias("side"))
    below = next_to(-1).select("*", to("theirs").alias("other")).select("node", "component", (F.col("band") - 1).alias("band"), F.lit(1).alias("kind"), F.col("other").alias("i"), F.col("mine").alias("j"), F.lit(2).alias("side"))
    dealt = small.union(inner).union(above).union(below)
    sent = dealt.join(j.arrays.withColumnRenamed("doc_id", "node"), "node").select(*TILE, "node", "side", "shingles")

    def work(batches):
        key, nodes, sides, held = None, [], [], []

        def close():
            n = _tile_links(held, np.array(sides))
            some = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.int64)[some]), pa.array(n[some])], names=["rep", "n"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(len(TILE)))))
            for at, (k, node, side) in enumerate(zip(keys, batch.column(5).to_pylist(), batch.column(6).to_pylist())):
                if k != key:
                    if len(held) > 1:
                        yield close()
                    key, nodes, sides, held = k, [], [], []
                nodes.append(node)
                sides.append(side)
                held.append(np.frombuffer(batch.column(7)[at].as_py(), np.uint64))
        if len(held) > 1:
            yield close()

    counts = map_arrow(sent.repartition(*TILE).sortWithinPartitions(*TILE), work, "rep long, n long")
    return counts.groupBy("rep").agg(F.sum("n").alias("n_links"))


def component_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, rep, n_links) for every row of ``docs``; n_links: links of its representative
    with other representatives, that is different sets that its own links with (null id or empty set: none)."""
    j = join(docs, spanning=True)
    rows = _component_rows(j)
    return rows.join(link_counts(j), "rep", "left").select(*rows.columns, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one with the least id. Rows without an id stay;
    of rows that repeat a kept id, one stays."""
    rows = written(_component_rows(join(docs, spanning=True)).select("doc_id", "component_id"), "kept")
    gone = rows.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    if rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where(F.col("doc_id").isNull()).union(kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)
