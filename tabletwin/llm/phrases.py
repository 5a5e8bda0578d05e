"""Phrase collocations: exact n-gram counts from one FM-index per shard of words, summed across shards.

Every task cuts its texts into shards of at most about ``SHARD`` words (cuts fall between pieces, which phrases do not
cross), and holds twice that at most over all languages. A shard becomes two Burrows-Wheeler texts over word ids, of the words and of their reverse, both sorted to a
depth of four words, which is as deep as phrases go. A phrase is a pair of intervals, one in each. Its neighbours on
the left stand in the first text's interval, those on the right in the second's, with their counts, and extending the
phrase by one of them moves both intervals. So one word grows to the left, then to the right, then to the left.

The count of a phrase is the sum over shards, which tasks begin with theirs, and no phrase is more frequent than what it contains. Therefore a level
is grown only from the phrases of the level before that reach the least count over all shards, and only into phrases
whose other part reaches it too: nothing that could be a candidate is lost. What reached it goes back to the shards in
one row per language while that is at most ``SIDE_ROWS`` rows. Beyond that, words go back as those that a shard holds
itself, by a join, where they alone are more, and phrases as one sieve for all shards: bits that every listed phrase has
set, and few others. What passes it unlisted is counted over all shards like the rest and does not reach the least count,
so the sieve costs rows, never results, and takes ``SIEVE_MOST`` bits at most however many phrases there are.

Words are told apart by two 64-bit hashes within shards and counted by their letters across shards.

Cases: a null text is empty and has no words, a null language counts as ``und``; very long texts are cut between
pieces, a piece is never cut; ties in rank are ordered by count, then by the phrase's bytes, and no two phrases
are equal; repeated rows count each; ids are not read; extra columns, whatever their names, are not carried on; an empty
table, or one without candidates, gives an empty result.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletwin.llm import tokens
from tabletwin.llm.store import map_arrow, written
from tabletwin.operators.topk import top_k_per_group

SHARD = 1 << 20
SIDE_ROWS = 1_000_000
DEPTH = 4
#: Rows of phrases that a task holds before it adds up the shards' counts, and tasks a core for the growth of a level.
HELD_ROWS = 1 << 20
TASKS = 4
#: Bits of a sieve per listed phrase, and of the largest sieve (16 MB).
SIEVE_BITS = 16
SIEVE_MOST = 1 << 27
#: Rows of a shard that a phrase's growth looks at in one go, and texts that go to Python together.
AT_ONCE = 1 << 18
TEXTS = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Bytes that end a piece, and (with them) bytes that end a word: one byte each in UTF-8.
STOP = np.zeros(256, bool)
STOP[list(b".,;:!?\n\v\f\r")] = True
GAP = STOP.copy()
GAP[list(b" \t")] = True
SECOND = np.uint8(0xA5)

INDEX = "lang string, shard string, words array<struct<h:long,h2:long,n:long,word:string>>, h binary, h2 binary, before binary, after binary"


def word_codes(buf: np.ndarray, offsets: np.ndarray):
    """(hash, second hash, start, end) of every word of whole lower-case texts, with an entry of hash 0 and no letters
    where a piece begins (after the first of each text too)."""
    gap = GAP[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    solid = ~gap
    before, after = np.zeros(len(buf) + 1, bool), np.zeros(len(buf) + 1, bool)
    before[1:], after[:-1] = solid, solid
    starts, ends = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    stops = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(STOP[buf], out=stops[1:])
    text = np.searchsorted(offsets, starts, side="right")
    new = np.ones(len(starts), bool)
    new[1:] = (stops[starts[1:]] != stops[starts[:-1]]) | (text[1:] != text[:-1])
    put = np.flatnonzero(new)
    h, h2 = tokens.span_hashes(buf, starts, ends), tokens.span_hashes(buf ^ SECOND, starts, ends)
    h[h == 0] = 1
    return np.insert(h, put, 0), np.insert(h2, put, 0), np.insert(starts, put, 0), np.insert(ends, put, 0)


def pack_symbols(x: np.ndarray) -> bytes:
    """Symbols as four runs of bytes of equal weight, which compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_symbols(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4")[:, 0]


def stable_order(key: np.ndarray) -> np.ndarray:
    """Stable argsort of numbers from 0: one plain sort of key and position together, where both fit one number."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)) >> (63 - bits):
        return np.argsort(key, kind="stable")
    both = key.astype(np.int64)
    both <<= bits
    both |= np.arange(len(key))
    both.sort()
    both &= (1 << bits) - 1
    return both


def runs(key: np.ndarray, order: np.ndarray):
    """(first position, count) of each distinct key, by rising key; ``order`` sorts the keys and is stable."""
    here = key[order]
    new = np.ones(len(here), bool)
    new[1:] = here[1:] != here[:-1]
    start = np.flatnonzero(new)
    return order[start], np.diff(np.append(start, len(here)))


def dense(key: np.ndarray) -> np.ndarray:
    """Rank of every key among the distinct ones."""
    order = stable_order(key)
    sizes = runs(key, order)[1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.repeat(np.arange(len(sizes)), sizes)
    return rank


def numbered(h: np.ndarray, h2: np.ndarray):
    """(first position of each distinct word, symbol of every position): symbol 0 is the border of pieces, others go by
    falling count."""
    inverse = np.asarray(pa.array(h).dictionary_encode().indices).astype(np.int64)
    count = np.bincount(inverse)
    first = np.empty(len(count), np.int64)
    first[inverse[::-1]] = np.arange(len(h))[::-1]  # the last one written is the first position
    if (h2 != h2[first][inverse]).any():  # two words of one hash: told apart by the second
        both = np.rec.fromarrays([h, h2])
        _, first, inverse, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    count = count.copy()
    count[h[first] == 0] = len(h) + 1  # the border has hash 0
    order = np.argsort(-count, kind="stable")
    symbol = np.empty(len(order), np.int64)
    symbol[order] = np.arange(len(order))
    return first[order], symbol[inverse]


def burrows_wheeler(text: np.ndarray) -> np.ndarray:
    """The symbol before each suffix, suffixes sorted by their first ``DEPTH`` = 4 symbols (past the end: borders)."""
    n = len(text)
    more = np.concatenate([text, np.zeros(3, np.int64)])
    width = int(text.max(initial=0)) + 1
    two = dense(more[:n + 2] * width + more[1:n + 3])
    return text[stable_order(two[:n] * (int(two.max()) + 1) + two[2:]) - 1]


class Shard:
    """Both Burrows-Wheeler texts of a shard and the growth of phrases in them."""

    def __init__(self, before: np.ndarray, after: np.ndarray):
        self.before, self.after = before, after
        self.size = np.bincount(before)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        # row of the suffix that begins with the symbol of a row: the rank among equal symbols is kept
        self.step = np.empty(len(before), np.int32)
        self.step[stable_order(before)] = np.arange(len(before))
        self.back = np.empty(len(after), np.int32)
        self.back[stable_order(after)] = np.arange(len(after))

    def words(self, alive: np.ndarray):
        """The phrases of one word: (words, low in the first text, low in the second, count)."""
        return alive[:, None], self.start[alive], self.start[alive], self.size[alive]

    def grow(self, phrases, left: bool):
        """All one-word extensions of the phrases, on the left or on the right, with their counts."""
        words, low, low_back, count = phrases
        text, step, here, there = (self.before, self.step, low, low_back) if left else (self.after, self.back, low_back, low)
        which = np.repeat(np.arange(len(words)), count)
        row = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + here[which]
        # the rows of an interval by symbol: a group is one extension, groups before it in the interval have smaller symbols
        key = which * len(self.size) + text[row]
        first, n = runs(key, stable_order(key))
        of, symbol = which[first], text[row[first]]
        smaller = np.cumsum(n) - n
        smaller -= smaller[np.searchsorted(of, of)]
        new_here, new_there = step[row[first]], there[of] + smaller
        grown = np.column_stack([symbol, words[of]] if left else [words[of], symbol])
        some = symbol > 0
        low, low_back = (new_here, new_there) if left else (new_there, new_here)
        return grown[some], low[some], low_back[some], n[some]


def keep(phrases, mask):
    return tuple(x[mask] for x in phrases)


class Listed:
    """The listed phrases of a shard. A phrase has a place among those of its length; the code of a longer one is the
    place of its words but the last times the number of symbols, plus the last."""

    def __init__(self, alive: list[np.ndarray], symbols: int):
        self.symbols = symbols
        self.single = np.full(symbols, -1, np.int64)
        self.single[alive[0][:, 0]] = alive[0][:, 0]
        self.codes: list[np.ndarray] = []
        for listed in alive[1:]:
            place, last = self.place(listed[:, :-1]), listed[:, -1]
            self.codes.append(np.sort((place * symbols + last)[place >= 0]))

    def place(self, phrases: np.ndarray) -> np.ndarray:
        """Place of every phrase (rows of symbols), -1 for those that are not listed."""
        place = self.single[phrases[:, 0]]
        for codes, word in zip(self.codes, phrases.T[1:]):
            code = np.where(place >= 0, place * self.symbols + word, 0)  # no phrase has code 0: symbol 0 is the border
            order = stable_order(code)
            code = code[order]
            spot = np.searchsorted(codes, code)
            spot[np.append(codes, -1)[spot] != code] = -1
            place[order] = spot
        return place

    def holds(self, phrases: np.ndarray) -> np.ndarray:
        return self.place(phrases) >= 0


def sieve_spots(columns: list[np.ndarray], bits: int):
    """The two bits of every phrase, given as columns of its words' ids, in a sieve of ``bits`` bits (a power of two, at
    most 2^32)."""
    h = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        h ^= x.view(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def sieve(phrases: DataFrame, level: int, rows: int) -> np.ndarray:
    """The bits of the ``rows`` phrases (w0, ..): set by Spark in blocks, which the driver puts in their places."""
    bits = 1 << max(15, (SIEVE_BITS * rows - 1).bit_length())
    bits = min(bits, SIEVE_MOST)

    def work(batches):
        for batch in batches:
            spot = np.concatenate(sieve_spots([batch.column(j).to_numpy() for j in range(level)], bits))
            yield pa.RecordBatch.from_arrays([pa.array(spot >> 15), pa.array(spot & 32767)], ["block", "spot"])

    spots = map_arrow(phrases.select(*[f"w{j}" for j in range(level)]), work, "block long, spot long")
    out = np.zeros(bits // 8, np.uint8)
    for row in spots.groupBy("block").agg(F.bitmap_construct_agg("spot").alias("bits")).toLocalIterator():
        out[row.block << 12:(row.block + 1) << 12] = np.frombuffer(row.bits, np.uint8)
    return out


class Sifted:
    """The listed phrases of a shard as far as sieves (by number of words) know them: all of them, and few others."""

    def __init__(self, single: np.ndarray, ids: np.ndarray, sieves: dict[int, np.ndarray], symbols: int):
        self.sieves = sieves
        self.id = np.zeros(symbols, np.int64)
        self.id[single] = ids
        self.single = np.zeros(symbols, bool)
        self.single[single] = True

    def holds(self, phrases: np.ndarray) -> np.ndarray:
        known = self.single[phrases].all(axis=1)
        if phrases.shape[1] > 1:
            bits = self.sieves[phrases.shape[1]]
            for spot in sieve_spots([self.id[x] for x in phrases.T], 8 * len(bits)):
                known &= (bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
        return known


def counts_in(shard: Shard, single: np.ndarray, listed: Listed | Sifted, level: int):
    """Phrases of ``level`` words whose parts of one word less are all listed: words (``single``) first grown to the left,
    then to the right, then to the left."""
    phrases = shard.words(single.astype(np.int32))
    for k in range(2, level + 1):
        left = k % 2 == 0
        after = np.cumsum(phrases[3])
        grown, lo = [], 0
        while lo < len(after) or not grown:
            hi = max(lo + 1, int(np.searchsorted(after, (after[lo - 1] if lo else 0) + AT_ONCE, side="right")))
            more = shard.grow(keep(phrases, slice(lo, hi)), left)
            # one part is the listed phrase that was grown
            more = keep(more, listed.holds(more[0][:, :-1] if left else more[0][:, 1:]))
            grown.append(keep(more, listed.holds(more[0])) if k < level else (more[0], more[3]))
            lo = hi
        phrases = tuple(np.concatenate(x) for x in zip(*grown))
    return phrases


def together(held):
    """The phrases of several shards with their counts added up. Of each: (phrases as rows of symbols, counts, the words'
    ids, their symbols); in the result a symbol is the place of the id."""
    values = np.unique(np.concatenate([ids for _, _, ids, _ in held]))
    places = []
    for _, _, ids, symbol in held:
        place = np.zeros(int(symbol.max()) + 1, np.int32)
        place[symbol] = np.searchsorted(values, ids)
        places.append(place)
    parts = -(-sum(len(x[1]) for x in held) // AT_ONCE)
    out = []
    for part in range(parts):  # phrases of some first words at a time: equal ones meet, and less is held
        rows, n = [], []
        for place, (found, count, _, _) in zip(places, held):
            here = place[found[:, 0]] % parts == part
            rows.append(place[found[here]])
            n.append(count[here])
        rows, n = np.concatenate(rows), np.concatenate(n)
        if len(n) == 0:
            continue
        key = rows[:, 0].astype(np.int64)
        for j in range(1, rows.shape[1]):
            key = dense(key) if j > 1 else key
            key *= len(values)
            key += rows[:, j]
        order = stable_order(key)
        first, size = runs(key, order)
        out.append((rows[first], np.add.reduceat(n[order], np.cumsum(size) - size)))
    found, n = (np.concatenate(x) for x in zip(*out))
    return found, n, values, np.arange(len(values))


def _shard_rows(batches):
    """Index rows of a task's texts."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    made = 0
    task = None

    def build(lang: str):
        nonlocal made, task
        task = task or uuid.uuid4().hex
        columns = held.pop(lang)
        size.pop(lang)
        whole = lambda *end: np.concatenate([*columns.pop(0), *end])  # the parts of a column go when it is whole
        h, h2 = whole(np.zeros(1, np.uint64)), whole(np.zeros(1, np.uint64))
        at = np.concatenate([[0], np.cumsum(whole(), dtype=np.int64)])
        buf = whole()
        first, text = numbered(h, h2)
        n = np.bincount(text)
        first, n = first[1:], n[1:]  # without the border
        lens = at[first + 1] - at[first]
        spots = np.repeat(at[first], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        word = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf[spots].tobytes()))
        a, b = h[first].view(np.int64), h2[first].view(np.int64)
        del h, h2, at, buf, lens, spots
        entry = pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(n), word], ["h", "h2", "n", "word"])
        words = pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), entry)
        made += 1
        arrays = [pa.array([lang]), pa.array([f"{task}-{made}"]), words, pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary()),
                  pa.array([pack_symbols(burrows_wheeler(text))], pa.binary()), pa.array([pack_symbols(burrows_wheeler(text[::-1].copy()))], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "shard", "words", "h", "h2", "before", "after"])

    def add(lang, h, h2, letters, buf):
        for column, x in zip(held.setdefault(lang, [[], [], [], []]), (h, h2, letters, buf)):
            column.append(x.copy())  # not the whole slice
        size[lang] = size.get(lang, 0) + len(h)

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in dict.fromkeys(langs):
            rows = pa.array([i for i, x in enumerate(langs) if x == lang])
            buf, offsets = tokens.text_buffer(batch.column(1).take(rows))
            for _, _, part, off in tokens.slices(buf, offsets):
                part = tokens.LOWER[part]
                h, h2, starts, ends = word_codes(part, off)
                letters = (ends - starts).astype(np.int32)
                where = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
                solid = part[~GAP[part]]
                border = np.flatnonzero(h == 0)
                lo = 0
                while lo < len(h):  # whole pieces up to the size of a shard
                    room = SHARD - size.get(lang, 0)
                    k = np.searchsorted(border, lo + max(room, 1))
                    hi = len(h) if lo + room >= len(h) or k == len(border) else int(border[k])
                    add(lang, h[lo:hi], h2[lo:hi], letters[lo:hi], solid[where[lo]:where[hi]])
                    lo = hi
                    if size[lang] >= SHARD:
                        yield build(lang)
                    elif sum(size.values()) >= 2 * SHARD:
                        yield build(max(size, key=size.get))
    for lang in list(held):
        yield build(lang)


def index(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The written index: a row per shard with its words and both Burrows-Wheeler texts."""
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].alias("text"))
    # a shard is a row of some megabytes: row groups are closed by size after every row, not after a hundred
    options = {"compression": "zstd", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}
    with rows_a_batch(docs.sparkSession, TEXTS):
        return written(map_arrow(rows, _shard_rows, INDEX), "phrase-index", options)


def _found(row, lists, sieves: dict[int, np.ndarray], level: int):
    """(phrases of ``level`` words as rows of symbols, counts, the words' ids, their symbols) of a shard, or None. ``row``
    gives its arrays by name, ``lists`` those of the listed words and phrases."""
    number = lambda n: np.frombuffer(row(n)[0].as_buffer(), np.int64)
    # words of this shard by both hashes -> symbol (1, 2, ...)
    h, h2 = number("h"), number("h2")
    order = np.lexsort((h2, h))
    listed_h, listed_h2, ids = lists("l_h"), lists("l_h2"), lists("l_id")
    sorted_h = h[order]
    lo, hi = np.searchsorted(sorted_h, listed_h), np.searchsorted(sorted_h, listed_h, side="right")
    symbol = np.zeros(len(ids), np.int64)
    for k in range(int((hi - lo).max(initial=0))):  # one turn, but for words of one hash
        at = order[np.minimum(lo + k, len(order) - 1)]
        hit = (lo + k < hi) & (h2[at] == listed_h2)
        symbol[hit] = at[hit] + 1
    here = symbol > 0
    ids, symbol = ids[here], symbol[here]
    if len(ids) == 0:
        return None
    by_id = np.argsort(ids)
    ids, symbol = ids[by_id], symbol[by_id]
    del order, sorted_h, lo, hi, here, by_id
    single = np.unique(symbol)
    if sieves:
        listed = Sifted(symbol, ids, sieves, len(h) + 1)
    else:
        alive = [single[:, None]]
        for k in range(2, level):
            cols, ok = [], True
            for j in range(k):
                x = lists(f"l{k}_{j}")
                spot = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
                ok = ok & (ids[spot] == x)
                cols.append(symbol[spot])
            alive.append(np.column_stack(cols)[ok])
        if any(len(a) == 0 for a in alive):
            return None
        listed = Listed(alive, len(h) + 1)
    text = lambda n: unpack_symbols(row(n)[0].as_buffer())
    found, n = counts_in(Shard(text("before"), text("after")), single, listed, level)
    used = np.zeros(len(h) + 1, bool)
    used[found] = True
    used = used[symbol]
    return found, n, ids[used], symbol[used]  # other words are not kept


def _level(shards: DataFrame, level: int, sieves: dict[int, Broadcast] | None = None, lists: Broadcast | None = None) -> DataFrame:
    """Counts of the phrases of ``level`` words, with the words' ids: a task adds up those of its shards, as far as
    ``HELD_ROWS`` rows reach. Listed words and phrases are in ``lists`` by language (see ``_arrays``) or else in the shards'
    rows; phrases are in ``sieves`` instead, if there are any."""
    names = [f"w{i}" for i in range(level)]

    def rows(found, n, ids, symbol):
        name = np.zeros(int(symbol.max()) + 1, np.int64)
        name[symbol] = ids
        for lo in range(0, len(n), 1 << 17):
            part = name[found[lo:lo + (1 << 17)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[:, j])) for j in range(level)] + [pa.array(n[lo:lo + (1 << 17)])], [*names, "n"])

    def work(batches):
        held = []
        sieve_of = {k: x.value for k, x in (sieves or {}).items()}
        for batch in batches:
            for i in range(batch.num_rows):
                row = lambda n: batch.column(batch.schema.get_field_index(n)).slice(i, 1)
                if lists is None:
                    found = _found(row, lambda n: np.asarray(row(n).flatten()).astype(np.int64), sieve_of, level)
                else:
                    own = lists.value.get(row("lang")[0].as_py())
                    found = own and _found(row, own.__getitem__, sieve_of, level)
                if found and len(found[1]):
                    held.append(found)
                if sum(len(x[1]) for x in held) >= HELD_ROWS:
                    held = [together(held)]
                    if len(held[0][1]) >= HELD_ROWS // 2:
                        yield from rows(*held.pop())
        if held:
            yield from rows(*together(held))

    return map_arrow(shards, work, ", ".join(f"{n} long" for n in names) + ", n long")


def _listed(words: DataFrame, phrases: dict[int, DataFrame]) -> DataFrame:
    """One row per language: the ids of its frequent words and phrases as arrays (bounded: see ``SIDE_ROWS``)."""
    out = words.groupBy("lang").agg(F.collect_list(F.struct("h", "h2", "id")).alias("l"))
    out = out.select("lang", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("h", "h2", "id")])
    home = words.select(F.col("id").alias("w0"), "lang")
    for k, rows in phrases.items():
        ids = [f"w{j}" for j in range(k)]
        each = rows.join(home, "w0").groupBy("lang").agg(F.collect_list(F.struct(*ids)).alias("p"))
        out = out.join(each.select("lang", *[F.col(f"p.w{j}").alias(f"l{k}_{j}") for j in range(k)]), "lang")
    return out


def _arrays(listed: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """The rows of ``_listed`` as arrays by language and name. Python processes get them once, instead of with every shard."""
    table = listed.toArrow()
    column = lambda n, i: np.asarray(table.column(n).slice(i, 1).combine_chunks().flatten()).astype(np.int64)
    return {lang: {n: column(n, i) for n in table.column_names if n != "lang"} for i, lang in enumerate(table.column("lang").to_pylist())}


def _held(shards: DataFrame, words: DataFrame) -> DataFrame:
    """The arrays of words per shard, with those that the shard itself holds: a join on words, then one group per shard,
    which is bounded by the shard's size."""
    own = shards.select("lang", "shard", F.explode("words").alias("w")).select("lang", "shard", "w.h", "w.h2").join(words, ["lang", "h", "h2"])
    out = own.groupBy("shard").agg(F.collect_list(F.struct("h", "h2", "id")).alias("l"))
    return out.select("shard", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("h", "h2", "id")])


@contextmanager
def rows_a_batch(spark, rows: int):
    """What runs inside sends rows to Python by so many: one by one for a shard with its lists, a row of many megabytes."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def frequent(docs: DataFrame, least: int, text: str = "text", lang: str = "lang", side_rows: int | None = None) -> tuple[DataFrame, dict[int, DataFrame], DataFrame]:
    """(words, phrases by length, totals): words (lang, h, h2, word, n, id) and phrases (w0.., n) that occur ``least``
    times or more within a language, and (lang, n) of all words."""
    limit = SIDE_ROWS if side_rows is None else side_rows
    spark = docs.sparkSession
    shards = index(docs, text, lang)
    each = shards.select("lang", F.explode("words").alias("w")).select("lang", "w.h", "w.h2", "w.word", "w.n")
    counted = each.groupBy("lang", "h", "h2", "word").agg(F.sum("n").alias("n"))
    # ids differ between words and are kept by writing them
    words = written(counted.where(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id()), "words")
    totals = written(each.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    phrases: dict[int, DataFrame] = {}
    sieves: dict[int, Broadcast] = {}
    few = words.count()
    rows = few
    for level in range(2, DEPTH + 1):
        if rows == 0:
            break
        base = shards.select("lang", "shard", "h", "h2", "before", "after")
        if rows > limit:
            for k in phrases.keys() - sieves.keys():
                sieves[k] = spark.sparkContext.broadcast(sieve(phrases[k], k, phrases[k].count()))
        lists = None
        if few <= limit:
            if level > 2:  # few tasks of many shards: phrases that most shards hold leave a task once; pairs are too many to be held
                parts = base.rdd.getNumPartitions()
                base = base.coalesce(max(TASKS * spark.sparkContext.defaultParallelism, parts // 8))
            lists = spark.sparkContext.broadcast(_arrays(_listed(words, {} if sieves else phrases)))
            local = _level(base.drop("shard"), level, sieves, lists)
        else:
            local = _level(base.join(_held(shards, words), "shard").drop("shard", "lang"), level, sieves)
        ids = [f"w{j}" for j in range(level)]
        with rows_a_batch(spark, 1):
            found = written(local.groupBy(*ids).agg(F.sum("n").alias("n")).where(F.col("n") >= least), f"phrases{level}")
        if lists:
            lists.destroy()
        new = found.count()
        if new == 0:
            break
        phrases[level] = found
        rows += new
    for x in sieves.values():
        x.destroy()
    return words, phrases, totals


def scored(words: DataFrame, phrases: dict[int, DataFrame]) -> DataFrame:
    """(p array of ids, a, l, r, score) of the candidates that are left: the cut of least score, and without those that
    a longer candidate holds with four fifths of their count or more."""
    empty = words.sparkSession.createDataFrame([], "p array<long>, a long")
    long = empty
    for k, rows in phrases.items():
        long = long.union(rows.select(F.array(*[f"w{j}" for j in range(k)]), "n"))
    long = written(long, "candidates")
    count = long.union(words.select(F.array("id"), "n")).toDF("part", "f")
    size = F.size("p")
    cuts = long.select("p", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.expr("slice(p, 1, k)").alias("head"), F.expr("slice(p, k + 1, size(p) - k)").alias("tail"))
    cuts = cuts.join(count.toDF("head", "l"), "head").join(count.toDF("tail", "r"), "tail")
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    best = best.select("p", "a", "c.l", "c.r", "c.score")
    inner = long.where(size > 2).select("a", F.explode(F.expr(
        "filter(flatten(transform(sequence(1, size(p) - 1), i -> transform(sequence(2, size(p) - 1), n -> if(i + n - 1 <= size(p), slice(p, i, n), null)))), x -> x is not null)")).alias("p"))
    above = inner.groupBy("p").agg(F.max("a").alias("longer"))
    gone = (F.col("longer").cast("decimal(38,0)") * 100) >= (F.col("a").cast("decimal(38,0)") * 80)
    return best.join(above, "p", "left").where(F.col("longer").isNull() | ~gone).drop("longer")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, text: str = "text", lang: str = "lang", side_rows: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    words, phrases, totals = frequent(docs, least, text, lang, side_rows)
    found = scored(words, phrases)
    spelled = (
        found.select("p", "a", "l", "r", "score", F.posexplode("p").alias("i", "id")).join(words.select("id", "word", "lang"), "id")
        .groupBy("p", "a", "l", "r", "score", "lang").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
        .select("lang", F.concat_ws(" ", F.col("w.word")).alias("phrase"), "a", "l", "r", "score")
    )
    first = top_k_per_group(spelled, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, split_on=F.col("phrase"))
    return first.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
