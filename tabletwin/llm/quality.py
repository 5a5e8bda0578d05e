"""Quality classifier by co-training of a content view and a metadata view.

The content view sees which words a text has (hashed, those that tell the classes apart by a chi-square test); the
metadata view sees language, source, length, and the page's layout (lines, capitals, digits, symbols). Both are
logistic regressions, fitted on a bounded sample of labelled documents. Over some rounds each view labels the
unlabelled documents on which its calibrated probability is extreme, and these join the other view's training set.
All unlabelled documents take part: tasks score them and reduce what the fits need to word counts per class, and to
gradient and curvature sums of Newton steps; no unlabelled row reaches the driver. Held-out labelled documents calibrate each view and fit the weights with which both are combined. Two heads,
quality and toxicity, share all of this. All documents are scored in one pass.

Bounds: ``LABELLED_ROWS`` labelled documents (least hash of the id) are used for fitting; ``pool_rows`` bounds the
unlabelled ones only if it is passed. Everything else covers all rows.

Cases: null and empty texts have no words and are scored by their metadata; null languages, sources and counts are
values of their own; repeated label rows count once (their largest label); labels without documents and null labels
are left out; if a class has no examples its head answers the share of the other; an empty table gives an empty
result; further columns are dropped.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletwin.llm import tokens as tk
from tabletwin.llm.store import broadcast_if, in_fewer_files, map_arrow, written

LABELLED_ROWS = 6_000
#: Labelled ids up to this many are broadcast to set the others apart.
BROADCAST_IDS = 2_000_000
NEWTON_STEPS, NEWTON_ENOUGH = 8, 1e-3
ROUNDS = 2
#: A view hands a pseudo-label on if its probability is this close to 0 or 1.
CONFIDENT = 0.02
#: A document goes if it is good with less than this probability, or toxic with this one or more.
LEAST_GOOD, MOST_TOXIC = 0.3, 0.5
WORD_BITS = 20
MAX_WORDS = 600
MIN_CHI2 = 20.0
#: Bytes of text that a task turns into words at a time: arrays of eight bytes for each of them are made on the way.
SLICE_BYTES = 1 << 18
HEADS = ("quality", "toxic")

#: Words are runs of letters, digits and bytes beyond ASCII.
_solid = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _solid[_lo:_hi] = True


def _mask(lo: int, hi: int) -> np.ndarray:
    m = np.zeros(256, bool)
    m[lo:hi] = True
    return m


_UPPER, _LOWER, _DIGIT, _SYMBOL = _mask(65, 91), _mask(97, 123), _mask(48, 58), np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!{}[]_=~^"]] = True
CATEGORIES = 32
N_META = 14 + 2 * CATEGORIES
N_EXTRA = 4


def word_codes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed word) of every lower-case word, in text order."""
    solid = _solid[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(buf) + 1, bool), np.zeros(len(buf) + 1, bool)
    before[1:], after[:-1] = solid, solid
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    h = tk.span_hashes(tk.LOWER[buf], starts, ends)
    return np.searchsorted(offsets, starts, side="right") - 1, (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def distinct_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, code = word_codes(buf, offsets)
    both = np.unique((row << WORD_BITS) | code)
    return both >> WORD_BITS, both & ((1 << WORD_BITS) - 1)


def repetition(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """(rows, N_EXTRA): shares of words equal to the one before, and of distinct words, as numbers and steps."""
    total = np.maximum(np.bincount(row, minlength=n), 1)
    same = (row[1:] == row[:-1]) & (code[1:] == code[:-1])
    again = np.bincount(row[1:][same], minlength=n) / total
    few = 1 - np.bincount(np.unique((row << WORD_BITS) | code) >> WORD_BITS, minlength=n) / total
    return np.column_stack([2 * again, (again > 0.1).astype(float), 2 * few, few * (total > 200)])


def _count(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return np.diff(c[offsets]).astype(float)


def metadata(buf, offsets, lang, source, n_chars) -> np.ndarray:
    """(rows, N_META) numbers: length and layout, and one-hot hashed language and source."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    lines = _count(buf == 10, offsets) + 1
    space = _count(tk.SPACE[buf], offsets)
    up, low, dig, sym = (_count(m[buf], offsets) for m in (_UPPER, _LOWER, _DIGIT, _SYMBOL))
    stop = _count((buf == 46) | (buf == 44), offsets)
    full = np.maximum(size, 1)
    claimed = np.array([np.nan if v is None else float(v) for v in n_chars])
    cols = [np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 10, 10 * space / full, up / np.maximum(up + low, 1), (up > low).astype(float),
            10 * dig / full, 10 * sym / full, (sym > 0.03 * full).astype(float), (sym > 0.01 * full).astype(float), 10 * stop / full, (size == 0).astype(float),
            np.isnan(claimed).astype(float), np.log1p(np.abs(np.nan_to_num(claimed))) / 10]
    out = np.zeros((n, N_META))
    out[:, :len(cols)] = np.column_stack(cols) if n else np.zeros((0, len(cols)))
    for k, values in enumerate((lang, source)):
        slot = np.array([zlib.crc32(("" if v is None else "v" + v).encode()) % CATEGORIES for v in values], np.int64)
        out[np.arange(n), 14 + k * CATEGORIES + slot] = 0.3
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 120) -> np.ndarray:
    """Weights (bias last) of a regularised logistic regression by accelerated gradient steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1, dtype=np.float32)
    power = np.ones(x.shape[1])
    for _ in range(12):
        power = x.T @ (x @ power)
        power /= np.linalg.norm(power) + 1e-12
    step = 1.0 / (0.25 * np.linalg.norm(x @ power) ** 2 + l2)
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    damp = np.full(x.shape[1], l2)
    damp[-1] = 1e-3
    for t in range(steps):
        new = v - step * (x.T @ (sigmoid(x @ v) - y) + damp * v)
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Sample:
    """Bounded rows for fitting: distinct words and metadata of each, labels (-1: none)."""

    row: np.ndarray
    word: np.ndarray
    extra: np.ndarray
    meta: np.ndarray
    labels: dict[str, np.ndarray]
    held: np.ndarray
    table: DataFrame  # the same rows, written: words, quality, toxic, held

    def presence(self, words: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The content view of all rows, or of those marked in ``rows``."""
        rows = np.ones(len(self.meta), bool) if rows is None else rows
        x = np.zeros((int(rows.sum()), len(words) + N_EXTRA), np.float32)
        x[:, len(words):] = self.extra[rows]
        if len(words) == 0:
            return x
        table = np.zeros(1 << WORD_BITS, bool)
        table[words] = True
        hit = np.flatnonzero(table[self.word])
        hit = hit[rows[self.row[hit]]]
        x[np.cumsum(rows)[self.row[hit]] - 1, np.searchsorted(words, self.word[hit])] = 1.0
        return x

    def counts(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, rows with each of them by class (0, 1) of ``y`` (-1: none), and rows by class."""
        per = np.stack([np.bincount(self.word[(y == c)[self.row]], minlength=1 << WORD_BITS) for c in (0, 1)])
        codes = np.flatnonzero(per.any(axis=0))  # a word of neither class tells nothing
        return codes, per[:, codes].astype(float), np.array([(y == 0).sum(), (y == 1).sum()], float)


def chi_square(neg, pos, n0, n1, most=np.maximum):
    """Dependence of a word's presence on the class, from rows with the word and all rows of each class."""
    n, seen = n1 + n0, pos + neg
    off = pos * (n0 - neg) - neg * (n1 - pos)
    return n * (off * off) / most(n1 * n0 * seen * (n - seen), 1e-9)


def telling_words(codes: np.ndarray, per: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sorted codes of the words whose presence depends most on the label (ties: smaller codes)."""
    chi2 = chi_square(*per, *rows)
    best = np.argsort(-chi2, kind="stable")[:MAX_WORDS]
    return np.sort(codes[best[chi2[best] >= MIN_CHI2]])


@dataclass
class Head:
    words: np.ndarray
    content: np.ndarray
    meta: np.ndarray
    calibration: np.ndarray  # (scale, shift) of the content view and of the metadata view
    blend: np.ndarray


def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return logistic(z[:, None], y, l2=0.05, steps=150) if len(set(y.tolist())) == 2 else np.array([1.0, 0.0])


@dataclass
class Views:
    """Both views of one head after a round."""

    words: np.ndarray
    content: np.ndarray
    meta: np.ndarray
    calibration: np.ndarray


def content_logit(words, w, row, code, extra) -> np.ndarray:
    n = len(words)
    z = extra @ w[n:n + N_EXTRA] + w[-1]
    if n:
        at = np.minimum(np.searchsorted(words, code), n - 1)
        hit = words[at] == code
        z = z + np.bincount(row[hit], w[at[hit]], minlength=len(extra))
    return z


def pseudo_labels(rounds: list[Views], row, code, extra, meta) -> np.ndarray:
    """(2, rows): labels handed to the content and to the metadata view, each by the other in the first round in which
    it was sure (-1: none)."""
    y = np.full((2, len(meta)), -1, np.int64)
    for v in rounds:
        c = v.calibration
        p = (sigmoid(c[0] * content_logit(v.words, v.content, row, code, extra) + c[1]), sigmoid(c[2] * apply(v.meta, meta) + c[3]))
        for view in (0, 1):
            sure = (y[1 - view] < 0) & (np.minimum(p[view], 1 - p[view]) < CONFIDENT)
            y[1 - view][sure] = p[view][sure] > 0.5
    return y


def _pool_features(batches):
    for batch in batches:
        buf, offsets = tk.text_buffer(batch.column("text"))
        for lo, hi, part, off in tk.slices(buf, offsets, SLICE_BYTES):
            row, code = word_codes(part, off)
            extra = repetition(row, code, hi - lo)
            both = np.unique((row << WORD_BITS) | code)
            yield both >> WORD_BITS, both & ((1 << WORD_BITS) - 1), extra, _meta_of(batch, lo, hi, part, off)


def pool_counts(pool: DataFrame, rounds: dict[str, list[Views]], sample: DataFrame) -> DataFrame:
    """The written (head, code, n0, n1): rows with a word by class of the content view's labels, over the pool and the
    sample's rows for fitting; rows by class have the code -1."""
    shared = pool.sparkSession.sparkContext.broadcast(rounds)

    def work(batches):
        names = list(shared.value)
        per = np.zeros((len(names), 2, 1 << WORD_BITS), np.int32)  # a task has fewer rows than that
        rows = np.zeros((len(names), 2), np.int64)
        for row, code, extra, meta in _pool_features(batches):
            for i, h in enumerate(names):
                y = pseudo_labels(shared.value[h], row, code, extra, meta)[0]
                for c in (0, 1):
                    np.add.at(per[i, c], code[y[row] == c], 1)
                    rows[i, c] += (y == c).sum()
        for i, h in enumerate(names):
            at = np.flatnonzero((per[i, 0] > 0) | (per[i, 1] > 0))
            cols = [np.concatenate([[-1], at]), *(np.concatenate([[rows[i, c]], per[i, c, at]]) for c in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array([h] * len(cols[0])), *map(pa.array, cols)], names=["head", "code", "n0", "n1"])

    found = map_arrow(pool, work, "head string, code long, n0 long, n1 long")
    with_rows = F.explode(F.concat(F.array(F.lit(-1).cast("long")), "words")).alias("code")
    of = lambda y, c: F.when(F.col(y) == c, 1).otherwise(0).cast("long").alias(f"n{c}")
    for h in rounds:
        given = sample.where(~F.col("held") & (F.col(h) >= 0)).select(F.lit(h).alias("head"), h, with_rows)
        found = found.union(given.select("head", "code", of(h, 0), of(h, 1)))
    counts = found.groupBy("head", "code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    out = written(in_fewer_files(counts, len(rounds) << WORD_BITS), "word-counts")
    shared.destroy()
    return out


def chosen_words(counts: DataFrame) -> dict[str, np.ndarray]:
    """``telling_words`` of each head from counts that stay in Spark: at most MAX_WORDS rows a head reach the driver."""
    out = {}
    for r in counts.where("code < 0").collect():
        neg, pos = F.col("n0").cast("double"), F.col("n1").cast("double")
        chi2 = chi_square(neg, pos, F.lit(float(r.n0)), F.lit(float(r.n1)), lambda x, least: F.greatest(x, F.lit(least)))
        best = counts.where((F.col("head") == r["head"]) & (F.col("code") >= 0)).select("code", chi2.alias("chi2")).where(F.col("chi2") >= MIN_CHI2)
        out[r["head"]] = np.sort(np.array([x.code for x in best.orderBy(F.desc("chi2"), "code").limit(MAX_WORDS).collect()], np.int64))
    return out


def compact(pool: DataFrame, rounds: dict[str, list[Views]], words: dict[str, np.ndarray]) -> DataFrame:
    """(y, at, extra, meta) of the pool's rows that have a label: what the Newton steps read. ``at`` are places in the
    sorted union of the heads' words."""
    union = np.unique(np.concatenate(list(words.values()))).astype(np.int64)
    shared = pool.sparkSession.sparkContext.broadcast((rounds, union))

    def work(batches):
        rounds, union = shared.value
        for row, code, extra, meta in _pool_features(batches):
            y = np.concatenate([pseudo_labels(v, row, code, extra, meta) for v in rounds.values()]).astype(np.int8)
            use = np.flatnonzero((y >= 0).any(axis=0))
            if len(union):
                at = np.minimum(np.searchsorted(union, code), len(union) - 1)
                hit = union[at] == code
                row, at = row[hit], at[hit].astype(np.int16)
            else:
                row, at = row[:0], np.zeros(0, np.int16)
            first = np.searchsorted(row, np.arange(len(meta) + 1))
            cells = lambda f: pa.array([f(i) for i in use], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [cells(lambda i: y[:, i].tobytes()), cells(lambda i: at[first[i]:first[i + 1]].tobytes()),
                 cells(lambda i: extra[i].astype(np.float32).tobytes()), cells(lambda i: meta[i].astype(np.float32).tobytes())], names=["y", "at", "extra", "meta"])

    out = written(map_arrow(pool, work, "y binary, at binary, extra binary, meta binary"), "exchange")
    shared.destroy()
    return out


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of rows ``x`` with labels ``y`` at ``w`` (bias last), in one array."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1, dtype=np.float32)
    z = x @ w
    p = sigmoid(z)
    curve = x.T @ (x * (p * (1 - p)).astype(np.float32)[:, None])
    return np.concatenate([[np.sum(np.logaddexp(0, z) - y * z)], x.T @ (p - y), curve.astype(float).ravel()])


def _pool_sums(rows: DataFrame, words: dict[str, np.ndarray], w: dict) -> dict:
    """``_sums`` over the compact rows for every (head, view) in ``w``, added up in tasks."""
    shared = rows.sparkSession.sparkContext.broadcast((words, w))

    def work(batches):
        words, w = shared.value
        union = np.unique(np.concatenate(list(words.values()))).astype(np.int64)
        names, out = list(words), {}
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                cells = [part.column(c).to_pylist() for c in range(4)]
                y = np.frombuffer(b"".join(cells[0]), np.int8).reshape(len(part), -1)
                at = np.frombuffer(b"".join(cells[1]), np.int16)
                x = np.zeros((len(part), len(union)), np.float32)
                x[np.repeat(np.arange(len(part)), [len(c) // 2 for c in cells[1]]), at] = 1
                extra, meta = (np.frombuffer(b"".join(c), np.float32).reshape(len(part), -1) for c in cells[2:])
                for h, view in w:
                    own = y[:, 2 * names.index(h) + view]
                    use = own >= 0
                    if use.any():
                        seen = meta[use] if view else np.concatenate([x[np.ix_(use, np.searchsorted(union, words[h]))], extra[use]], axis=1)
                        out[h, view] = out.get((h, view), 0) + _sums(seen, own[use], w[h, view])
        for (h, view), v in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([f"{h} {view}"]), pa.array([v.tobytes()], pa.binary())], names=["k", "v"])

    def add(batches):
        out = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out[k] = out.get(k, 0) + np.frombuffer(v)
        for k, v in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.tobytes()], pa.binary())], names=["k", "v"])

    schema = "k string, v binary"
    # in two steps, so that no task adds up more than about the root of the number of tasks
    groups = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    each = map_arrow(rows, work, schema).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups))).repartition("k", "g").select("k", "v")
    found = map_arrow(map_arrow(each, add, schema).repartition("k"), add, schema).collect()  # one row a head and view
    shared.destroy()
    return {(r.k.split()[0], int(r.k.split()[1])): np.frombuffer(r.v) for r in found}


def newton(own: dict, rows: DataFrame, words: dict[str, np.ndarray], start: dict) -> dict:
    """Weights per (head, view) of the regularised logistic regression on the rows ``own`` (x, y; or functions that give
    them, so that one view is held at a time) and the compact rows."""
    w, last, step, done = dict(start), {}, {}, set()
    for _ in range(NEWTON_STEPS):
        open_ = {k: v for k, v in w.items() if k not in done}
        if not open_:
            break
        pool = _pool_sums(rows, words, open_)
        for k, v in open_.items():
            d = len(v)
            total = _sums(*(own[k]() if callable(own[k]) else own[k]), v) + pool.get(k, 0)
            damp = np.full(d, 1.0)
            damp[-1] = 1e-3
            loss = total[0] + 0.5 * np.sum(damp * v * v)
            if k in last and loss > last[k] + 1e-6 * abs(last[k]):  # too far: half the step
                step[k] = step[k] / 2
                w[k] = v - step[k]
                continue
            g, curve = total[1:d + 1] + damp * v, total[d + 1:].reshape(d, d) + np.diag(damp)
            move = np.linalg.solve(curve, -g)
            last[k], step[k] = loss, move
            w[k] = v + move
            if -g @ move < 2 * NEWTON_ENOUGH:
                done.add(k)
    return w


def co_train(s: Sample, pool: DataFrame, rounds: int = ROUNDS) -> dict[str, Head]:
    """Both heads; the pool's passes serve them together."""
    out, rows = {}, {}
    for name in HEADS:
        given = s.labels[name].astype(float)
        fit_rows, held = (given >= 0) & ~s.held, (given >= 0) & s.held
        known = given[fit_rows]
        if len(set(known.tolist())) < 2:
            share = float(known.mean()) if len(known) else 0.5
            const = np.log((share * 100 + 1) / ((1 - share) * 100 + 1))
            out[name] = Head(np.zeros(0, np.int64), np.zeros(N_EXTRA + 1), np.zeros(N_META + 1), np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.0, 0.0, const]))
        else:
            rows[name] = given, fit_rows, held
    done = {h: [] for h in rows}
    logits = {}
    for r in range((rounds + 1) if rows else 0):
        if r == 0:
            words = {h: telling_words(*s.counts(np.where(fit_rows, given, -1))) for h, (given, fit_rows, _) in rows.items()}
        else:
            words = chosen_words(pool_counts(pool, done, s.table))
        # dense rows are built when a fit reads them: the driver holds those of one view, not of all
        given_rows = lambda h, k: (s.meta[rows[h][1]].astype(np.float32) if k else s.presence(words[h], rows[h][1]), rows[h][0][rows[h][1]])
        own = {(h, k): partial(given_rows, h, k) for h in rows for k in (0, 1)}
        w = {k: logistic(*own[k]()) for k in own}
        if r > 0:
            w = newton(own, compact(pool, done, words), words, w)
        for h, (given, _, held) in rows.items():
            z = [apply(w[h, 0], s.presence(words[h])), apply(w[h, 1], s.meta)]
            cal = [_platt(q[held], given[held]) for q in z]
            done[h].append(Views(words[h], w[h, 0], w[h, 1], np.concatenate(cal)))
            logits[h] = np.column_stack([c[0] * q + c[1] for c, q in zip(cal, z)])
    for h, (given, _, held) in rows.items():
        blend = logistic(logits[h][held], given[held], l2=0.05, steps=300) if len(set(given[held].tolist())) == 2 else np.array([0.5, 0.5, 0.0])
        v = done[h][-1]
        out[h] = Head(v.words, v.content, v.meta, v.calibration, blend)
    return out


FEATURE_SCHEMA = "doc_id long, words array<long>, extra array<double>, meta array<double>, quality int, toxic int, held boolean"
_KINDS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def _judged(docs: DataFrame):
    have = set(docs.columns)
    return [(c, (F.col(c) if c in have else F.lit(None)).cast(kind)) for c, kind in _KINDS.items()]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[c.alias(n) for n, c in _judged(docs)])


def _meta_of(batch, lo, hi, part, off):
    cut = lambda name: batch.column(name).slice(lo, hi - lo).to_pylist()
    return metadata(part, off, cut("lang"), cut("source"), cut("n_chars"))


def _features(batches):
    for batch in batches:
        buf, offsets = tk.text_buffer(batch.column("text"))
        for lo, hi, part, off in tk.slices(buf, offsets, SLICE_BYTES):
            row, code = word_codes(part, off)
            extra = repetition(row, code, hi - lo)
            both = np.unique((row << WORD_BITS) | code)
            row, code = both >> WORD_BITS, both & ((1 << WORD_BITS) - 1)
            first = np.searchsorted(row, np.arange(hi - lo + 1))
            meta = _meta_of(batch, lo, hi, part, off)
            cut = lambda name: batch.column(name).slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [cut("doc_id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(code, pa.int64())),
                 pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * N_EXTRA, pa.int32()), pa.array(extra.ravel())),
                 pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * N_META, pa.int32()), pa.array(meta.ravel())), cut("quality"), cut("toxic"),
                 pa.array(tk.mix(cut("doc_id").to_numpy().astype(np.uint64) + np.uint64(77)) % np.uint64(4) == 0)],
                names=[c.split()[0] for c in FEATURE_SCHEMA.split(", ")])


def _picked(labels: DataFrame) -> DataFrame:
    return (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
            .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic")))


def _least(df: DataFrame, n: int) -> DataFrame:
    # ids beyond the bound never leave the executors: a top-k by a hash of the id
    return df.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(n)


def unlabelled(docs: DataFrame, labels: DataFrame, pool_rows: int | None = None) -> DataFrame:
    """All documents with an id and without a label (or ``pool_rows`` ids of them)."""
    picked = written(in_fewer_files(_picked(labels).select("doc_id"), labels.count()), "labelled")
    pool = _columns(docs).where(F.col("doc_id").isNotNull()).join(broadcast_if(picked, BROADCAST_IDS), "doc_id", "left_anti")
    if pool_rows is None:
        return pool
    return pool.join(F.broadcast(_least(pool.select("doc_id").distinct(), pool_rows)), "doc_id", "left_semi")


def draw_sample(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Sample:
    """The bounded labelled rows for fitting, with the features of their whole texts."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    chosen = _least(_picked(labels).join(ids, "doc_id", "left_semi"), labelled_rows)
    kept = written(map_arrow(_columns(docs).join(F.broadcast(chosen), "doc_id"), _features, FEATURE_SCHEMA), "sample")
    table = kept.toArrow()
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    words = table.column("words").combine_chunks()
    lens = np.diff(words.offsets.to_numpy())
    doc = table.column("doc_id").to_numpy()
    numbers = lambda name, width: table.column(name).combine_chunks().flatten().to_numpy().reshape(len(doc), width)
    meta, extra = numbers("meta", N_META), numbers("extra", N_EXTRA)
    held = np.asarray(table.column("held").combine_chunks()).astype(bool)
    # hashed words and rows fit 32 bits
    word, row = words.flatten().to_numpy().astype(np.int32), np.repeat(np.arange(len(doc), dtype=np.int32), lens)
    labels = {h: table.column(h).to_numpy().copy() for h in HEADS}
    meta, extra = meta.copy(), extra.copy()  # not as parts of the table, which goes
    del table, words
    pa.default_memory_pool().release_unused()
    return Sample(row, word, extra, meta, labels, held, kept)


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, pool_rows: int | None = None) -> dict[str, Head]:
    return co_train(draw_sample(docs, labels, labelled_rows), unlabelled(docs, labels, pool_rows))


def head_logit(head: Head, row: np.ndarray, code: np.ndarray, extra: np.ndarray, meta: np.ndarray) -> np.ndarray:
    z = content_logit(head.words, head.content, row, code, extra)
    c = head.calibration
    return head.blend[0] * (c[0] * z + c[1]) + head.blend[1] * (c[2] * apply(head.meta, meta) + c[3]) + head.blend[2]


SCORE_SCHEMA = "doc_id long, p_quality double, p_toxic double, score double, kept boolean"


def verdicts(batch, heads: dict[str, Head], table: np.ndarray):
    """(first row, last row + 1, p_quality, p_toxic) over the slices of a batch."""
    buf, offsets = tk.text_buffer(batch.column("text"))
    for lo, hi, part, off in tk.slices(buf, offsets, SLICE_BYTES):
        row, code = word_codes(part, off)
        extra = repetition(row, code, hi - lo)
        used = table[code]
        both = np.unique((row[used] << WORD_BITS) | code[used])
        row, code = both >> WORD_BITS, both & ((1 << WORD_BITS) - 1)
        meta = _meta_of(batch, lo, hi, part, off)
        yield (lo, hi, *(sigmoid(head_logit(heads[h], row, code, extra, meta)) for h in HEADS))


def _used_words(heads: dict[str, Head]) -> np.ndarray:
    table = np.zeros(1 << WORD_BITS, bool)
    for h in heads.values():
        table[h.words] = True
    return table


def score(docs: DataFrame, heads: dict[str, Head]) -> DataFrame:
    """One row per document: both probabilities, score = p_quality * (1 - p_toxic), and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(heads)  # at most MAX_WORDS words and N_META numbers a head

    def work(batches):
        table = _used_words(shared.value)
        for batch in batches:
            for lo, hi, q, t in verdicts(batch, shared.value, table):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(q), pa.array(t), pa.array(q * (1 - t)), pa.array((q >= LEAST_GOOD) & (t < MOST_TOXIC))],
                    names=[c.split()[0] for c in SCORE_SCHEMA.split(", ")])

    return map_arrow(_columns(docs), work, SCORE_SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, in one pass over the texts."""
    heads = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(heads)
    judged, taken = dict(_judged(docs)), set(docs.columns)
    # columns of the right type are read as they are: a text goes to the tasks once
    aside = {c: c for c, t in docs.dtypes if _KINDS.get(c) == t}
    for c in [c for c in judged if c not in aside]:  # beside the row's own columns, under names that none of them has
        aside[c] = "_" + c
        while aside[c] in taken:
            aside[c] = "_" + aside[c]
    names = list(docs.columns)

    def work(batches):
        table = _used_words(shared.value)
        for batch in batches:
            seen = pa.RecordBatch.from_arrays([batch.column(n) for n in aside.values()], names=list(aside))
            good = [(q >= LEAST_GOOD) & (t < MOST_TOXIC) for _, _, q, t in verdicts(seen, shared.value, table)]
            if good:
                yield batch.select(names).filter(pa.array(np.concatenate(good)))

    both = docs.select("*", *[judged[c].alias(n) for c, n in aside.items() if c != n])
    return map_arrow(both, work, docs.schema)
