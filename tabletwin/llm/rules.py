"""Quality rules as a short-circuit cascade.

Each rule rejects a document on a count of its text. On a bounded sample (the documents with the least hash of
their id) the order is found step by step: of the rules left, the one with most rejections per second among the texts
that all before it let through comes next. A rule's seconds are the median of several runs given the counts that are made
for every document anyway and those that earlier rules have made, so shared work is charged once. Each rule then
sees only the documents that all before it let through. The verdict is the conjunction of all rules, so it does not
depend on the order that was found.

Cases: null and empty texts have no words and fail the word count; very long texts are read whole; repeated rows
are judged each by itself; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletwin.llm import tokens as tk
from tabletwin.llm.store import map_arrow

#: Documents on which costs and rejections are measured.
SAMPLE_ROWS = 256
#: Timed runs of a rule at each step; their median counts.
RUNS = 5
#: The counts of the result, made for every document.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The symbols counted, the least words, and the most repeated words in percent.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PCT = 20

_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in SYMBOLS]] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_lower = np.zeros(256, bool)
_lower[97:123] = True
_letter = _upper | _lower
_letter[0xC3:0xF5] = True


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return np.diff(c[offsets])


class Texts:
    """Some whole texts and the counts that rules ask for; each count is made once, when first asked for."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets, self.n, self._known = buf, offsets, len(offsets) - 1, {}

    def take(self, rows: np.ndarray) -> "Texts":
        """The texts of the given rows (ascending) with the counts that are known already."""
        if len(rows) == self.n:
            return self
        lens = np.diff(self.offsets)
        keep = np.zeros(self.n, bool)
        keep[rows] = True
        part = Texts(self.buf[np.repeat(keep, lens)], np.concatenate([[0], np.cumsum(lens[rows])]))
        part._known = {k: v[rows] for k, v in self._known.items() if isinstance(v, np.ndarray) and len(v) == self.n and k[0] != "_"}
        return part

    def again(self) -> "Texts":
        """The same texts and known counts; what is counted from here on is not known to ``self``."""
        copy = Texts(self.buf, self.offsets)
        copy._known = dict(self._known)
        return copy

    def get(self, name: str):
        if name not in self._known:
            self._known[name] = getattr(self, f"count_{name}")()
        return self._known[name]

    def count__bounds(self):
        return tk.word_bounds(self.buf, self.offsets)

    def count__hashes(self):
        starts, ends, _ = self.get("_bounds")
        return tk.span_hashes(self.buf, starts, ends)

    def count__lines(self):
        """Start, end and row of each line that has a word, and the number of such lines in each row."""
        nl = np.flatnonzero(self.buf == 10)
        from_ = np.sort(np.concatenate([self.offsets[:-1], nl + 1]))
        row = np.searchsorted(self.offsets, from_, side="right") - 1
        # a line start equal to the next text's start can be an empty last line as well: it has no word either way
        to = np.concatenate([nl, self.offsets[1:]])
        to.sort()
        starts, _, _ = self.get("_bounds")
        has = np.searchsorted(starts, from_) < np.searchsorted(starts, to)
        row = row[has]
        return from_[has], to[has], row, np.bincount(row, minlength=self.n)

    def count_n_words(self):
        return np.diff(self.get("_bounds")[2])

    def count_word_chars(self):
        return _per_row(~tk.SPACE[self.buf] & ((self.buf & 0xC0) != 0x80), self.offsets)

    def count_n_symbols(self):
        return _per_row(_symbol[self.buf], self.offsets)

    def count_n_dup_lines(self):
        from_, to, row, _ = self.get("_lines")
        if len(row) == 0:
            return np.zeros(self.n, np.int64)
        key = tk.mix(tk.span_hashes(self.buf, from_, to) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        again = order[1:][key[order][1:] == key[order][:-1]]
        return np.bincount(row[again], minlength=self.n)

    def count_n_lines(self):
        return self.get("_lines")[3]

    def count_n_repeat_words(self, width: int = 5):
        first, h = self.get("_bounds")[2], self.get("_hashes")
        grams = tk.gram_hashes(h, width)
        if len(grams) == 0:
            return np.zeros(self.n, np.int64)
        row = np.repeat(np.arange(self.n), np.diff(first))
        inside = row[:len(grams)] == row[width - 1:]
        at = np.flatnonzero(inside)
        key = tk.mix(grams[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = tk.covered(at[twice], width, len(h))
        return np.bincount(row[cover], minlength=self.n)

    def count_n_upper(self):
        return _per_row(_upper[self.buf], self.offsets)

    def count_n_lower(self):
        return _per_row(_lower[self.buf], self.offsets)

    def count_n_letter_words(self):
        """Words with a letter."""
        starts, ends, first = self.get("_bounds")
        c = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(_letter[self.buf], out=c[1:])
        return _per_row(c[ends] > c[starts], first)


@dataclass(frozen=True)
class QualityRule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


BASE = (
    QualityRule("few_words", lambda t: t.get("n_words") < MIN_WORDS),
    QualityRule("repeated_words", lambda t: 100 * t.get("n_repeat_words") > MAX_REPEAT_PCT * t.get("n_words")),
)
CASCADE = (
    QualityRule("symbols", lambda t: 100 * t.get("n_symbols") > 50 * t.get("n_words")),
    QualityRule("duplicate_lines", lambda t: 100 * t.get("n_dup_lines") > 30 * np.maximum(t.get("n_lines"), 1)),
    QualityRule("word_length", lambda t: (t.get("word_chars") < 2 * t.get("n_words")) | (t.get("word_chars") > 15 * t.get("n_words"))),
    QualityRule("capitals", lambda t: 100 * t.get("n_upper") > 60 * (t.get("n_upper") + t.get("n_lower"))),
    QualityRule("no_letters", lambda t: 100 * t.get("n_letter_words") < 50 * t.get("n_words")),
)


def run_order(texts: Texts, rules=CASCADE, runs: int = RUNS) -> list[str]:
    """Names of the rules in the order in which they should run on texts that are counted already (ties by name)."""
    left, order = {r.name: r for r in rules}, []
    while left:
        score, passed = {}, {}
        for name, r in left.items():
            seconds = []
            for _ in range(runs):
                part = texts.again()
                began = time.perf_counter()
                bad = r.rejects(part) if texts.n else np.zeros(0, bool)
                seconds.append(time.perf_counter() - began)
            score[name] = (int(bad.sum()) + 0.5) / (float(np.median(seconds)) + 1e-9)
            passed[name] = part.take(np.flatnonzero(~bad))
        best = min(left, key=lambda n: (-score[n], n))
        order.append(best)
        texts = passed[best]
        del left[best]
    return order


def counted(texts: Texts) -> tuple[Texts, np.ndarray]:
    """The texts with the counts of the result, and the index of the base rule that rejects each (-1: none)."""
    for c in COUNTS:
        texts.get(c)
    base = np.full(texts.n, -1)
    for i, r in reversed(list(enumerate(BASE))):
        base[r.rejects(texts)] = i
    return texts, base


def cascade(texts: Texts, rules) -> np.ndarray:
    """Index of the rule that rejects each text, -1 for those that all let through."""
    verdict, rows = np.full(texts.n, -1), np.arange(texts.n)
    for i, r in enumerate(rules):
        if len(rows) == 0:
            break
        bad = r.rejects(texts)
        verdict[rows[bad]] = i
        good = np.flatnonzero(~bad)
        texts, rows = texts.take(good), rows[good]
    return verdict


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Texts:
    """The texts of the ids with the least hash; only ids are compared, the texts of the chosen ones are fetched afterwards."""
    least = docs.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    picked = docs.select("doc_id", "text").join(F.broadcast(least), "doc_id").orderBy("doc_id", "text").limit(rows).toArrow()
    return Texts(*tk.text_buffer(picked.column("text")))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def judge(docs: DataFrame, rules=CASCADE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document (doc_id, text): the counts, base_failed, kept, and the rule that rejected it."""
    sample, base = counted(sample_texts(docs, sample_rows))
    order = run_order(sample.take(np.flatnonzero(base < 0)), rules)
    by_name = {r.name: r for r in rules}
    names = [r.name for r in BASE] + order
    ordered = [by_name[n] for n in order]

    def work(batches):
        for batch in batches:
            buf, offsets = tk.text_buffer(batch.column(1))
            for lo, hi, part, off in tk.slices(buf, offsets):
                t, base = counted(Texts(part, off))
                cols = [t.get(c) for c in COUNTS]
                verdict = base.copy()
                passed = np.flatnonzero(base < 0)
                later = cascade(t.take(passed), ordered)
                verdict[passed] = np.where(later >= 0, later + len(BASE), -1)
                why = pa.array([None if v < 0 else names[v] for v in verdict], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in cols],
                     pa.array(base >= 0), pa.array(verdict < 0), why],
                    names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, SCHEMA)
