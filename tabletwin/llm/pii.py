"""Personal data: base patterns plus a semi-Markov conditional random field over whole spans.

The base patterns find e-mail addresses, IP addresses, card and phone numbers in their plain forms. The semi-Markov
model adds forms that they miss (phone numbers without a plus sign, spelled-out addresses). It scores candidate
segments of up to ``MAX_TOKENS`` tokens by features of the whole segment (shape, digit counts, check sums, context)
for every type, and one dynamic program over the text's token blocks chooses boundaries and types jointly; tokens
outside any block can be in no entity and score zero. Weights are fitted by conditional likelihood on a bounded
sample of documents (``SAMPLE_ROWS``), labelled by the base patterns, by rewritten forms of their matches, and by
fixed look-alikes that are no personal data.

Cases: null and empty texts have no spans; long texts are read whole; repeated rows are judged each by itself; an
empty table gives an empty result (the model is then fitted on the fixed examples alone).
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletwin.llm import tokens as tk
from tabletwin.llm.store import map_arrow

SAMPLE_ROWS = 200
MAX_TOKENS = 24
BUCKETS = 1 << 14
#: Bounds of the labelled sample, beside its documents: entities taken of a text, blocks taken of a text without any, and
#: tokens of a block. They bound the fit alone; finding reads all of every text.
FIT_ENTITIES, FIT_BLOCKS, FIT_TOKENS = 8, 4, 80
#: A segment is added if its margin over leaving its tokens outside is at least this (log odds).
MARGIN = 2.0

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))
    if kind == "card":
        d = _NOT_DIGIT.sub("", s)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_NOT_DIGIT.sub("", s)) <= 15
    return True


def _emails(text: str) -> list[tuple[int, int]]:
    """The e-mail pattern's matches, found from their @ signs: the local part is all that may stand before one."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _EMAIL_LEFT:
            left -= 1
        m = PATTERNS["email"].match(text, left) if left < at else None
        if m:
            out.append((left, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found = {"email": _emails(text)}
    for kind in KINDS[1:]:
        found[kind] = [m.span() for m in PATTERNS[kind].finditer(text) if _valid(kind, m.group())]
    return found


# ---- token blocks -------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[\[({]\s?(?:at|AT|dot|DOT)\s?[\])}]|[0-9]+|[^\W\d_]+|[^\s]")
#: What an entity is built around: a number with its punctuation, an at sign, a spelled-out one.
_CORE = re.compile(r"[+(]{0,2}[0-9][0-9() .+-]*|@|[\[({]\s?(?:at|AT)\s?[\])}]|\sat\s(?=[\w.%+-]{1,64}\sdot\s)")
_RIGHT = re.compile(r"\s?[\w.%+-]{1,64}(?:(?:\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\sdot\s)[\w.%+-]{1,64})*")
_LEFT = frozenset(_EMAIL_LEFT)
_SPELLED = re.compile(rb"[\[({]\s?(?:at|AT)\s?[\])}]|\sdot\s")
_HAS = np.zeros(256, bool)
_HAS[[ord(c) for c in "0123456789@"]] = True
#: Characters of the words around a number that belong to its block.
NEAR = 16


def blocks(text: str) -> list[tuple[int, int]]:
    """Stretches of the text in which an entity can lie, in order, without overlaps."""
    out: list[tuple[int, int]] = []
    for m in _CORE.finditer(text):
        a, b = m.span()
        if any(_number(c) for c in m.group()[:3]):
            b = a + len(m.group().rstrip())
            stop = a - NEAR
            while a > max(0, stop) and not text[a - 1].isspace():
                a -= 1
            stop = b + NEAR
            while b < min(len(text), stop) and not text[b].isspace():
                b += 1
        else:
            if a and text[a - 1].isspace():
                a -= 1
            stop = a - 64
            while a > max(0, stop) and text[a - 1] in _LEFT:
                a -= 1
            right = _RIGHT.match(text, b)
            b = right.end() if right else b
        if out and a < out[-1][1]:
            out[-1] = (min(a, out[-1][0]), max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _number(token: str) -> bool:
    return token[0] in "0123456789"


def _segment_shape(tokens: list[str], gaps: list[str]) -> str:
    out = []
    for t, g in zip(tokens, gaps):
        out.append(f"{g}d{min(len(t), 20)}" if _number(t) else g + ("w" if t[0].isalpha() else t))
    return "".join(out).strip()


def _id(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def segment_features(text: str, toks: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Feature numbers of the segment of tokens i..j-1: what it looks like as a whole, and what stands around it."""
    start, end = toks[i][0], toks[j - 1][1]
    words = [text[a:b] for a, b in toks[i:j]]
    gaps = [""] + [" " if toks[k][0] > toks[k - 1][1] else "" for k in range(i + 1, j)]
    s = text[start:end]
    groups = [w for w in words if _number(w)]
    digits = "".join(groups)
    n, letters = len(digits), any(w[0].isalpha() for w in words)
    shape = _segment_shape(words, gaps)
    kind = re.sub(r"d\d+", "d", shape)
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    cls = lambda c: "0" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c
    phoneish = not letters and set(s) <= set("0123456789() .-+") and "@" not in s
    f = ["bias", f"digits:{min(n, 20)}:{len(groups)}:{letters}", f"kind:{kind[:24]}",
         f"before:{cls(before)}:{kind[:1]}", f"after:{cls(after)}:{kind[-1:]}",
         f"tight:{cls(before)}:{cls(after)}:{letters}", f"ends:{cls(s[0])}:{cls(s[-1])}"]
    if phoneish:
        f += [f"groups:{'-'.join(str(min(len(g), 20)) for g in groups)[:24]}", f"phone:{9 <= n <= 15}:{'(' in s}:{'-' in s or ' ' in s}:{s.count('(') == s.count(')')}"]
        if 13 <= n <= 19:
            f.append(f"luhn:{luhn(digits)}")
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s):
        f.append(f"quad:{all(int(p) <= 255 for p in s.split('.'))}:{cls(before) in '.0'}:{cls(after) in '.0'}")
    if letters:
        mark = "@" if "@" in s else "(at)" if re.search(r"[\[({]\s?at\s?[\])}]", s, re.I) else " at " if " at " in s else ""
        dot = "(dot)" if re.search(r"[\[({]\s?dot\s?[\])}]", s, re.I) else " dot " if " dot " in s else "." if "." in s else ""
        f += [f"address:{mark}:{dot}:{s.count('@')}", f"edge:{words[0].isalnum()}:{words[-1].isalnum()}:{bool(mark)}"]
    return [_id(x) for x in f]


class Lattice:
    """All candidate segments of one block, with their features."""

    def __init__(self, text: str, block: tuple[int, int], also: frozenset[tuple[int, int]] = frozenset()):
        """``also``: code point spans that are candidates whatever their length (known entities)."""
        self.text = text
        self.toks = [(m.start(), m.end()) for m in _TOKEN.finditer(text, *block)]
        spans, feats = [], []
        for i in range(len(self.toks)):
            for j in range(i + 1, len(self.toks) + 1):
                known = (self.toks[i][0], self.toks[j - 1][1]) in also
                if j - i > MAX_TOKENS and not known:
                    if not also:
                        break
                    continue
                if j - i < 2 and self.toks[i][1] - self.toks[i][0] < 9 and not known:
                    continue  # a single token is an entity only as a long run of digits
                spans.append((i, j))
                feats.append(segment_features(text, self.toks, i, j))
        width = max(map(len, feats), default=0)
        self.spans = spans
        self.feats = np.array([f + [BUCKETS] * (width - len(f)) for f in feats], np.int64).reshape(len(feats), width)
        self.ending = [[] for _ in range(len(self.toks) + 1)]
        for k, (_, j) in enumerate(spans):
            self.ending[j].append(k)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return weights[self.feats].sum(1) if self.spans else np.zeros((0, len(KINDS)))

    def best(self, weights: np.ndarray) -> list[tuple[int, int, str, float]]:
        """The segmentation of highest score: (start, end, kind, score) of its entities, code points."""
        sc = self.scores(weights)
        n = len(self.toks)
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for k in self.ending[j]:
                y = int(sc[k].argmax())
                v = value[self.spans[k][0]] + sc[k, y]
                if v > value[j]:
                    value[j], back[j] = v, (k, y)
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                k, y = back[j]
                i = self.spans[k][0]
                out.append((self.toks[i][0], self.toks[j - 1][1], KINDS[y], float(sc[k, y])))
                j = i
        return out[::-1]

    def expected(self, weights: np.ndarray) -> tuple[np.ndarray, float]:
        """Probability of each (segment, type) and the log partition sum, by forward and backward sums."""
        sc = self.scores(weights)
        n = len(self.toks)
        inner = np.logaddexp.reduce(sc, axis=1) if len(sc) else np.zeros(0)
        f, b = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            f[j] = np.logaddexp.reduce([f[j - 1]] + [f[self.spans[k][0]] + inner[k] for k in self.ending[j]])
        starting = [[] for _ in range(n + 1)]
        for k, (i, _) in enumerate(self.spans):
            starting[i].append(k)
        for i in range(n - 1, -1, -1):
            b[i] = np.logaddexp.reduce([b[i + 1]] + [inner[k] + b[self.spans[k][1]] for k in starting[i]])
        at = np.array([f[i] + b[j] for i, j in self.spans]) if self.spans else np.zeros(0)
        return np.exp(sc + (at - f[n])[:, None]), float(f[n])


# ---- fitting ------------------------------------------------------------------------------------------------

#: Look-alikes that are no personal data.
DISTRACTORS = ("on 2021-05-17 it was", "from 1999 to 2004,", "a price of 12.50 and 1,300.75", "version 1.2.3 of", "build 10.4.2.1889 of",
               "pages 120-134", "at 10:45:30 on", "order 4821 of 9300", "ISBN 978-3-16-148410-0 in", "3 + 4 = 7", "about 100 000 people", "look at the 5 dots",
               "section 4.2.1", "score 21-17, 18-21", "12345678", "id 555-77", "it was at home and at work", "x = 0.00012", "serial 8827361", "100 200 300 400 500")
#: Plain examples, used beside those found in the sample.
EXAMPLES = (("write to ann.lee@mail.example.org today", "email"), ("from bob_r@example.com, who", "email"), ("(j.smith42@site.example.net)", "email"),
            ("mail: info@example.co.uk", "email"), ("by kim@uni.example.edu.", "email"), ("reach +1 (646) 555-0190 or", "phone"), ("call +1 (212) 555-0147 now", "phone"), ("host 192.168.20.7 is up", "ip"), ("card 4111 1111 1111 1111 was", "card"))


#: Ways to spell out an address.
FORMS = 5


def _rewritten(text: str, span: tuple[int, int], kind: str, n: int) -> tuple[str, tuple[int, int]] | None:
    """The entity in a form that the base patterns miss, in its place."""
    s = text[span[0]:span[1]]
    if kind == "phone":
        m = re.fullmatch(r"\+\d{1,3}[ .-]?(\(?\d{3}\)?)[ .-]?(\d{3})[ .-]?(\d{4})", s)
        if not m:
            return None
        a, b, c = m.groups()
        s = (f"{a} {b}-{c}", f"{a.strip('()')}-{b}-{c}", f"{a.strip('()')}.{b}.{c}")[n % 3]
    elif kind == "email":
        user, host = s.split("@", 1)
        spelled = lambda dot: host.replace(".", dot)
        s = (f"{user} (at) {host}", f"{user}[at]{spelled('[dot]')}", f"{user} at {spelled(' dot ')}", f"{user} [at] {spelled(' [dot] ')}",
             f"{user} (at) {spelled(' (dot) ')}")[n % FORMS]
    else:
        return None
    return text[:span[0]] + s + text[span[1]:], (span[0], span[0] + len(s))


def _context(text: str, span: tuple[int, int], reach: int = 60) -> tuple[str, tuple[int, int]]:
    lo = max(0, span[0] - reach)
    return text[lo:span[1] + reach], (span[0] - lo, span[1] - lo)


def training_cases(texts: list[str]) -> list[tuple[Lattice, list[tuple[int, int]]]]:
    """Lattices and their gold entities as (segment number, type number)."""
    snippets = [(d, []) for d in DISTRACTORS]
    for text, kind in EXAMPLES:
        span = next(iter(base_spans(text)[kind]))
        snippets.append((text, [(span, kind)]))
        snippets += [(new[0], [(new[1], kind)]) for n in range(FORMS) if (new := _rewritten(text, span, kind, n))]
    for text in texts:
        found = [(s, k) for k, v in base_spans(text).items() for s in v]
        for n, (span, kind) in enumerate(sorted(found)[:FIT_ENTITIES]):
            near, at = _context(text, span)
            snippets.append((near, [(s, k) for k, v in base_spans(near).items() for s in v]))
            if new := _rewritten(near, at, kind, n):
                snippets.append((new[0], [(new[1], kind)] + [(s, k) for k, v in base_spans(new[0]).items() for s in v if s[1] <= new[1][0] or s[0] >= new[1][1]]))
        if not found:
            snippets += [(text[max(0, a - 30):b + 30], []) for a, b in blocks(text)[:FIT_BLOCKS]]
    cases = []
    for text, gold in snippets:
        for block in blocks(text):
            lat = Lattice(text, block, frozenset(s for s, _ in gold))
            if len(lat.toks) > FIT_TOKENS:
                continue
            where = {(lat.toks[i][0], lat.toks[j - 1][1]): k for k, (i, j) in enumerate(lat.spans)}
            cases.append((lat, [(where[s], KINDS.index(k)) for s, k in gold if s in where]))
    return cases


def fit(texts: list[str], epochs: int = 8, rate: float = 0.4, shrink: float = 1e-4) -> np.ndarray:
    """Weights (BUCKETS + 1, types) by stochastic gradient steps on the conditional likelihood (last row: padding)."""
    cases = [c for c in training_cases(texts) if c[0].spans]
    w = np.zeros((BUCKETS + 1, len(KINDS)))
    scale = np.full_like(w, 1e-2)
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for c in order.permutation(len(cases)):
            lat, gold = cases[c]
            p, _ = lat.expected(w)
            g = -p
            for k, y in gold:
                g[k, y] += 1.0
            used = np.unique(lat.feats)
            grad = np.zeros((len(used), len(KINDS)))
            np.add.at(grad, np.searchsorted(used, lat.feats), g[:, None, :])
            grad -= shrink * w[used]
            scale[used] += grad**2
            w[used] += rate * grad / np.sqrt(scale[used])
            w[BUCKETS] = 0.0
    return w


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], weights: np.ndarray) -> list[tuple[int, int, str]]:
    """Entities of the best segmentation that overlap no base span."""
    taken = sorted(s for v in base.values() for s in v)
    out = []
    for block in blocks(text):
        for a, b, kind, score in Lattice(text, block).best(weights):
            if score >= MARGIN and not any(x < b and a < y for x, y in taken):
                out.append((a, b, kind))
    return out


# ---- the operator -------------------------------------------------------------------------------------------

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """Whole texts with a digit or an at sign and the least hash of their id."""
    # only ids are compared; the texts of the chosen ones are fetched afterwards
    least = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.where(F.col("text").rlike("[0-9@]")).join(F.broadcast(least), "doc_id").select("doc_id", "text")
    # repeated ids: the first texts in order, whatever the plan
    return [r.text for r in picked.orderBy("doc_id", "text").limit(rows).collect()]


def find(docs: DataFrame, weights: np.ndarray | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document (doc_id, text) with the counts of base spans, their digest, and all spans."""
    w = fit(sample_texts(docs, sample_rows)) if weights is None else weights
    shared = docs.sparkSession.sparkContext.broadcast(w)  # BUCKETS x 4 numbers, whatever the corpus

    def work(batches):
        model = shared.value
        for batch in batches:
            buf, offsets = tk.text_buffer(batch.column(1))
            for lo, hi, part, off in tk.slices(buf, offsets):
                marked = np.concatenate([[0], np.cumsum(_HAS[part])])
                maybe = marked[off[1:]] > marked[off[:-1]]
                raw = part.tobytes()
                for m in _SPELLED.finditer(raw):
                    maybe[np.searchsorted(off, m.start(), side="right") - 1] = True
                rows = []
                for i in range(hi - lo):
                    if not maybe[i]:
                        rows.append((0, 0, 0, 0, _EMPTY, "", 0))
                        continue
                    text = raw[off[i]:off[i + 1]].decode("utf-8", "replace")
                    base = base_spans(text)
                    more = added_spans(text, base, model)
                    listed = [(k, a, b) for k in KINDS for a, b in base[k]]
                    every = sorted(listed + [(k, a, b) for a, b, k in more], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                    rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(_joined(listed).encode()).hexdigest(), _joined(every), len(more)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in cols[:4]],
                     pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64())],
                    names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, SCHEMA)


def log_likelihood(cases, weights: np.ndarray) -> float:
    """Conditional log-likelihood of labelled lattices (used to test the fit)."""
    total = 0.0
    for lat, gold in cases:
        sc = lat.scores(weights)
        total += sum(sc[k, y] for k, y in gold) - lat.expected(weights)[1]
    return total if math.isfinite(total) else -math.inf
