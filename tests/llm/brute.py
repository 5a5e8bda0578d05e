"""Plain versions of the operators' contracts, one text at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m.group())] for k, p, ok in kinds}


def pii_row(text):
    found = pii(text)
    return tuple(len(v) for v in found.values()) + (sha(",".join(f"{k}:{a}:{b}" for k, v in found.items() for a, b in v)),)


def secrets(text):
    text = text or ""
    kinds = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
    ]
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m)] for k, p, ok in kinds}


def secrets_row(text):
    found = secrets(text)
    rank = list(found)
    spans = sorted((a, rank.index(k), b, k) for k, v in found.items() for a, b in v)
    return tuple(len(v) for v in found.values()) + (sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)),)


def rules_row(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i:i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def jaccard_rows(docs):
    """doc_id -> (n_shingles, component_id)."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    tested = set()
    for members in by.values():
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                if (a, b) not in tested:
                    tested.add((a, b))
                    inter = len(sets[a] & sets[b])
                    if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                        ra, rb = root(a), root(b)
                        parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def runs(mask):
    return sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))


def byte_dedup_rows(docs, width=100):
    """(doc_id, text) in doc_id order -> doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i:i + width]
            if w in seen:
                gone[i:i + width] = b"\x01" * width
            else:
                seen.add(w)
        out[d] = (len(b), sum(gone), runs(gone), sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def word_dedup_rows(docs, width=50):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        w = words(t)
        gone, new = [False] * len(w), set()
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            if k in seen:
                gone[i:i + width] = [True] * width
            else:
                new.add(k)
        seen |= new
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())
