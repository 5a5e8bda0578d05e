"""Words of whole texts as numpy arrays, straight from Arrow buffers (used inside Spark tasks).

A word is a maximal run of characters other than space and U+0009..U+000D. In UTF-8 these are single bytes,
so word bounds and hashes are computed on the byte buffer of a slice of rows, without Python strings.
Null texts count as empty. Slices hold about ``limit`` bytes and always whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV_BASE = pow(BASE, -1, 1 << 64)
_powers = {BASE: np.ones(1, np.uint64), _INV_BASE: np.ones(1, np.uint64)}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, grown by doubling and kept for the process."""
    t = _powers[base]
    while len(t) <= n:
        t = np.concatenate([t, t * np.uint64(pow(base, len(t), 1 << 64))])
        _powers[base] = t
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and odd multipliers)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def text_buffer(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is bytes[offsets[i]:offsets[i+1]]; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr, "").cast(pa.large_string())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    if data is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8), offsets


def slices(buf: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Yield (first row, last row + 1, bytes, offsets from 0) over runs of whole rows of about ``limit`` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (rows + 1 entries)."""
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = solid
    after = np.zeros(len(buf) + 1, bool)
    after[:-1] = solid
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hash of each byte span: a polynomial over random byte codes, scrambled with the length."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    pw, inv = _power_table(BASE, len(buf)), _power_table(_INV_BASE, len(buf))
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * pw[:len(buf)], out=c[1:])
    h = (c[ends] - c[starts]) * inv[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0x94D049BB133111EB)))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive symbols (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for i in range(1, n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i:i + m]
    return mix(out)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive symbols by prefix sums: cost does not depend on n."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    pw, inv = _power_table(BASE, len(h)), _power_table(_INV_BASE, len(h))
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * pw[:len(h)], out=c[1:])
    return mix((c[n:] - c[:m]) * inv[:m])


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask over n positions: those within ``length`` of a start."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:-1]) > 0


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The union of half-open intervals as ascending numbers: start, end, start, end, ..."""
    if len(starts) == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return np.column_stack([starts[head], reach[np.append(head[1:], len(starts)) - 1]]).ravel()


def inside(flat: np.ndarray, n: int) -> np.ndarray:
    """Mask over n positions of the intervals that ``merged`` lists."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, flat[0::2], 1)
    np.add.at(d, np.minimum(flat[1::2], n), -1)
    return np.cumsum(d[:-1]) > 0
