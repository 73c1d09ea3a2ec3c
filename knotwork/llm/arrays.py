"""Arrow and NumPy helpers: texts as byte arrays, words, hashes of spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a single longer text is still one block.
BLOCK = 1 << 20
#: White space of the word pattern: space and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A gap between runs of letters and digits; bytes of other scripts count as letters.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def blocks(column: pa.Array, size: int = BLOCK):
    """Yield ``(lo, hi, data, offsets)`` for runs of whole texts of about ``size`` bytes; null is empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """Start, end and text number of every run of bytes that are no gap (white space by default)."""
    solid = ~gap[data]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _powers(n: int):
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
        del _POWERS[:-2]
    return _POWERS


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of ordered, disjoint spans; equal bytes give equal hashes."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(int(np.searchsorted(ends, base + BLOCK, side="right")), lo + 1)
        part = data[base : ends[hi - 1]]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def runs(hashes: np.ndarray, doc: np.ndarray, n: int):
    """Hash of every window of ``n`` words, and whether it lies in one text."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0x94D049BB133111EB) + hashes[i : i + size]
    return mix(out + np.uint64(n)), doc[:size] == doc[n - 1 : n - 1 + size]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys are found twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each text."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def hash_words(text: str | None) -> np.ndarray:
    """The word hashes of one text (for tests and small sides)."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    starts, ends, _ = find_words(data, np.array([0, len(data)]))
    return span_hashes(data, starts, ends)
