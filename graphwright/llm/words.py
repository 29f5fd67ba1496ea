"""Words of Arrow text columns as NumPy arrays: places, 64-bit hashes, shapes.

A word is a maximal run of letters, digits, underscores and other code points
from U+00C0 on (general punctuation U+2000 to U+203F excepted); a point or
comma between two digits belongs to its number.  Hashes are of the lower-case
form.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import buffers, mix64

_ROOT = 0x9E3779B97F4A7C15 | 1
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(0x80, 0x100)]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_ROOT, -1, 1 << 64)
        _POWERS[:] = []
        for root in (_ROOT, inverse):
            p = np.full(size, root, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    doc: np.ndarray      # row of each word
    hash: np.ndarray     # of its lower-case form
    start: np.ndarray    # byte offset within the batch's text
    end: np.ndarray
    raw: np.ndarray      # bytes as written
    low: np.ndarray      # bytes in lower case (same places)
    offsets: np.ndarray  # byte offsets of the rows

    def bounds(self, n_docs: int) -> np.ndarray:
        """First word of each row, and the number of words."""
        return np.searchsorted(self.doc, np.arange(n_docs + 1))


def _same_length_lower(texts: pa.Array) -> pa.Array:
    low = pc.utf8_lower(texts)
    if pc.binary_length(low).equals(pc.binary_length(texts)):
        return low
    def lower(c):
        x = c.lower()
        return x if len(x.encode()) == len(c.encode()) else c
    return pa.array(["".join(map(lower, t)) for t in texts.to_pylist()], pa.string())


def words(texts: pa.Array) -> Words:
    texts = texts.cast(pa.string())
    offsets, raw = buffers(texts)
    _, low = buffers(_same_length_lower(texts))
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none.astype(np.uint64), none, none, raw, low, offsets)
    inside = _WORD[raw]
    after = np.r_[raw[1:], np.uint8(0)]
    for lead, size in ((0xC2, 2), (0xE2, 3)):
        at = np.flatnonzero((raw == lead) & ((after >= 0xA0) if size == 2 else (after == 0x80)))
        for k in range(size):
            inside[(at + k).clip(max=n - 1)] = False
    digit = (raw >= 48) & (raw <= 57)
    marks = np.flatnonzero(((raw == 46) | (raw == 44))[1:-1] & digit[:-2] & digit[2:]) + 1
    inside[marks] = True
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    begin = inside & (np.r_[True, ~inside[:-1]] | first)
    start = np.flatnonzero(begin)
    end = np.flatnonzero(inside & np.r_[~inside[1:] | first[1:], True]) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[low] * up[:n], out=total[1:])
    h = mix64((total[end] - total[start]) * down[start])
    return Words(np.searchsorted(offsets, start, side="right") - 1, h, start, end, raw, low, offsets)


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` hashes (one for each possible start)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out *= np.uint64(_ROOT)
        out += h[k:n + k]
    return mix64(out)


def same_doc(doc: np.ndarray, size: int) -> np.ndarray:
    """Whether the run of ``size`` words from each start stays in one row."""
    n = len(doc) - size + 1
    return doc[:n] == doc[size - 1:] if n > 0 else np.zeros(0, bool)
