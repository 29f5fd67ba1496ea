"""Suffix arrays by induced sorting, whole buckets at a time.

The text is an integer array over a small alphabet that ends with a single 0.
A suffix is of type S if it is smaller than the next one, else of type L; a
leftmost S position (LMS) follows an L position.  LMS substrings are sorted by
induction and named; while names repeat, pairs of names are named again
(each round doubles what a name covers), until all differ or cover ``depth``
symbols.  From the sorted LMS suffixes two linear scans induce all others.  A
scan reads a bucket in waves: what a wave induces into its own bucket is the
next wave.
"""

from __future__ import annotations

import numpy as np

from .common import mix64


def types(text: np.ndarray) -> np.ndarray:
    """True for type S (the last position is S)."""
    n = len(text)
    differs = np.r_[text[:-1] != text[1:], True]
    at = np.where(differs, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]  # next place that differs from its successor
    rises = np.r_[text[:-1] < text[1:], True]
    return rises[at]


def _place(chars: np.ndarray):
    """(stable order by symbol, symbol of each, place within its symbol, symbols, counts)."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    count = np.diff(np.r_[cut, len(c)])
    return order, c, np.arange(len(c)) - np.repeat(cut, count), c[cut], count


def _induce(code, sa, starts, ends, seeds):
    """Fill L positions from the seeds (sorted LMS positions at the bucket ends), then
    all S positions.  ``code`` is twice the symbol, plus 1 for type S."""
    k = len(starts)
    l_fill, s_start = starts.copy(), ends.copy()
    order, c, within, symbols, count = _place(code[seeds] >> 1)
    s_start[symbols] = ends[symbols] - count
    sa[s_start[c] + within] = seeds[order]

    def left(wave):
        j = wave - 1  # before place 0 stands the end mark, of type S
        x = code[j]
        keep = np.flatnonzero((x & 1) == 0)
        if len(keep):
            order, c, within, symbols, count = _place(x[keep] >> 1)
            sa[l_fill[c] + within] = j[keep[order]]
            l_fill[symbols] += count

    for c in range(k):
        at = starts[c]
        while at < l_fill[c]:
            stop = l_fill[c]
            wave, at = sa[at:stop], stop
            left(wave)
        if s_start[c] < ends[c]:
            left(sa[s_start[c]:ends[c]])

    s_fill = ends.copy()

    def right(wave):
        j = wave - 1
        x = code[j]
        keep = np.flatnonzero((x & 1) & (x != 1))
        if len(keep):
            order, c, within, symbols, count = _place(x[keep] >> 1)
            sa[s_fill[c] - 1 - within] = j[keep[order]]
            s_fill[symbols] -= count

    for c in range(k - 1, 0, -1):
        at = ends[c]
        while s_fill[c] < at:
            stop = s_fill[c]
            wave, at = sa[stop:at][::-1], stop
            right(wave)
        if starts[c] < l_fill[c]:
            right(sa[starts[c]:l_fill[c]][::-1])
    sa[0] = len(code) - 1  # the end mark
    return sa


def _names(text, lms, sorted_lms):
    """Rank of each LMS substring (in text order); equal substrings have equal ranks."""
    n = len(text)
    root = np.uint64(0x9E3779B97F4A7C15)
    powers = np.full(n + 1, root, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(n + 1, np.uint64(pow(int(root), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(text.astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
    stop = np.r_[lms[1:] + 1, n]  # up to and with the next LMS position
    value = mix64((total[stop] - total[lms]) * inverse[lms]) ^ (stop - lms).astype(np.uint64)
    at = np.searchsorted(lms, sorted_lms)
    new = np.r_[False, value[at][1:] != value[at][:-1]]
    rank = np.empty(len(lms), np.int64)
    rank[at] = np.cumsum(new)
    return rank


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places of the sorted suffixes; with ``depth``, suffixes that agree on so many
    symbols stand together in any order."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    sizes = np.bincount(text)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    is_s = types(text)
    code = (text.astype(np.uint16) << 1) | is_s
    lms = np.flatnonzero(is_s & np.r_[False, ~is_s[:-1]]).astype(np.int32)
    sa = _induce(code, np.zeros(n, np.int32), starts, ends, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rank = _names(text, lms, sa[is_lms[sa]])
    covered = 1  # names that a rank stands for; each holds two symbols or more
    while True:
        most = int(rank.max()) + 2
        if most - 1 >= len(lms) or (depth is not None and 2 * covered > depth + 1):
            break
        ahead = 3 if most ** 3 < 1 << 63 else 2
        key = rank.copy()
        for k in range(1, ahead):
            key *= most
            key[:max(0, len(key) - k * covered)] += rank[k * covered:] + 1
        order = np.argsort(key, kind="stable")
        value = key[order]
        rank = np.empty(len(lms), np.int64)
        rank[order] = np.cumsum(np.r_[False, value[1:] != value[:-1]])
        covered *= ahead
    return _induce(code, np.zeros(n, np.int32), starts, ends, lms[np.argsort(rank, kind="stable")])


def permuted_prefixes(raw: np.ndarray, sa: np.ndarray, limit: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Common prefix, up to ``limit`` bytes, of each suffix with the one before it in
    the array, by text position (only the ``wanted`` ones, if given).  ``raw`` must have
    ``limit`` + 8 bytes to spare after the positions of ``sa``."""
    n = len(raw) - limit - 8
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    word = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view("<u8").ravel()
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0 if wanted is None else (before >= 0) & wanted)
    at = 0
    while at < limit and len(live):
        x = word[live + at] ^ word[before[live] + at]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
        out[live] += same
        live = live[same == 8]
        at += 8
    return np.minimum(out, limit)
