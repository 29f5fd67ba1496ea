"""Exact substring deduplication with suffix arrays built by induced sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a
document with a smaller ``doc_id`` is removed.  Overlaps count, strings are
judged on the input, and matches never cross documents.

1. Documents are cut into content-defined chunks.  A chunk with the bytes that
   the windows starting in it need is hashed; windows of a chunk that occurs
   in an earlier document are removed at once, and only the chunk's first
   document goes on (pre-aggregation of copies).
2. Every window has an anchor, its smallest gram hash: equal windows have equal
   anchors.  Anchors that occur once can not match.  A bitmap of fixed size
   (``FILTER_BITS``, ``TRIES`` bits for an anchor) holds those that occur more often; it is
   a filter without false negatives.  More repeated anchors than it serves
   (``ROUND_ANCHORS``) are dealt to several bitmaps, each for a scan of its own, so
   it keeps its force at any size.
   Anchors that occur very often are counted anew by the longer strings that
   up to ``PART`` neighbouring windows share, so those common by chance drop out.
3. Runs of windows with one anchor go, with their bytes, to the shard of the
   anchor.  Windows of strings that still occur very often go one by one to the
   shard of their own hash, so no shard gathers a hot anchor.  A task sends the bytes
   of such a window once, and its later copies as spans.
4. A shard sorts its suffixes by induction and computes permuted common
   prefixes; suffixes that share ``LENGTH`` bytes form a group, and all but
   those of the smallest document are removed.

Rows: null and empty texts have nothing to remove.  A null ``doc_id`` orders
before all others.  Rows that share a ``doc_id`` do not remove from each other; a row is
known by its id and a hash of its text, so each gets the ranges of its own text.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import _packed, buffers, materialise, mix64, ragged, slices, text_or_empty
from .suffix_array import permuted_prefixes, suffix_array

LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM + 1           # grams of a window
CHUNK_BITS = 9                      # chunks of about 2**9 bytes
FILTER_BITS, HOT_BITS, MIN_SHARD_BITS = 28, 22, 8
BLOCK_BITS, ANCHOR_BITS = 16, 40    # top bits of an anchor that name its block of the bitmap, and those counted
TRIES, OWNER_TRIES = 4, 3           # bits set for an anchor, for an owner
ROUND_ANCHORS = (1 << FILTER_BITS) // 6  # repeated anchors of a bitmap: one in 18 others passes at most
OWNER_MOST = 30                     # bits of the owners' bitmap at most (128 MB)
PART = 7                            # neighbouring windows of a hot anchor that are counted as one
HELD = 1 << 19                      # anchors that a task holds before it deals them out
SEEN = 1 << 20                      # hot windows that a task remembers
SHARD_TEXT = 256 << 20              # bytes of text whose anchors a worker holds at a time
HOT_COUNT = 2048                    # slices with an anchor, two at most counted in each
SHARD_BYTES = 4 << 20
SLICE = 1 << 20                     # bytes of text that a worker scans at a time: its arrays stay in cache
FIRST_ID = -(1 << 63)
_ODD = mix64(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


class Scan:
    """Grams, chunks and anchors of a slice of texts."""

    def __init__(self, texts: pa.Array, keys: np.ndarray):
        self.offs, self.raw = buffers(texts.cast(pa.string()))
        self.n, self.keys = len(self.raw), keys
        n = self.n
        padded = np.r_[self.raw, np.zeros(LENGTH + 16, np.uint8)]
        word = np.ndarray(n + LENGTH + 8, "<u8", padded, strides=(1,)) * _ODD[0]
        word ^= word >> np.uint64(32)
        g = word[:n + REACH] * _ODD[1]
        for k, at in enumerate(range(8, GRAM, 8)):
            g += word[at:at + n + REACH] * _ODD[2 + k]
        g ^= g >> np.uint64(31)
        g *= _ODD[0]
        self.gram = g
        # places from which a whole gram, and a whole window, stays in its text
        size = np.diff(self.offs)
        self.left = np.repeat(self.offs[1:].astype(np.int32), size) - np.arange(n, dtype=np.int32)
        self.row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.window = self.left >= LENGTH
        self.text = self.raw.tobytes()
        self.runs = None

    def run_end(self, at: np.ndarray) -> np.ndarray:
        """End of the run of equal bytes that holds each place."""
        if self.runs is None:
            self.runs = np.r_[np.flatnonzero(self.raw[1:] != self.raw[:-1]) + 1, self.n]
        return self.runs[np.searchsorted(self.runs, at, side="right")]

    def hashes(self, a, b):
        """128-bit hash of the bytes from each a to b, in two halves."""
        raw = self.text
        both = b"".join([xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(a.tolist(), b.tolist())])
        h = np.frombuffer(both, ">u8").astype(np.uint64).reshape(-1, 2)
        return h[:, 1].copy(), h[:, 0].copy()

    def chunks(self):
        """(start, windows, end of the bytes that its windows cover) of chunks with a window."""
        cut = (self.left >= GRAM) & (self.gram[:self.n] >> np.uint64(64 - CHUNK_BITS) == 0)
        cut[self.offs[:-1][np.diff(self.offs) > 0]] = True
        start = np.flatnonzero(cut)
        row = self.row[start]
        last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
        stop = np.r_[start[1:], self.n]
        stop[last] = self.offs[row[last] + 1]
        end = np.minimum(stop + LENGTH - 1, self.offs[row + 1])
        windows = np.minimum(stop, self.offs[row + 1] - LENGTH + 1) - start
        keep = windows > 0
        return start[keep], windows[keep], end[keep]

    def anchors(self):
        """Place of the anchor of each window start."""
        if self.n >= 1 << 32:
            raise ValueError("a text is too long for one slice")
        place = np.arange(self.n + REACH, dtype=np.uint64)
        m = (self.gram & np.uint64(0xFFFFFFFF00000000)) | place
        span = 1
        while span * 2 <= REACH:
            m = np.minimum(m[:len(m) - span], m[span:])
            span *= 2
        m = np.minimum(m[:len(m) - (REACH - span)], m[REACH - span:])[:self.n] if span < REACH else m[:self.n]
        return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def spread(self, place: np.ndarray) -> np.ndarray:
        """Anchors as evenly spread hashes: the least of many grams lie close to 0, where they would
        fill a small part of a bitmap and a few shards."""
        return mix64(self.gram[place])

    def parts(self, at: np.ndarray, place: np.ndarray):
        """For windows and the places of their anchors: what the anchor's windows are cut to by
        their distance from it, and a hash of the bytes that all windows of such a part hold."""
        q = (place - at) // PART
        low = place - PART * q
        return place * (REACH // PART + 1) + q, mix64(self.gram[low] + mix64(self.gram[low + LENGTH - PART + 1 - GRAM] + q.astype(np.uint64)))

    def first_windows(self, bits: np.ndarray) -> np.ndarray:
        """Windows of chunks whose first document (by the bitmap) this may be."""
        start, windows, end = self.chunks()
        h1, h2 = self.hashes(start, end)
        own = _owned(bits, _owner(h1, h2, self.keys[self.row[start]]))
        edge = np.zeros(self.n + 1, np.int32)
        np.add.at(edge, start[own], 1)
        np.add.at(edge, (start + windows)[own], -1)
        return np.cumsum(edge[:self.n]) > 0


def _owner(h1, h2, key):
    return mix64(h1 ^ mix64(h2 + key.view(np.uint64)))


def _bit(bits: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    b = h >> np.uint64(64 - width)
    return (bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1


def _owned(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    width = (len(bits) << 6).bit_length() - 1
    found = _bit(bits, h, width)
    for k in range(1, OWNER_TRIES):
        at = np.flatnonzero(found)
        found[at] = _bit(bits, _again(h[at], k), width)
    return found


def _again(h, k: int):
    return mix64(h + np.uint64(k)) if k else h


def _places(a: np.ndarray):
    """(round hash, bits of the bitmap) of anchors, by their top ``ANCHOR_BITS`` bits."""
    h, own = mix64(a), FILTER_BITS - BLOCK_BITS
    block = (a >> np.uint64(ANCHOR_BITS - BLOCK_BITS)) << np.uint64(own)
    return h >> np.uint64(52), [block | (h >> np.uint64(12 * k)) & np.uint64((1 << own) - 1) for k in range(TRIES)]


def _among(bits: np.ndarray, anchors: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Anchors of a round that may repeat."""
    turn, places = _places(anchors >> np.uint64(64 - ANCHOR_BITS))
    at = np.flatnonzero(turn % np.uint64(parts) == part)
    for b in places:
        at = at[_bit(bits, b[at] << np.uint64(64 - FILTER_BITS), FILTER_BITS)]
    found = np.zeros(len(anchors), bool)
    found[at] = True
    return found


def _keys(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _i64(x):
    return pa.array(x.view(np.int64))


def _chunk_rows(batches):
    for b in slices(batches, 1, SLICE):
        x = Scan(b.column(1), _keys(b.column(0)))
        start, _, end = x.chunks()
        h1, h2 = x.hashes(start, end)
        row = x.row[start]
        yield pa.RecordBatch.from_arrays([
            _i64(h1), _i64(h2), pa.array(x.keys[row]), b.column(2).take(pa.array(row)), pa.array((start - x.offs[row])),
            pa.array((end - x.offs[row]))], ["h1", "h2", "key", "mark", "start", "stop"])


def _coded(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences, byte by byte: their high bytes are mostly 0, which the
    shuffle's compression leaves out."""
    return np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _decoded(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _by_shard(values: np.ndarray, shard_bits: int) -> pa.RecordBatch:
    """64-bit values by their top bits, 32 further bits of each."""
    a = np.sort(values)
    cut = np.r_[np.searchsorted(a, np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits)), len(a)]
    rest = ((a >> np.uint64(32 - shard_bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([
        pa.array(full.astype(np.int32)), pa.array([_coded(rest[cut[k]:cut[k + 1]]) for k in full], pa.binary())],
        ["shard", "anchors"])


def _owner_rows(batches):
    """Owner hashes by shard."""
    for b in batches:
        h1, h2, key = (_keys(b.column(i)) for i in range(3))
        h = _owner(h1.view(np.uint64), h2.view(np.uint64), key)
        if len(h):
            yield _by_shard(np.concatenate([_again(h, k) for k in range(OWNER_TRIES)]), MIN_SHARD_BITS)


def _owner_map(batches, width: int):
    """Bitmap of a shard's owners."""
    own, now, flags = width - MIN_SHARD_BITS, None, None
    for b in batches:
        for shard, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if shard != now:
                if now is not None:
                    yield _packed(now, flags)
                now, flags = shard, np.zeros(1 << own, np.uint8)
            flags[_decoded(raw) >> np.uint32(32 - own)] = 1
    if now is not None:
        yield _packed(now, flags)


def _anchor_rows(shared, shard_bits: int = MIN_SHARD_BITS, hot=None):
    """Anchors by shard (their top bits), each at most twice for a slice, 32 further bits of
    each.  Slices are held until a shard gets some tens of anchors at once, or many.  With ``hot``, the
    parts of hot anchors instead."""
    def run(batches):
        bits = shared.value
        held, size = [], 0
        for b in slices(batches, 1, SLICE):
            x = Scan(b.column(1), _keys(b.column(0)))
            at = np.flatnonzero(x.first_windows(bits) & x.window)
            places = x.anchors()[at]
            if not len(places):
                continue
            if hot is None:
                anchors = x.spread(places[np.r_[True, places[1:] != places[:-1]]])
            else:
                often = _bit(hot.value, x.spread(places), HOT_BITS)
                if not often.any():
                    continue
                unit, anchors = x.parts(at[often], places[often])
                anchors = anchors[np.r_[True, unit[1:] != unit[:-1]]]
            a, count = np.unique(anchors, return_counts=True)
            held.append(np.repeat(a, np.minimum(count, 2)))
            size += len(held[-1])
            if size >= max(64 << shard_bits, HELD):
                yield _by_shard(np.concatenate(held), shard_bits)
                held, size = [], 0
        if held:
            yield _by_shard(np.concatenate(held), shard_bits)
    return run


def _shard_bits(n_bytes: int) -> int:
    """Shards follow the data: about ``SHARD_TEXT`` bytes of text for each, 2**8 to 2**16 shards."""
    return min(max(MIN_SHARD_BITS, (n_bytes // SHARD_TEXT).bit_length()), 16)


def _pack(positions: np.ndarray, width: int) -> bytes:
    flags = np.zeros(1 << width, np.uint8)
    flags[positions] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _counted(batches):
    """Anchors of a shard that occur more than once, and very often."""
    held: list[np.ndarray] = []
    now = None

    def flush():
        a, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([
            pa.array([now], pa.int32()), pa.array([a[count > 1].tobytes()], pa.binary()),
            pa.array([a[count >= HOT_COUNT].tobytes()], pa.binary())], ["shard", "many", "often"])

    for b in batches:
        for shard, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if held and shard != now:
                yield flush()
                held = []
            now = shard
            held.append(_decoded(raw))
    if held:
        yield flush()


def _bits(batches, shard_bits: int, part: int = 0, parts: int = 1):
    """Bitmap of a shard's anchors that occur more than once and belong to the round."""
    own = FILTER_BITS - shard_bits
    for b in batches:
        for shard, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            many = np.frombuffer(raw, "<u4").astype(np.uint64) | np.uint64(shard << 32)
            turn, places = _places(many >> np.uint64(32 + shard_bits - ANCHOR_BITS))
            mine = turn % np.uint64(parts) == part
            at = np.concatenate([p[mine] for p in places]) & np.uint64((1 << own) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_pack(at.astype(np.int64), own)], pa.binary())],
                                             ["shard", "bits"])


def _hot_bits(batches, shard_bits: int):
    """Bitmap of a shard's anchors that occur very often."""
    own = HOT_BITS - shard_bits
    for b in batches:
        for shard, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()),
                                              pa.array([_pack(np.frombuffer(raw, "<u4") >> np.uint32(32 - own), own)], pa.binary())], ["shard", "bits"])


def _repeated(batches, shard_bits: int = MIN_SHARD_BITS):
    """Bits of the anchors of a shard that occur more than once, and very often, in one round."""
    for b in _counted(batches):
        for many, often in zip(_bits([b], shard_bits), _hot_bits([b], shard_bits)):
            yield pa.RecordBatch.from_arrays([*many.columns, often.column(1)], ["shard", "bits", "hot"])


def _segments(first, shared, part: int = 0, parts: int = 1):
    """Runs of windows with one repeated anchor of the round; equal runs of later documents of
    the slice, and of the task if the anchor is hot, leave as spans (no bytes) that are joined
    where they touch."""
    def run(batches):
        owners, (repeated, hot, *finer) = first.value, shared.value
        seen, lows = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hot segments and their least keys
        for b in slices(batches, 1, SLICE):
            x = Scan(b.column(1), _keys(b.column(0)))
            at = np.flatnonzero(x.first_windows(owners) & x.window)
            if not len(at):
                continue
            place = x.anchors()[at]
            # one look-up per run of an anchor
            head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            a = x.spread(place[head])
            size = np.diff(np.r_[head, len(at)])
            often = _bit(hot, a, HOT_BITS)
            if finer and often.any():
                a, often = np.repeat(a, size), np.repeat(often, size)
                place = place * (REACH // PART + 1)
                place[often], a[often] = x.parts(at[often], place[often] // (REACH // PART + 1))
                head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                size = np.diff(np.r_[head, len(at)])
                a, often = a[head], often[head]
                often &= _bit(finer[0], a, HOT_BITS)
            keep = np.repeat(_among(repeated, a, part, parts), size)
            alone = np.repeat(often, size)[keep]
            at, place, code = at[keep], place[keep], np.repeat(a, size)[keep]
            if not len(at):
                continue
            # a window alone is a segment, but for those of one letter: they go as one run
            like = x.run_end(at[:-1]) - at[:-1] > LENGTH
            apart = (at[1:] != at[:-1] + 1) | np.where(alone[1:], ~(like & alone[:-1]), (place[1:] != place[:-1]) | alone[:-1])
            cut = np.flatnonzero(np.r_[True, apart])
            start = at[cut]
            stop = at[np.r_[cut[1:], len(at)] - 1] + LENGTH
            h1, _ = x.hashes(start, stop)
            window, many = h1.copy(), np.flatnonzero(alone[cut] & (stop - start > LENGTH))
            window[many], _ = x.hashes(start[many], start[many] + LENGTH)
            route = np.where(alone[cut], window, code[cut])
            row = x.row[start]
            key, base = x.keys[row], x.offs[row]
            order = np.lexsort((key, h1))
            new = np.r_[True, h1[order][1:] != h1[order][:-1]]
            lead = order[np.flatnonzero(new)]
            least, hashed, many = key[lead], h1[lead], alone[cut[lead]]
            if many.any():
                held = np.searchsorted(seen, hashed)
                known = np.zeros(len(lead), bool)
                if len(seen):
                    known = many & (seen[np.minimum(held, len(seen) - 1)] == hashed)
                least[known] = np.minimum(least[known], lows[held[known]])
                lows[held[known]] = least[known]
                fresh = many & ~known
                if len(seen) + int(fresh.sum()) > SEEN:
                    seen, lows, held, fresh = seen[:0], lows[:0], np.zeros(len(lead), np.int64), many
                seen, lows = np.insert(seen, held[fresh], hashed[fresh]), np.insert(lows, held[fresh], least[fresh])
            later = np.empty(len(start), bool)
            later[order] = key[order] > least[np.cumsum(new) - 1]
            route = np.where(later, mix64(key.view(np.uint64) + np.uint64(3)), route)
            one = np.flatnonzero(~np.r_[False, later[1:] & later[:-1] & (row[1:] == row[:-1]) & (start[1:] <= stop[:-1])])
            stop = stop[np.r_[one[1:], len(stop)] - 1]
            start, route, key, base, row, later = (v[one] for v in (start, route, key, base, row, later))
            raw = x.raw.tobytes()
            yield pa.RecordBatch.from_arrays([
                _i64(route), pa.array(key), b.column(2).take(pa.array(row)), pa.array(start - base), pa.array(stop - base),
                pa.array([None if z else raw[s:e] for z, s, e in zip(later.tolist(), start.tolist(), stop.tolist())], pa.binary())],
                ["route", "key", "mark", "start", "stop", "bytes"])
    return run


def shard_spans(route: np.ndarray, raws: pa.Array, key: np.ndarray):
    """As ``matched``, for the segments of many routes.  Equal segments are one: the
    copies of larger keys go whole, and a route whose segments are all equal has
    nothing left to sort."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, raws.to_pylist()), np.uint64, len(raws))
    order = np.lexsort((key, h, route))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (route[order][1:] != route[order][:-1])]
    lead = order[np.flatnonzero(new)]                       # least key of each distinct segment
    least = np.empty(len(key), np.int64)
    least[order] = key[lead][np.cumsum(new) - 1]
    copies = np.flatnonzero(key > least)
    sizes = np.diff(buffers(raws)[0])
    several = np.flatnonzero(route[lead][1:] == route[lead][:-1])
    apart = np.unique(np.r_[several, several + 1])          # distinct segments of routes with several
    # equal segments of one document share the result of the first
    heir = np.empty(len(key), np.int64)
    heir[order] = np.cumsum(new) - 1
    seg, first, end = matched(raws.take(pa.array(lead[apart])), key[lead[apart]])
    twins = order[~new & (key[order] == least[order])]
    out = [(copies, np.zeros(len(copies), np.int64), sizes[copies]), (lead[apart][seg], first, end)]
    if len(twins) and len(seg):
        of = apart[seg]
        lo, hi = np.searchsorted(of, heir[twins]), np.searchsorted(of, heir[twins], side="right")
        same = ragged(lo, hi - lo)
        out.append((np.repeat(twins, hi - lo), first[same], end[same]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def matched(raws: pa.Array, key: np.ndarray):
    """(segment, first place, end) of the runs of bytes in windows that also start in a
    segment of a smaller key."""
    if not len(raws):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offs, raw = buffers(raws)
    k = len(raws)
    size = np.diff(offs)
    seg = np.repeat(np.arange(k), size)
    at = np.arange(len(raw)) + seg
    n = len(raw) + k + 1
    text = np.ones(n, np.uint16)
    text[at] = raw.astype(np.uint16) + 2
    text[-1] = 0
    padded = np.full(n + LENGTH + 8, 0xFF, np.uint8)
    padded[at] = raw
    valid = np.zeros(n, bool)
    valid[at] = (offs[1:][seg] - np.arange(len(raw))) >= LENGTH
    of = np.zeros(n, np.int64)
    of[at] = seg
    sa = suffix_array(text, LENGTH)
    common = permuted_prefixes(padded, sa, LENGTH, valid)
    order = sa[valid[sa]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = common[order] < LENGTH
    new[0] = True
    owner = key[of[order]]
    low = np.minimum.reduceat(owner, np.flatnonzero(new))
    hit = np.sort(order[owner > low[np.cumsum(new) - 1]])
    cut = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1] + 1]) if len(hit) else np.zeros(0, np.int64)
    first = hit[cut]
    last = hit[np.r_[cut[1:], len(hit)] - 1] if len(hit) else first
    s = of[first]
    base = offs[:-1][s] + s
    return s, first - base, last - base + LENGTH


def _shards(batches):
    """Spans to remove, from segments in order of their route; a route is never split."""
    names = ["key", "mark", "start", "stop"]

    def work(t):
        key, mark, start = (t[c].to_numpy() for c in names[:3])
        raws = t["bytes"].combine_chunks()
        seg, first, end = shard_spans(t["route"].to_numpy(), raws.chunk(0) if isinstance(raws, pa.ChunkedArray) else raws, key)
        return pa.RecordBatch.from_arrays([pa.array(key[seg]), pa.array(mark[seg]), pa.array(start[seg] + first), pa.array(start[seg] + end)], names)

    held: list[pa.Table] = []
    size = 0
    for b in batches:
        t = pa.Table.from_batches([b])
        spans = t.filter(t["bytes"].is_null())
        if len(spans):
            yield from spans.select(names).combine_chunks().to_batches()
        t = t.filter(t["bytes"].is_valid())
        if not len(t):
            continue
        held.append(t)
        size += t["bytes"].nbytes
        if size >= SHARD_BYTES:
            whole = pa.concat_tables(held).combine_chunks()
            route = whole["route"].to_numpy()
            change = np.flatnonzero(route[1:] != route[:-1])
            if len(change):
                yield work(whole.slice(0, int(change[-1]) + 1).combine_chunks())
                whole = whole.slice(int(change[-1]) + 1)
            held, size = [whole], whole["bytes"].nbytes
    if held:
        yield work(pa.concat_tables(held).combine_chunks())


def _keyed(docs: DataFrame) -> DataFrame:
    """``key`` (id), ``text`` and ``mark``, a hash of the text: a row is known by both."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST_ID)).alias("key"), text_or_empty().alias("text"),
                       F.xxhash64(text_or_empty()).alias("mark"))


def _gathered(rows: DataFrame, width: int, shard_bits: int) -> np.ndarray:
    out = np.zeros((1 << shard_bits, 1 << width >> 6 + shard_bits), np.uint64)
    for shard, bits in rows.toLocalIterator():
        out[shard] |= np.frombuffer(bits, "<u8")
    return out.ravel()


def _filters(d: DataFrame, owners, shard_bits: int) -> list:
    """For each round, a broadcast of bitmaps: the anchors that occur more than once, those that
    occur very often and, if there are any, the parts of these that do.  Each is gathered from
    rows of shards and of fixed size."""
    sc = d.sparkSession.sparkContext

    def counted(hot=None):
        rows = d.mapInArrow(_anchor_rows(owners, shard_bits, hot), "shard int, anchors binary").repartition("shard").sortWithinPartitions("shard")
        return materialise(rows.mapInArrow(_counted, "shard int, many binary, often binary"), "anchors")

    def very(found):
        return _gathered(found.mapInArrow(partial(_hot_bits, shard_bits=shard_bits), "shard int, bits binary"), HOT_BITS, shard_bits)

    found = counted()
    often = [very(found)]
    if often[0].any():
        parts = counted(sc.broadcast(often[0]))
        often.append(very(parts))
        found = found.unionByName(parts)
    n = (found.agg(F.sum(F.octet_length("many"))).first()[0] or 0) // 4
    rounds = max(1, -(-n // ROUND_ANCHORS))
    return [sc.broadcast((_gathered(found.mapInArrow(partial(_bits, shard_bits=shard_bits, part=k, parts=rounds), "shard int, bits binary"),
                                    FILTER_BITS, shard_bits), *often)) for k in range(rounds)]


def _owner_bits(chunks: int) -> int:
    """Five bits of the owners' bitmap or more for each chunk, up to its largest size."""
    return min(max(FILTER_BITS, (5 * chunks).bit_length()), OWNER_MOST)


def spans(docs: DataFrame) -> DataFrame:
    """``key`` (``doc_id``), ``mark``, ``start``, ``stop``: byte ranges to remove (they may overlap)."""
    d, spark = _keyed(docs), docs.sparkSession
    chunks = materialise(d.mapInArrow(_chunk_rows, "h1 bigint, h2 bigint, key bigint, mark bigint, start bigint, stop bigint"), "chunks")
    low = materialise(chunks.groupBy("h1", "h2").agg(F.min("key").alias("low"), F.max("key").alias("high")), "first-chunks")
    width = _owner_bits(low.count())
    owners = low.select("h1", "h2", "low").mapInArrow(_owner_rows, "shard int, anchors binary")
    owners = owners.repartition("shard").sortWithinPartitions("shard").mapInArrow(partial(_owner_map, width=width), "shard int, bits binary")
    first = spark.sparkContext.broadcast(_gathered(owners, width, MIN_SHARD_BITS))
    copies = chunks.join(low.where("low < high"), ["h1", "h2"]).where("key > low").select("key", "mark", "start", "stop")
    n_bytes = chunks.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0
    shared = _filters(d, first, _shard_bits(n_bytes))
    segments = reduce(DataFrame.unionByName, [
        d.mapInArrow(_segments(first, bits, part, len(shared)), "route bigint, key bigint, mark bigint, start bigint, stop bigint, bytes binary")
        for part, bits in enumerate(shared)])
    found = segments.repartition("route").sortWithinPartitions("route").mapInArrow(_shards, "key bigint, mark bigint, start bigint, stop bigint")
    return copies.unionByName(found)


def _zipped(batches):
    """Texts as Zstandard frames and their sizes: whole texts are shuffled once."""
    codec = pa.Codec("zstd")
    for b in slices(batches, 1):
        offs, raw = buffers(b.column(1))
        whole = raw.tobytes()
        frames = [codec.compress(whole[s:e], asbytes=True) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(offs)), pa.array(frames, pa.binary())],
                                         ["key", "mark", "n", "frame"])


def _unzipped(batches, max_bytes: int = 8 << 20):
    """``doc_id, text, cuts`` from frames, in pieces of some MB of text."""
    codec = pa.Codec("zstd")
    for b in batches:
        size = b.column(1).to_numpy()
        ends = np.r_[0, np.cumsum(size)]
        start = 0
        while start < b.num_rows:
            stop = max(int(np.searchsorted(ends, ends[start] + max_bytes, side="right")) - 1, start + 1)
            part = b.slice(start, stop - start)
            texts = [codec.decompress(z, n, asbytes=True) if n else b"" for z, n in zip(part.column(2).to_pylist(), size[start:stop].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()), part.column(3)], ["doc_id", "text", "cuts"])
            start = stop


def _remove(batches):
    for b in slices(batches, 1):
        offs, raw = buffers(b.column(1))
        whole = raw.tobytes()
        lists = b.column(2)
        n, removed, runs, kept, digest = [], [], [], [], []
        for i, cut in enumerate(lists.to_pylist()):
            text = np.frombuffer(whole[offs[i]:offs[i + 1]], np.uint8)
            edge = np.zeros(len(text) + 1, np.int64)
            if cut:
                np.add.at(edge, [c["start"] for c in cut], 1)
                np.add.at(edge, [c["stop"] for c in cut], -1)
            gone = np.cumsum(edge[:-1]) > 0
            left = text[~gone].tobytes()
            n.append(len(text))
            removed.append(int(gone.sum()))
            runs.append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0)
            kept.append(left)
            digest.append(hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                                          pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes,
    which may start or end within a code point) of every document."""
    cuts = spans(docs).groupBy("key", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    rows = _keyed(docs).mapInArrow(_zipped, "key bigint, mark bigint, n bigint, frame binary")
    rows = rows.withColumn("doc_id", F.when(F.col("key") != FIRST_ID, F.col("key")))
    return rows.join(cuts, ["key", "mark"], "left").select("doc_id", "n", "frame", "cuts").mapInArrow(
        lambda batches: _remove(_unzipped(batches)),
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
