"""Line deduplication: deletion-neighbourhood join.

Lines (split at line feeds, compared without white space at their ends) match
if they are equal or, from ``min_chars`` code points on, one edit apart
(substitution, insertion or deletion of a code point).  The earliest of the
matching lines stays, by ``doc_id`` and then line number: a line goes if an
equal line or a line within the bound occurs earlier, whether that one stays
or not.

1. Equal lines meet by a 128-bit hash; the first place of each is kept.
2. Two lines within one edit share all but one of four quarters (as cut by the
   shorter one).  Lines that share so much with no other line are done.
3. The others emit every variant with one code point of such a quarter deleted
   as a hashed key.
   Equal variants deleted at the same place are substitutions; a variant that
   equals a whole line is an insertion.  Per key only the earliest member
   matters, so a key's group leaves one pair for each member.
4. Those pairs are verified by their edit distance.

Blank lines are kept and neither match nor count.  Rows: null and empty texts
have no lines.  A null ``doc_id`` orders before all others.  Equal rows of an
id (or of none) are treated as one document; rows of an id with different texts are
documents of their own, ordered by a hash of their text.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bitmap, buffers, materialise, mix64, slices, text_or_empty
from .words import _BYTES, _powers

MIN_CHARS = 10
BITMAP_BITS = 24
SLICE = 1 << 20
FIRST_ID = -(1 << 63)
KEY = "struct<id:bigint,text_hash:bigint>"
_OTHER = mix64(_BYTES + np.uint64(77))


class Lines:
    """Lines of a text column: row, number, bytes from ``start`` to ``end`` (trimmed)."""

    def __init__(self, texts: pa.Array):
        offs, raw = buffers(texts.cast(pa.string()))
        n = len(raw)
        feeds = np.flatnonzero(raw == 10)
        start = np.sort(np.r_[offs[:-1], feeds + 1])
        # a text that starts where another ends keeps its own line: rows are found by their own starts
        row = np.sort(np.r_[np.arange(len(offs) - 1), np.searchsorted(offs, feeds, side="right") - 1])
        end = np.r_[start[1:] - 1, n]
        last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
        end[last] = offs[row[last] + 1]
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        solid = np.flatnonzero(~blank)
        lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
        full = hi > lo
        first = np.searchsorted(row, row)  # first line of the row
        self.raw, self.row, self.number, self.full = raw, row, np.arange(len(row)) - first, full
        self.start = np.where(full, solid[lo.clip(max=max(len(solid) - 1, 0))] if len(solid) else 0, 0)
        self.end = np.where(full, (solid[(hi - 1).clip(min=0)] if len(solid) else 0) + 1, 0)
        up, self.down = _powers(n + 1)
        self.up = up
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[:n], out=self.total[1:])
        self.chars = np.flatnonzero((raw & 0xC0) != 0x80)  # bytes that start a code point
        self.places = np.r_[self.chars, n]

    def segment(self, a, b, total=None):
        """Unmixed hash of bytes a to b, the same wherever they stand."""
        t = self.total if total is None else total
        return (t[b] - t[a]) * self.down[a]

    def key(self, at):
        return mix64(self.segment(self.start[at], self.end[at]))

    def keys(self, at):
        """Two independent 64-bit hashes of each line."""
        n = len(self.raw)
        second = np.zeros(n + 1, np.uint64)
        np.cumsum(_OTHER[self.raw] * self.up[:n], out=second[1:])
        return self.key(at), mix64(self.segment(self.start[at], self.end[at], second))

    def length(self, at):
        first = np.searchsorted(self.chars, self.start[at])
        return first, np.searchsorted(self.chars, self.end[at]) - first

    def place(self, i):
        """Byte of code point number ``i`` of the column."""
        return self.places[i]


def _i64(x):
    return pa.array(x.view(np.int64))


def _occurrences(batches):
    """First place of each line within a slice."""
    for b in slices(batches, 1, SLICE):
        x = Lines(b.column(1))
        at = np.flatnonzero(x.full)
        k1, k2 = x.keys(at)
        yield pa.RecordBatch.from_arrays([_i64(k1), _i64(k2), b.column(0).take(pa.array(x.row[at])),
                                          pa.array(x.number[at].astype(np.int32))], ["k1", "k2", "key", "line"])


def _cuts(m: np.ndarray, k: int) -> np.ndarray:
    """Start of quarter ``k`` of a line of ``m`` code points."""
    return m * k // 4


def _outer_keys(min_chars: int, shared=None):
    """(outer, line, k): hash of a line without quarter ``k``, as cut for its own length
    (lowest bit of ``line`` 0) and for a line that is one code point shorter (1); with a
    bitmap only those whose hash is in it."""
    def run(batches):
        bits = shared.value if shared is not None else None
        for b in slices(batches, 1, SLICE):
            x = Lines(b.column(1))
            at = np.flatnonzero(x.full)
            k1 = x.key(at)
            _, unique = np.unique(k1, return_index=True)
            at, k1 = at[unique], k1[unique] & ~np.uint64(1)
            first, n = x.length(at)
            outer, lines, quarters = [], [], []
            for role in (0, 1):
                ok = n - role >= min_chars
                f, nn, m, own = first[ok], n[ok], (n - role)[ok], k1[ok] | np.uint64(role)
                s, e = x.start[at][ok], x.end[at][ok]
                for k in range(4):
                    head = mix64(x.segment(s, x.place(f + _cuts(m, k))))
                    tail = mix64(x.segment(x.place(f + nn - (m - _cuts(m, k + 1))), e))
                    h = mix64(head ^ mix64(tail + m.astype(np.uint64) * np.uint64(4) + np.uint64(k)))
                    hit = np.ones(len(h), bool) if bits is None else _in(bits, h)
                    outer.append(h[hit])
                    lines.append(own[hit])
                    quarters.append(np.full(len(outer[-1]), k, np.int8))
            yield pa.RecordBatch.from_arrays([_i64(np.concatenate(outer)), _i64(np.concatenate(lines)),
                                              pa.array(np.concatenate(quarters))], ["outer", "line", "k"])
    return run


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit in a bitmap of ``BITMAP_BITS``."""
    bit = h >> np.uint64(64 - BITMAP_BITS)
    return (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _candidates(docs: DataFrame, min_chars: int) -> DataFrame:
    """``k1`` (without its lowest bit) and ``flags``: bit k: shares all but quarter k with
    a line of equal length; bit 4 + k: with a shorter one; bit 8: with a longer one.

    Lines that differ in one quarter alone may be a third of all: their key leaves partial
    minima, and their rows meet it in a join, whose partitions can be split.  Keys of one
    line, nearly all, do not go to that join but for bits of the filter that they share."""
    spark, schema = docs.sparkSession, "outer bigint, line bigint, k tinyint"
    role = F.col("line").bitwiseAND(F.lit(1))
    own = F.when(role == 0, F.col("line"))
    groups = (docs.mapInArrow(_outer_keys(min_chars), schema).groupBy("outer")
              .agg(F.min(own).alias("low"), F.max(own).alias("high"), F.max(role).alias("probed"))
              .where("low IS NOT NULL AND (low <> high OR probed = 1)"))
    groups = materialise(groups, "outer-keys")
    shared = spark.sparkContext.broadcast(bitmap(groups, BITMAP_BITS, "outer"))
    flag = F.expr("(CASE WHEN line & 1 = 1 THEN shiftleft(16, k) ELSE 0 END)"
                  " | (CASE WHEN line & 1 = 0 AND low <> high THEN shiftleft(1, k) ELSE 0 END)"
                  " | (CASE WHEN line & 1 = 0 AND probed = 1 THEN 256 ELSE 0 END)")
    rows = docs.mapInArrow(_outer_keys(min_chars, shared), schema).join(groups, "outer")
    rows = rows.select(F.expr("line & ~1L").alias("k1"), flag.alias("flag")).where("flag <> 0")
    return rows.groupBy("k1").agg(F.bit_or("flag").alias("flags"))


def _texts_of(shared):
    """Text of the lines whose key is in the bitmap, once for each slice."""
    def run(batches):
        bits = shared.value
        for b in slices(batches, 1, SLICE):
            x = Lines(b.column(1))
            at = np.flatnonzero(x.full)
            k1, k2 = x.keys(at)
            hit = _in(bits, k1)
            at, k1, k2 = at[hit], k1[hit], k2[hit]
            _, unique = np.unique(k1, return_index=True)
            k1 &= ~np.uint64(1)
            raw = x.raw.tobytes()
            yield pa.RecordBatch.from_arrays([
                _i64(k1[unique]), _i64(k2[unique]),
                pa.array([raw[s:e].decode("utf-8", "replace") for s, e in zip(x.start[at[unique]].tolist(), x.end[at[unique]].tolist())],
                         pa.string())], ["k1", "k2", "line_text"])
    return run


def _variants(batches):
    """(variant, first, k1, whole, indel): the variants of a line with a code point of a
    flagged quarter deleted, and the line itself."""
    for b in slices(batches, 1, SLICE // 8):
        x = Lines(b.column(1))
        at = np.flatnonzero(x.full)
        rows = pa.array(x.row[at])
        rank = b.column(0).take(rows)
        flags = b.column(2).take(rows).to_numpy(zero_copy_only=False).astype(np.int64)
        k1 = x.key(at)
        first, n = x.length(at)
        line = np.repeat(np.arange(len(at)), n)
        i = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        sub, longer = np.zeros(len(line), bool), np.zeros(len(line), bool)
        for k in range(4):
            sub |= ((flags >> k) & 1 == 1)[line] & (i >= _cuts(n, k)[line]) & (i < _cuts(n, k + 1)[line])
            longer |= ((flags >> (4 + k)) & 1 == 1)[line] & (i >= _cuts(n - 1, k)[line]) & (i <= _cuts(n - 1, k + 1)[line])
        keep = np.flatnonzero(sub | longer)
        line, i, sub, longer = line[keep], i[keep], sub[keep], longer[keep]
        s, e = x.start[at][line], x.end[at][line]
        lo, hi = x.place(first[line] + i), np.minimum(x.place((first[line] + i + 1).clip(max=len(x.chars))), e)
        v = mix64(x.segment(s, lo) + x.segment(hi, e) * x.up[lo - s])
        a, c, w = np.flatnonzero(sub), np.flatnonzero(longer), np.flatnonzero(flags & 256)
        keys = np.r_[mix64(v[a] ^ mix64(i[a].astype(np.uint64) + np.uint64(9))), v[c], k1[w]]
        of = np.r_[line[a], line[c], w]
        yield pa.RecordBatch.from_arrays([
            _i64(keys), rank.take(pa.array(of)), _i64(k1[of]),
            pa.array(np.r_[np.zeros(len(a) + len(c), bool), np.ones(len(w), bool)]),
            pa.array(np.r_[np.zeros(len(a), bool), np.ones(len(c) + len(w), bool)])],
            ["variant", "first", "k1", "whole", "indel"])


def near_lines(docs: DataFrame, firsts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Keys of the lines that have an earlier line within one edit."""
    spark = docs.sparkSession
    wanted = materialise(_candidates(docs, min_chars), "candidates")
    shared = spark.sparkContext.broadcast(bitmap(wanted, BITMAP_BITS, "k1"))
    texts = docs.mapInArrow(_texts_of(shared), "k1 bigint, k2 bigint, line_text string").dropDuplicates(["k1", "k2"])
    even = firsts.select(F.expr("k1 & ~1L").alias("k1"), "k2", "first")
    lines = materialise(texts.join(wanted, "k1").join(even, ["k1", "k2"]).select("first", "line_text", "flags"), "lines")
    place = f"struct<key:{KEY},line:int>"
    rows = lines.mapInArrow(
        _variants, f"variant bigint, first {place}, k1 bigint, whole boolean, indel boolean")
    by = Window.partitionBy("variant", "indel")
    earliest = F.min(F.struct("first", "k1")).over(by)
    # of an insertion key one side is the whole line, the other its variants
    other = F.when(~F.col("indel"), earliest).when(
        F.col("whole"), F.min(F.when(~F.col("whole"), F.struct("first", "k1"))).over(by)).otherwise(
        F.min(F.when(F.col("whole"), F.struct("first", "k1"))).over(by))
    pairs = (rows.withColumn("other", other).where("other.first < first")
             .select("first", F.col("other.first").alias("earlier")).distinct())
    text = lines.select("first", "line_text")
    checked = (pairs.join(text, "first").join(text.select(F.col("first").alias("earlier"), F.col("line_text").alias("earlier_text")), "earlier")
               .where((F.levenshtein("line_text", "earlier_text", 1) >= 0) & (F.levenshtein("line_text", "earlier_text", 1) <= 1)))
    return checked.select("first").distinct()


def _key() -> Column:
    return F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST_ID)).alias("id"),
                    F.xxhash64(text_or_empty()).alias("text_hash")).alias("key")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key(), text_or_empty().alias("text"))


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``key`` (``doc_id`` and hash of the text) and ``kept``, the numbers of its lines that stay (without blank ones)."""
    d = _keyed(docs)
    firsts = materialise(d.mapInArrow(_occurrences, f"k1 bigint, k2 bigint, key {KEY}, line int").groupBy("k1", "k2")
                         .agg(F.min(F.struct("key", "line")).alias("first")), "firsts")
    gone = near_lines(d, firsts, min_chars)
    stay = firsts.join(gone, "first", "left_anti")
    return stay.groupBy(F.col("first.key").alias("key")).agg(F.collect_list("first.line").alias("kept"))


def _rebuild(batches):
    for b in slices(batches, 1):
        texts, kept = b.column(1).to_pylist(), b.column(2).to_pylist()
        total, removed, out = [], [], []
        for text, keep in zip(texts, kept):
            lines, keep = text.split("\n"), set(keep or ())
            blank = [not x.strip(" \t\n\v\f\r") for x in lines]
            left = [x for i, x in enumerate(lines) if blank[i] or i in keep]
            total.append(len(lines) - sum(blank))
            removed.append(len(lines) - len(left))
            out.append("\n".join(left))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(out, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_text"])


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_text`` of every document.  ``min_chars``: code points
    from which a line may match one that is not equal (1: every line)."""
    kept = kept_lines(docs, min_chars)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), _key())
    return (rows.join(kept, "key", "left").select("doc_id", "text", "kept")
            .mapInArrow(_rebuild, "doc_id bigint, n_lines bigint, n_removed bigint, kept_text string"))
