"""Benchmark decontamination: template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose
parameters were changed still has the template of the original:

* number: a word of digits (points and commas inside allowed), one that
  starts with a digit, or a word of ``NUMBERS``;
* unit: a word of ``UNITS`` after a number;
* name: a capitalised word that does not start a sentence; one that does may be a
  name, so its windows are hashed in both forms.

Runs of ``SIZE`` consecutive words are hashed as written, and, if they hold
placeholders, after canonicalisation; they are joined by hash with those of the
benchmark.  A run with fewer than ``MIN_PLAIN`` words that are not placeholders says
little: it is lengthened to the right until it holds so many, at the end of an item
to the left.  (An item that has fewer in all is only compared as written.)  Items
shorter than a window are one window of their own length, as written; they are
reported by ``matches`` and never remove a document (``keep``).  Each joined
pair of windows binds the item's slots to the document's words: a number or unit by its
place in the item, a name by its value.  Bindings are consistent if none has two values.

A document may hold several copies with different parameters.  Joined windows are
therefore taken together over the whole document, and for each range of alignments
(document place minus item place) of half the item's length, in steps of a quarter, so
words put in or left out do not part a copy.  In each of these groups an item's window
is bound where the alignment has most windows.  A document is contaminated if one group
holds at least ``min_share`` of an item's windows under consistent bindings, with or
without the windows that only join when a word that opens a sentence is a name, or if
the windows equal as written, wherever they are, reach that share.

A bitmap of fixed size over the benchmark's hashes drops windows that cannot
join before the shuffle; it has no false negatives and is only a filter.

Rows: null and empty texts (of documents or items) have no windows and never
match.  Repeated rows of an id count as one document or item; a null ``doc_id``
or ``item_id`` takes no part and such documents are kept.  Empty tables give no
matches.  Other columns are ignored by ``matches`` and kept by ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bitmap, fresh, mix64, slices, text_or_empty
from .words import _powers, same_doc, window_hash, words

SIZE, MIN_PLAIN, MIN_SHARE = 5, 3, 0.8
BITMAP_BITS = 24
# Units of measure and money that may follow a number.
UNITS = ("mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz gram grams pound pounds "
         "ton tons ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours "
         "day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur mph kmh "
         "degree degrees watt watts volt volts joule joules newton newtons hz").split()
# Numbers in words.
NUMBERS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
           "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
           "billion dozen half twice").split()
_NUMBER, _UNIT, _NAME = (np.uint64(k) for k in (0x11, 0x22, 0x33))
_LEFT = np.uint64(0x44)
# forms of a window: as written, by template, by template with names that open sentences
WRITTEN, TYPED, OPENED = 0, 1, 2
# kinds of a word: plain, number or unit, name, possible name
PLAIN, VALUE, NAME, MAYBE = 0, 1, 2, 3
WINDOWS = "id bigint, size int, place int, length int, key bigint, form int, words array<bigint>, kinds array<tinyint>"


def _is_one_of(w, listed: list[str]) -> np.ndarray:
    known = np.sort(words(pa.array([" ".join(listed)])).hash)
    return known[np.searchsorted(known, w.hash).clip(max=len(known) - 1)] == w.hash


def _kinds(w) -> tuple[np.ndarray, np.ndarray]:
    """(kind, hash with placeholders but for possible names) of each word."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int8), w.hash
    lead = w.raw[w.start]
    number = (lead >= 48) & (lead <= 57) | _is_one_of(w, NUMBERS)
    same = np.r_[False, w.doc[1:] == w.doc[:-1]]
    unit = _is_one_of(w, UNITS) & same & np.r_[False, number[:-1]] & ~number
    # a sentence starts after a mark or a line feed, or with the text
    marks = np.r_[0, np.cumsum(np.isin(w.raw, np.frombuffer(b".!?:\n", np.uint8)))]
    opens = ~same | (marks[w.start] > marks[np.r_[0, w.end[:-1]]])
    capital = (w.raw[w.start] != w.low[w.start]) | (w.raw[(w.start + 1).clip(max=len(w.raw) - 1)]
                                                  != w.low[(w.start + 1).clip(max=len(w.raw) - 1)]) & (lead >= 0xC0)
    name = capital & ~number & ~unit
    out = w.hash.copy()
    out[number], out[unit], out[name & ~opens] = _NUMBER, _UNIT, _NAME
    return np.select([number | unit, name & ~opens, name], [VALUE, NAME, MAYBE], PLAIN).astype(np.int8), out


def _typed(w, bounds, run, canon, slot, at_least, whole, longest):
    """(run, key, length) of the windows by template: the run, lengthened until it holds
    ``MIN_PLAIN`` plain words.  Those without any of the slots ``at_least`` are left out."""
    up, down = _powers(len(canon) + 1)
    total = np.r_[np.uint64(0), np.cumsum(canon * up[:len(canon)])]
    plain = np.r_[0, np.cumsum(~slot)]
    asked = np.r_[0, np.cumsum(at_least)]
    low, high = bounds[w.doc[run]], bounds[w.doc[run] + 1]
    end = np.maximum(run + SIZE, np.searchsorted(plain, plain[run] + MIN_PLAIN))
    start = np.minimum(run, np.searchsorted(plain, plain[run + SIZE] - MIN_PLAIN, side="right") - 1)
    right = end <= high
    left = (end > run + SIZE) & (start >= low)
    if whole:  # the document has both, as it does not know where an item ends
        left &= ~right
    for which, s, e in ((right, run, end), (left, start, run + SIZE)):
        at = np.flatnonzero(which)
        at = at[(asked[e[at]] > asked[s[at]]) & (e[at] - s[at] <= longest)]
        key = mix64((total[e[at]] - total[s[at]]) * down[s[at]])
        yield run[at], mix64(key ^ _LEFT) if which is left else key, e[at] - s[at]


def _windows(texts: pa.Array, sizes: list[int], whole: bool, bitmap: np.ndarray | None, longest: int):
    """(row, size, word place of the run, length, key, form, its words, their kinds) of the
    windows.  ``whole``: rows shorter than a window are one window of their own length."""
    w = words(texts)
    kind, canon = _kinds(w)
    opened = np.where(kind == MAYBE, _NAME, canon)
    bounds = w.bounds(len(texts))
    length = np.diff(bounds)
    for size in sizes:
        inside = same_doc(w.doc, size)
        if whole:
            inside = inside & ((length[w.doc[:len(inside)]] >= SIZE) if size == SIZE
                               else (length[w.doc[:len(inside)]] == size))
        run = np.flatnonzero(inside)
        if not len(run):
            continue
        found = [(WRITTEN, run, window_hash(w.hash, size)[run] + np.uint64(size), np.full(len(run), size))]
        if size == SIZE:
            found += [(TYPED, *x) for x in _typed(w, bounds, run, canon, (kind == VALUE) | (kind == NAME),
                                                  (kind == VALUE) | (kind == NAME), whole, longest)]
            found += [(OPENED, *x) for x in _typed(w, bounds, run, opened, kind != PLAIN, kind == MAYBE, whole, longest)]
        for form, at, key, n in found:
            if bitmap is not None:
                bit = key >> np.uint64(40)
                hit = (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                at, key, n = at[hit], key[hit], n[hit]
            if len(at):
                doc, inner = w.doc[at], (at[:, None] + np.arange(size)).ravel()
                yield doc, size, at - bounds[doc], n, key.view(np.int64), form, w.hash[inner].view(np.int64), kind[inner]


def _window_rows(sizes: list[int], whole: bool, shared=None, longest: int = 1 << 30):
    def run(batches):
        bitmap = shared.value if shared is not None else None
        for b in slices(batches, 1, 1 << 20):
            for doc, size, place, n, key, form, inner, kinds in _windows(b.column(1), sizes, whole, bitmap, longest):
                offs = pa.array(np.arange(len(doc) + 1, dtype=np.int32) * np.int32(size))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(doc)), pa.array(np.full(len(doc), size, np.int32)),
                    pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key),
                    pa.array(np.full(len(doc), form, np.int32)),
                    pa.ListArray.from_arrays(offs, pa.array(inner)), pa.ListArray.from_arrays(offs, pa.array(kinds))],
                    ["id", "size", "place", "length", "key", "form", "words", "kinds"])
    return run


def _rows(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), text_or_empty().alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE, shortest: int = 1) -> DataFrame:
    """One row per document and item that it holds: ``doc_id, item_id, n_windows`` (of
    the item), ``n_joined`` (by template), ``n_exact`` (as written), ``consistent``,
    ``share``.  Items of fewer than ``shortest`` words take no part."""
    spark = docs.sparkSession
    items = _rows(benchmark, "item_id").mapInArrow(_window_rows([*range(shortest, SIZE + 1)], True), WINDOWS).dropDuplicates(
        ["id", "size", "place", "key"])
    lengths = items.groupBy("size").agg(F.max("length").alias("longest")).collect()  # at most SIZE rows
    sizes = sorted(r.size for r in lengths)
    shared = spark.sparkContext.broadcast(bitmap(items, BITMAP_BITS, "key"))
    found = _rows(docs, "doc_id").mapInArrow(
        _window_rows(sizes, False, shared, max((r.longest for r in lengths), default=0)), WINDOWS)
    found = found.select(F.col("id").alias("doc_id"), "key", F.col("place").alias("doc_place"), F.col("form").alias("doc_form"),
                         F.col("words").alias("doc_words")).distinct()
    item = items.select(F.col("id").alias("item_id"), "key", "place", "form", F.col("words").alias("item_words"), "kinds")
    n_windows = item.groupBy("item_id").agg(F.countDistinct("place").alias("n_windows"))
    pairs = F.arrays_zip(F.col("item_words").alias("i"), F.col("doc_words").alias("v"), F.col("kinds").alias("k"),
                         F.sequence(F.col("place"), F.col("place") + F.size("kinds") - 1).alias("p"))
    slots = F.filter(pairs, lambda p: p["k"] != PLAIN)
    # a number or unit is bound by its place, a name by its value
    bound = F.transform(slots, lambda p: F.struct(
        p["k"].alias("k"), F.when(p["k"] == VALUE, p["p"]).otherwise(-1).alias("p"),
        F.when(p["k"] != VALUE, p["i"]).alias("i"), p["v"].alias("v")))
    align = F.col("doc_place") - F.col("place")
    joined = (found.join(item, "key").join(n_windows, "item_id")
              .groupBy("doc_id", "item_id", "n_windows", "place", align.alias("align"))
              .agg(F.min(F.struct(F.greatest("form", "doc_form").alias("form"), bound.alias("pairs"))).alias("b")))
    votes = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "item_id", "align"))
    step = F.floor((F.col("align") * 4) / F.col("n_windows"))
    grouped = joined.withColumn("votes", votes).withColumn("part", F.explode(F.array(F.lit(None).cast("bigint"), step, step - 1)))
    per_window = grouped.groupBy("doc_id", "item_id", "n_windows", "part", "place").agg(
        F.min(F.struct((-F.col("votes")).alias("v"), "b.form", "align", "b.pairs")).alias("b"),
        F.min("b.form").alias("least"))
    per_window = per_window.select("doc_id", "item_id", "n_windows", "part", "least", "b.form", "b.pairs")
    sure = F.col("form") != OPENED
    per_part = per_window.groupBy("doc_id", "item_id", "n_windows", "part").agg(
        F.count(F.lit(1)).alias("n_all"), F.count(F.when(sure, 1)).alias("n_sure"),
        F.count(F.when(F.col("least") == WRITTEN, 1)).alias("n_exact"),
        # an item's slots are bounded by its own length
        F.flatten(F.collect_set("pairs")).alias("all_pairs"),
        F.flatten(F.collect_set(F.when(sure, F.filter("pairs", lambda p: p["k"] != MAYBE)))).alias("sure_pairs"))
    n_bound = F.when(_function("all_pairs"), F.col("n_all")).when(_function("sure_pairs"), F.col("n_sure"))
    whole = F.col("part").isNull()
    per_item = per_part.withColumn("n_bound", n_bound).groupBy("doc_id", "item_id", "n_windows").agg(
        F.max("n_bound").alias("n_bound"), F.max(F.when(whole, F.col("n_all"))).alias("n_all"),
        F.max("n_exact").alias("n_exact"))  # the whole document has most
    # fewer windows than those equal as written prove nothing about the others
    consistent = F.coalesce(F.col("n_bound") >= F.col("n_exact"), F.lit(False))
    return (per_item.withColumn("consistent", consistent)
            .withColumn("n_joined", F.when(F.col("consistent"), F.col("n_bound")).otherwise(F.col("n_all")))
            .withColumn("share", F.when(F.col("consistent"), F.col("n_joined")).otherwise(F.col("n_exact")) / F.col("n_windows"))
            .where(F.col("share") >= min_share)
            .select("doc_id", "item_id", "n_windows", "n_joined", "n_exact", "consistent", "share"))


def _function(pairs: str):
    """Whether no slot (place ``p`` or value ``i`` of the item) has two values ``v``."""
    slot = F.array_distinct(F.transform(pairs, lambda p: F.struct(p["p"], p["i"])))
    return F.size(slot) == F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["p"], p["i"], p["v"]))))


def keep(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents that hold no item of at least one full window, with all their
    columns: that a text holds the few words of a shorter item says nothing."""
    name = fresh(docs, "_hit")
    hit = matches(docs, benchmark, min_share, SIZE).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, F.col("doc_id").cast("bigint") == F.col(name), "left_anti")
