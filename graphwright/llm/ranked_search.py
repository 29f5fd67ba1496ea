"""Ranked lexical search by buckets of impact vectors of similar length.

A document's impact on a term is ``w * ((10**9 * tf) div (1000 * tf + 8 * m))``, where
``w`` grows with the term's rarity and ``m`` with the document's length; its score for
an item is the sum of its impacts on the item's terms, that is the product of its impact
vector with the item's 0/1 vector.  The ten highest for each item are found as a largest
inner product:

1. one pass over whole texts counts the terms that items hold (all terms for the
   document's length); the counts give the corpus statistics, all as integers but for the
   logarithm of ``w``;
2. impact vectors are ordered by their Euclidean length (range partitions, sorted
   files) and read in ``ROUNDS`` of falling length, in buckets of ``BUCKET`` vectors;
3. an item's threshold is its tenth best score so far.  By Cauchy and Schwarz no vector
   scores more than its length times ``sqrt(terms)``: this ends the search before the
   shortest buckets (a filter on the length that reaches the scan), skips buckets for an item
   and cuts off the shorter part of others;
4. inside a bucket the item's rarest terms are taken first.  A vector's score is at most
   the impacts seen plus ``sqrt(terms left)`` times the length that is left of the
   vector (coordinate bound); vectors below the threshold go;
5. what is left is scored exactly in 64-bit integers.

Bounds are doubles with a margin above their rounding, so they never drop a vector that
reaches the threshold, and equal scores are ordered by ``doc_id``.

Items are broadcast in blocks of about ``BLOCK_BYTES`` of text (one block unless the
table of items is large); each block is run against all documents.

Rows: null and empty texts have no term.  Each row of documents is a document of its
own; one without ``doc_id`` ranks last among equal scores.  Rows of one ``item_id`` are
one item with the terms of all of them, rows without id too; an item without terms, or whose terms no
document holds, has no rows.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import buffers, materialise, mix64, ragged, slices
from .words import _BYTES, _powers

BEST = 10
BLOCK_BYTES = 4 << 20
BUCKET, BUCKET_TERMS = 4096, 1 << 21
# shares of the vectors, from the longest, that the rounds end at
ROUNDS = (1 / 64, 1 / 8, 1.0)
FOCUS = (4, 12)
MARGIN = 1 + 1e-9
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(65, 91)}
VECTORS = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"
IMPACTS = "doc_id bigint, length double, terms array<int>, impacts array<bigint>"
FOUND = "item int, item_id bigint, doc_id bigint, score bigint"

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def terms_of(text: str | None) -> list[str]:
    return [t.translate(LOWER) for t in re.findall(TERM, text or "")]


# -- counting terms -------------------------------------------------------------

@dataclass
class Vocabulary:
    """Terms by hash, with their bytes, so that a match is a match of bytes."""
    ids: np.ndarray      # in the order of hashes
    hash: np.ndarray
    start: np.ndarray
    size: np.ndarray
    raw: np.ndarray

    @classmethod
    def of(cls, terms: list[str]) -> Vocabulary:
        offsets, raw = buffers(pa.array(terms, pa.string()))
        h = _hashes(raw, offsets[:-1], offsets[1:])
        order = np.argsort(h, kind="stable")
        return cls(order.astype(np.int32), h[order], offsets[:-1][order], np.diff(offsets)[order], raw)

    def find(self, raw, start, end, h) -> tuple[np.ndarray, np.ndarray]:
        """(which words, their term) of the words that are terms."""
        words, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        at = np.searchsorted(self.hash, h)
        todo = np.arange(len(h))
        while len(todo):  # one round unless terms share a hash
            todo = todo[(at[todo] < len(self.hash))]
            todo = todo[self.hash[at[todo]] == h[todo]]
            k = at[todo]
            same = (end - start)[todo] == self.size[k]
            w, k = todo[same], k[same]
            differ = raw[ragged(start[w], self.size[k])] != self.raw[ragged(self.start[k], self.size[k])]
            wrong = np.r_[0, np.cumsum(differ)]
            ends = np.cumsum(self.size[k])
            good = wrong[ends] == wrong[ends - self.size[k]]
            words.append(w[good])
            terms.append(self.ids[k[good]])
            todo = np.setdiff1d(todo, w[good], assume_unique=True)
            at[todo] += 1
        return np.concatenate(words), np.concatenate(terms)


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[:len(raw)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start])


def _runs(texts: pa.Array):
    """(row, start, end) of every term and the texts' bytes, A to Z lower-cased."""
    offsets, raw = buffers(texts.cast(pa.string()))
    low = _LOW[raw]
    inside = np.r_[False, _INSIDE[low], False]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return np.searchsorted(offsets, start, side="right") - 1, start, end, low


def _lists(n_rows: int, row: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)), values)


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``VECTORS`` of the documents that have a term: ``n`` of all, counts of ``terms``."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.of(terms))
    size = max(len(terms), 1)

    def count(batches):
        for b in slices(batches, 1, 4 << 20):
            doc, start, end, low = _runs(b.column(1))
            word, term = shared.value.find(low, start, end, _hashes(low, start, end))
            key, n = np.unique(doc[word] * size + term, return_counts=True)
            rows = b.num_rows
            lists = [_lists(rows, key // size, pa.array(x)) for x in ((key % size).astype(np.int32), n.astype(np.int64))]
            total = np.bincount(doc, minlength=rows)
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(total.astype(np.int64)), *lists], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(total > 0))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, VECTORS)


# -- impacts ----------------------------------------------------------------------

def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(rows: DataFrame, weight: np.ndarray, n_docs: int, all_terms: int) -> DataFrame:
    """``IMPACTS`` of the vectors that have any, ordered by falling length."""
    shared = rows.sparkSession.sparkContext.broadcast(weight)

    def score(batches):
        for b in batches:
            n, sizes = b.column(1).to_numpy(), np.diff(b.column(2).offsets.to_numpy())
            term, tf = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            if 90 * int(n.max(initial=0)) * n_docs >= 1 << 63:
                n = n.astype(object)
            m = (10 + 90 * n * n_docs // all_terms).astype(np.int64)
            value = shared.value[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes)))
            row = np.repeat(np.arange(b.num_rows), sizes)
            length = np.sqrt(np.bincount(row, value.astype(float) ** 2, minlength=b.num_rows))
            some = value > 0
            lists = [_lists(b.num_rows, row[some], pa.array(x[some])) for x in (term, value)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(length), *lists], ["doc_id", "length", "terms", "impacts"])
            yield out.filter(pa.array(length > 0))

    # equal vectors (copies) spread over the range by their place in the table
    return (rows.mapInArrow(score, IMPACTS).withColumn("place", F.monotonically_increasing_id())
            .repartitionByRange(F.desc("length"), "place").sortWithinPartitions(F.desc("length")).drop("place"))


# -- search -----------------------------------------------------------------------

class Item:
    __slots__ = ("terms", "members", "root", "floor", "scores", "ids")

    def __init__(self, terms: np.ndarray, threshold: int):
        self.terms, self.members = terms, np.sort(terms)  # by falling weight; by number
        self.root = np.sqrt(len(terms))
        self.floor = threshold
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, best: int) -> None:
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        order = np.lexsort((ids, -scores))[:best]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == best:
            self.floor = max(self.floor, int(self.scores[-1]))


class Bucket:
    """Vectors of similar length, the longest first, with the postings of each term."""

    def __init__(self, batch: pa.RecordBatch):
        ids, length = batch.column(0), batch.column(1).to_numpy()
        order = np.argsort(-length, kind="stable")
        starts = batch.column(2).offsets.to_numpy()
        starts, sizes = (starts[:-1] - starts[0])[order], np.diff(starts)[order]
        at = ragged(starts, sizes)
        self.length = length[order]
        # a missing id is the largest one inside the task
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()[order]
        self.none = ids.is_null().to_numpy(zero_copy_only=False)[order]
        self.term = batch.column(2).flatten().to_numpy()[at]
        self.value = batch.column(3).flatten().to_numpy()[at]
        self.bounds = np.r_[0, np.cumsum(sizes)]
        by = np.argsort(self.term, kind="stable")
        self.post_doc = np.repeat(np.arange(len(order)), sizes)[by]
        self.post_value = self.value[by]
        self.known, self.first = np.unique(self.term[by], return_index=True)
        self.first = np.r_[self.first, len(by)]

    def postings(self, term: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.known, term)
        if k == len(self.known) or self.known[k] != term:
            return self.post_doc[:0], self.post_value[:0]
        low, high = self.first[k], self.first[k + 1]
        high = low + np.searchsorted(self.post_doc[low:high], n)
        return self.post_doc[low:high], self.post_value[low:high]

    def search(self, item: Item, best: int) -> None:
        # vectors are sorted by length, so those that may reach the threshold come first
        n = int(np.searchsorted(-self.length * item.root * MARGIN, -item.floor, side="right")) if item.floor else len(self.length)
        if not n:
            return
        seen, square = np.zeros(n), np.zeros(n)
        left = np.arange(n)
        done = 0
        for upto in FOCUS:
            for term in item.terms[done:upto].tolist():
                doc, value = self.postings(term, n)
                seen[doc] += value
                square[doc] += value.astype(float) ** 2
            done = min(upto, len(item.terms))
            rest = np.sqrt(np.maximum(self.length[left] ** 2 * MARGIN - square[left], 0) * (len(item.terms) - done))
            bound = (seen[left] + rest) * MARGIN
            left = left[(bound >= item.floor) & (bound > 0)]
            if not len(left):
                return
            if done == len(item.terms):
                break
        sizes = self.bounds[left + 1] - self.bounds[left]
        at = ragged(self.bounds[left], sizes)
        k = np.searchsorted(item.members, self.term[at]).clip(max=len(item.members) - 1)
        value = np.where(item.members[k] == self.term[at], self.value[at], 0)
        total = np.r_[0, np.cumsum(value)]
        ends = np.cumsum(sizes)
        score = total[ends] - total[ends - sizes]
        good = (score >= max(item.floor, 1))
        if good.any():
            item.add(score[good], self.ids[left[good]], best)


def _buckets(batches):
    """Batches joined or cut to buckets."""
    held, rows, terms = [], 0, 0
    for b in batches:
        start = 0
        while start < b.num_rows:
            ends = b.column(2).offsets.to_numpy()[start:]
            more = min(BUCKET - rows, int(np.searchsorted(ends - ends[0], BUCKET_TERMS - terms, side="right")) - 1)
            more = min(max(more, 0 if held else 1), b.num_rows - start)
            if more:
                held.append(b.slice(start, more))
                rows, terms, start = rows + more, terms + int(ends[more] - ends[0]), start + more
            if start < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, terms = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def best_of(part: DataFrame, shared, floors: list[int], best: int) -> DataFrame:
    """``FOUND``: the best of each task for each item, those that reach the item's floor."""
    def search(batches):
        ids, lists = shared.value
        items = [Item(t, f) for t, f in zip(lists, floors)]
        lost = {}  # nulls among the ids, by their place in the results
        for b in _buckets(batches):
            bucket = Bucket(b)
            if bucket.none.any():
                lost["null"] = True
            for item in items:
                bucket.search(item, best)
        kept = [(i, s, d) for i, item in enumerate(items) for s, d in zip(item.scores.tolist(), item.ids.tolist())]
        top = np.iinfo(np.int64).max
        columns = [pa.array([i for i, _, _ in kept], pa.int32()), pa.array([ids[i] for i, _, _ in kept], pa.int64()),
                   pa.array([None if d == top and lost else d for _, _, d in kept], pa.int64()), pa.array([s for _, s, _ in kept], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    return part.mapInArrow(search, FOUND)


def _ranked(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _search_block(docs: DataFrame, rows: list, best: int) -> DataFrame | None:
    held: dict = {}
    for r in rows:
        held.setdefault(r.item_id, set()).update(terms_of(r.text))
    held = {i: t for i, t in held.items() if t}
    terms = sorted(set().union(*held.values())) if held else []
    if not terms:
        return None
    counted = materialise(vectors(docs, terms), "term-vectors")
    n_docs, all_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(terms), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r[0]] = r[1]
    weight = weights(df, n_docs)
    ordered = materialise(impacts(counted, weight, n_docs, all_terms), "impacts")

    place = {t: k for k, t in enumerate(terms)}
    ids = sorted(held, key=lambda i: (i is None, i or 0))
    lists = []
    for i in ids:
        of = np.array(sorted(place[t] for t in held[i]), np.int64)
        lists.append(of[np.argsort(-weight[of], kind="stable")])
    shared = docs.sparkSession.sparkContext.broadcast((ids, lists))
    roots = np.sqrt([len(x) for x in lists])
    floors = np.zeros(len(ids), np.int64)
    cuts = ordered.agg(F.percentile_approx("length", [1 - s for s in ROUNDS[:-1]], 10_000)).first()[0]
    if cuts is None:
        return None
    found, high = [], None
    for low in [*cuts, 0.0]:
        if high is not None and low >= high:
            continue  # many vectors of one length: all of them were in the round before
        # no vector below this length reaches the threshold of any item
        least = max(low, float((floors / roots).min()) / MARGIN)
        if high is not None and least >= high:
            break
        part = ordered.where(F.col("length") >= least)
        if high is not None:
            part = part.where(F.col("length") < high)
        found.append(materialise(best_of(part, shared, floors.tolist(), best), "best"))
        for r in _ranked(reduce(DataFrame.unionByName, found), best).where(F.col("rank") == best).collect():
            floors[r["item"]] = r["score"]
        high = low
    return _ranked(reduce(DataFrame.unionByName, found), best).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``best`` documents with a score above 0,
    equal scores by ascending ``doc_id``.  ``docs``: ``doc_id, text``; ``items``: ``item_id,
    text``."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-n_bytes // block_bytes) or 1
    out = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        part = _search_block(docs, rows, best)
        if part is not None:
            out.append(part)
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, out)


# The same without pruning.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
n AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM d WHERE len(ts) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
u AS (SELECT r, unnest(ts) AS term FROM n),
t AS (SELECT r, term, count(*) AS tf FROM u SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, big_n),
p AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l)))) AS v
      FROM t JOIN w USING (term) JOIN n USING (r), c),
s AS (SELECT item_id, r, CAST(sum(v) AS BIGINT) AS score FROM i JOIN p USING (term) GROUP BY ALL HAVING sum(v) > 0),
o AS (SELECT item_id, doc_id, score,
             CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
      FROM s JOIN n USING (r))
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
