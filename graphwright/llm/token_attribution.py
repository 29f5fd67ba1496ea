"""Token counts by section: offset-mapped attribution.

Every document is read whole; its pieces (cut where the tokenizer never joins) are
encoded with character offsets, each distinct piece once in a worker.  The token
spans are joined to the section spans of the document (interval join on code
points), and a token that crosses a boundary goes to one section by a rule:

* ``start``: the section that holds its first character;
* ``end``: the section that holds its last character;
* ``largest``: the section with the largest overlap, the earlier one on a tie.

Sections are the lines of the text (the line feed belongs to none), or an
``array<struct<start, end>>`` column of code point spans, which
``with_sections`` builds from a table of sections.  They may leave gaps, but
not overlap.  Tokens in no section count in a row with ``section`` -1, given
only when there are such tokens.

Rows: null text counts as empty, and an empty text has one empty line with 0
tokens.  A null array means no sections.  Repeated documents give repeated
rows; a null ``doc_id`` is kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buffers, slices, text_or_empty
from .tokenizing import TOKENIZER, encoder

RULES = ("start", "end", "largest")
OUT = "doc_id bigint, section int, start bigint, end bigint, n_tokens bigint"
SPANS = "array<struct<start:bigint,end:bigint>>"


def with_sections(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """``docs`` with the array column ``sections`` from rows (doc_id, start, end)."""
    spans = sections.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("start").cast("bigint"), F.col("end").cast("bigint")))).alias("sections"))
    return docs.drop("sections").join(spans, "doc_id", "left")


def _lines(texts: pa.Array):
    """(document, start, end) of every line, in order."""
    offs, raw = buffers(texts)
    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    feeds = np.flatnonzero(raw == 10)
    doc = np.searchsorted(offs, feeds, side="right") - 1
    first, last = chars[offs[:-1]], chars[offs[1:]]
    at = chars[feeds]
    n = np.arange(len(offs) - 1)
    docs = np.r_[n, doc]
    order = np.lexsort((np.r_[np.full(len(n), -1), at], docs))
    docs = docs[order]
    start = np.r_[first, at + 1][order]
    end = np.r_[start[1:] - 1, 0]
    closes = np.r_[docs[1:] != docs[:-1], True] if len(docs) else np.zeros(0, bool)
    end[closes] = last[docs[closes]]
    return docs, start - first[docs], end - first[docs]


def _given(column: pa.Array):
    lists = column.fill_null([]) if column.null_count else column
    flat = lists.flatten()
    offs = lists.offsets.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), np.diff(offs))
    start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    order = np.lexsort((start, doc))
    return doc[order], start[order], end[order]


def assign(token_s, token_e, start, end, rule: str) -> np.ndarray:
    """Section of each token (-1: none).  All positions lie on one axis and
    sections are sorted and disjoint."""
    out = np.full(len(token_s), -1, np.int64)
    if not len(start):
        return out
    if rule == "largest":
        lo = np.searchsorted(end, token_s, side="right")
        hi = np.searchsorted(start, token_e, side="left") - 1
        one = lo == hi
        out[one] = lo[one]
        for t in np.flatnonzero(hi > lo):
            k = np.arange(lo[t], hi[t] + 1)
            out[t] = k[np.argmax(np.minimum(end[k], token_e[t]) - np.maximum(start[k], token_s[t]))]
        return out
    at = token_s if rule == "start" else token_e - 1
    k = np.searchsorted(start, at, side="right") - 1
    inside = (k >= 0) & (at < end[k.clip(0)])
    out[inside] = k[inside]
    return out


def _attribute(tokenizer: str, rule: str, given: bool):
    def run(batches):
        enc = encoder(tokenizer, offsets=True)
        for b in slices(batches, 1):
            texts = b.column(1)
            ids, s, e, n = enc.encode_with_offsets(texts)
            doc, start, end = _given(b.column(2)) if given else _lines(texts)
            # one axis: every document gets room for its code points and its sections
            reach = np.zeros(len(n), np.int64)
            np.maximum.at(reach, doc, end)
            of = np.repeat(np.arange(len(n)), n)
            e = np.maximum(e, s + 1)
            np.maximum.at(reach, of, e)
            base = np.cumsum(reach + 1) - reach - 1
            section = assign(s + base[of], e + base[of], start + base[doc], end + base[doc], rule)
            counts = np.bincount(section[section >= 0], minlength=len(start))
            heads = np.searchsorted(doc, np.arange(len(n)))
            number = np.arange(len(doc)) - heads[doc]
            loose = np.bincount(of[section < 0], minlength=len(n))
            rest = np.flatnonzero(loose)
            rows = pa.array(np.r_[doc, rest])
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(rows),
                pa.array(np.r_[number, np.full(len(rest), -1)].astype(np.int32)),
                pa.array(np.r_[start, np.full(len(rest), -1)]),
                pa.array(np.r_[end, np.full(len(rest), -1)]),
                pa.array(np.r_[counts, loose[rest]].astype(np.int64))],
                ["doc_id", "section", "start", "end", "n_tokens"])
    return run


def attribute(docs: DataFrame, rule: str = "start", sections: str | None = None,
              tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, section, start, end, n_tokens`` for each section of each document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    cols = [F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")]
    if sections:
        cols.append(F.col(sections).cast(SPANS).alias("sections"))
    return docs.select(*cols).mapInArrow(_attribute(tokenizer, rule, bool(sections)), OUT)
