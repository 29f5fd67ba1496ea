"""Encoding whole texts with a public tokenizer, one word memo per worker.

The tokenizer folds case, drops white space and never joins across it, nor
from a letter to a punctuation mark.  So the ids of a text are those of its
pieces one after another, cut at white space and before such a mark.  Pieces
repeat: a worker encodes each distinct one once (with the ``tokenizers``
library) and copies its ids afterwards; ``tests/llm`` holds this against
``Tokenizer.encode`` on whole texts.  Texts that may hold special tokens are
encoded directly.  The memo is bounded by ``MEMO_WORDS``.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import buffers, ragged, slices

TOKENIZER = "word_bpe_49k.json"
MEMO_WORDS = 800_000
# A sign with an id of its own; it stands between words that are encoded together.
MARK = "\u2665"
_BETWEEN = f" {MARK} "
_JOINED = 512

_ENCODERS: dict[tuple[str, bool], "WordEncoder"] = {}


def tokenizer_path(name: str) -> str:
    """A path as given, or the installed file of that name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return str(public_tokenizers.path(name))


def encoder(name: str = TOKENIZER, offsets: bool = False, memo_words: int = MEMO_WORDS) -> "WordEncoder":
    """The worker's encoder (kept between the tasks of one Python worker)."""
    if (name, offsets) not in _ENCODERS:
        _ENCODERS[name, offsets] = WordEncoder(name, offsets)
    _ENCODERS[name, offsets].memo_words = memo_words
    return _ENCODERS[name, offsets]


class _Ids:
    """Ids of many words in few arrays."""

    def __init__(self):
        self.ids, self.n, self.spans = [], [], []

    def add(self, ids: np.ndarray, n: np.ndarray, spans: np.ndarray | None):
        self.ids.append(ids)
        self.n.append(n)
        if spans is not None:
            self.spans.append(spans)

    def arrays(self):
        if len(self.n) > 1:
            self.ids, self.n = [np.concatenate(self.ids)], [np.concatenate(self.n)]
            self.spans = [np.concatenate(self.spans)] if self.spans else []
        if not self.n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        return self.ids[0], self.n[0].astype(np.int64), self.spans[0] if self.spans else None

    def split(self):
        ids, n, spans = self.arrays()
        ends = np.cumsum(n)
        for e, k in zip(ends.tolist(), n.tolist()):
            yield ids[e - k:e], np.array([k]), spans[e - k:e] if spans is not None else None


class WordEncoder:
    def __init__(self, name: str, offsets: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.offsets = offsets
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError(f"the tokenizer must have one id for {MARK!r}")
        self.mark = mark[0]
        self.memo_words = MEMO_WORDS
        self.slot: dict[str, int] = {}
        self.uses = np.zeros(0, np.int32)
        self.memo = _Ids()

    def _learn(self, words: list[str]) -> "_Ids":
        """Ids (and spans) of words, in their order; words are encoded in joined
        texts with a mark between two of them."""
        out = _Ids()
        odd = [w for w in words if MARK in w]
        plain = [w for w in words if MARK not in w] if odd else words
        groups = [plain[i:i + _JOINED] for i in range(0, len(plain), _JOINED)]
        run = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        done = _Ids()
        for group, enc in zip(groups, run([_BETWEEN.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(enc.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(group) - 1:
                raise ValueError("the tokenizer joins words across white space")
            lo, hi = np.r_[0, cuts + 1], np.r_[cuts, len(ids)]
            keep = np.ones(len(ids), bool)
            keep[cuts] = False
            spans = None
            if self.offsets:
                sizes = np.fromiter(map(len, group), np.int64, len(group)) + len(_BETWEEN)
                spans = (np.asarray(enc.offsets, np.int64).reshape(-1, 2)[keep]
                         - np.repeat(np.cumsum(sizes) - sizes, hi - lo)[:, None])
            done.add(ids[keep], hi - lo, spans)
        if not odd:
            return done
        each = done.split()
        for w in words:  # words that hold a mark are encoded alone
            if MARK not in w:
                out.add(*next(each))
            else:
                enc = self.tokenizer.encode(w, add_special_tokens=False)
                out.add(np.asarray(enc.ids, np.uint32), np.array([len(enc.ids)]),
                        np.asarray(enc.offsets, np.int64).reshape(-1, 2) if self.offsets else None)
        return out

    def _lookup(self, words: pa.Array):
        """Distinct words of an array: (index of each word, number of ids, first place, ids, spans)."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        slots = np.fromiter((self.slot.get(w, -1) for w in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(slots < 0)
        fresh = self._learn([distinct[i] for i in missing])
        f_ids, f_n, f_spans = fresh.arrays()
        m_ids, m_n, m_spans = self.memo.arrays()
        m_head, f_head = np.cumsum(m_n) - m_n, np.cumsum(f_n) - f_n
        n = np.empty(len(distinct), np.int64)
        known = slots >= 0
        n[known], n[missing] = m_n[slots[known]], f_n
        head = np.cumsum(n) - n
        ids = np.empty(int(n.sum()), np.uint32)
        spans = np.empty((len(ids), 2), np.int64) if self.offsets else None
        for at, begin, size, src, src_spans in ((head[known], m_head[slots[known]], n[known], m_ids, m_spans),
                                                (head[missing], f_head, f_n, f_ids, f_spans)):
            to, frm = ragged(at, size), ragged(begin, size)
            ids[to] = src[frm]
            if self.offsets:
                spans[to] = src_spans[frm]
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.uses[slots[known]] += 1
        self._remember(distinct, missing, fresh)
        return index, n, head, ids, spans

    def _remember(self, distinct, missing, fresh):
        """Keep new words.  A full memo first drops its less used half."""
        if len(self.slot) + len(missing) > self.memo_words:
            self._shrink(self.memo_words // 2)
        take = missing[:max(0, self.memo_words - len(self.slot))]
        base, (ids, n, spans) = len(self.slot), fresh.arrays()
        end = int(n[:len(take)].sum())
        self.slot.update(zip((distinct[i] for i in take.tolist()), range(base, base + len(take))))
        self.memo.add(ids[:end], n[:len(take)], spans[:end] if spans is not None else None)
        self.uses = np.concatenate([self.uses, np.zeros(len(take), np.int32)])

    def _shrink(self, size: int):
        """Keep the ``size`` words that most slices used."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[:size])
        number = np.full(len(self.uses), -1, np.int64)
        number[kept] = np.arange(len(kept))
        ids, n, spans = self.memo.arrays()
        at = ragged((np.cumsum(n) - n)[kept], n[kept])
        new = number.tolist()
        self.slot = {w: new[i] for w, i in self.slot.items() if new[i] >= 0}
        self.memo = _Ids()
        self.memo.add(ids[at], n[kept], spans[at] if spans is not None else None)
        self.uses = self.uses[kept] // 2

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        ids, _, n = self._encode(texts)
        return ids, n

    def encode_with_offsets(self, texts: pa.Array):
        """(ids, char start, char end, number of ids of each text); offsets count
        code points from the start of each text."""
        ids, spans, n = self._encode(texts)
        return ids, spans[:, 0], spans[:, 1], n

    def _encode(self, texts: pa.Array):
        texts = texts.cast(pa.string())
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(special)
        plain = pc.if_else(pa.array(special), "", texts) if len(rows) else texts
        pieces, heads, starts = _all_pieces(plain, self.offsets)
        index, n, head, ids, spans = self._lookup(pieces)
        place = ragged(head[index], n[index])
        ids = ids[place]
        if self.offsets:
            spans = spans[place] + np.repeat(starts, n[index])[:, None]
        total = np.r_[0, np.cumsum(n[index])]
        counts = total[heads[1:]] - total[heads[:-1]]
        for i in rows[::-1]:  # texts that may hold special tokens: directly
            enc = self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False)
            at = int(counts[:i].sum())
            ids = np.insert(ids, at, np.asarray(enc.ids, np.uint32))
            if self.offsets:
                spans = np.insert(spans, at, np.asarray(enc.offsets, np.int64).reshape(-1, 2), axis=0)
            counts[i] = len(enc.ids)
        return ids, spans, counts


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ',.!?;:)]}"']] = True


def _all_pieces(texts: pa.Array, offsets: bool):
    """As ``_pieces``, cut 1 MB at a time (arrays that stay in cache)."""
    rows = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = [_pieces(b.column(0), offsets) for b in slices([rows], 0, 1 << 20)]
    if len(parts) < 2:
        return parts[0] if parts else _pieces(texts, offsets)
    first = np.cumsum([0, *(len(p[0]) for p in parts)])
    heads = np.concatenate([[0], *(p[1][1:] + f for p, f in zip(parts, first))])
    return pa.concat_arrays([p[0] for p in parts]), heads, np.concatenate([p[2] for p in parts]) if offsets else None


def _pieces(texts: pa.Array, offsets: bool):
    """(pieces with ASCII letters in lower case, first piece of each text and one
    more, code point of its text at which each piece starts)."""
    offs, raw = buffers(pc.ascii_lower(texts))
    n = len(raw)
    if not n:
        return pa.array([], pa.string()), np.zeros(len(offs), np.int64), np.zeros(0, np.int64)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    before = np.r_[np.uint8(32), raw[:-1]]
    lead = np.r_[np.uint8(32), np.uint8(32), raw[:-2]]
    letter = _LETTER[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
    first = np.zeros(n, bool)
    first[offs[:-1][offs[:-1] < n]] = True
    starts = np.flatnonzero(solid & (np.r_[True, ~solid[:-1]] | first | (_MARKS[raw] & letter)))
    kept = np.r_[0, np.cumsum(solid, dtype=np.int32)]
    bounds = np.r_[kept[starts], kept[-1]].astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw[solid].tobytes())])
    at = None
    if offsets:
        chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)]
        at = chars[starts] - chars[offs[np.searchsorted(offs, starts, side="right") - 1]]
    return pieces, np.searchsorted(starts, offs), at
