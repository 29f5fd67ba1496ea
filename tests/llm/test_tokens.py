"""Token counts by section and token blocks, against the tokenizer itself."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from graphwright.llm import token_attribution as ta, token_blocks as tb
from graphwright.llm.tokenizing import TOKENIZER, WordEncoder, tokenizer_path
from graphwright.session import scratch_path

ENC, SPANS = WordEncoder(TOKENIZER, False), WordEncoder(TOKENIZER, True)
TEXT = st.text(st.one_of(st.sampled_from(" \n\t.,!?'’<|>aZéÀßİΣ♥0½中́  ×÷"), st.characters(codec="utf-8")), max_size=60)


def direct(text):
    return ENC.tokenizer.encode(text, add_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_encoder_equals_tokenizer(texts):
    texts = texts + ["don't they'll <|startoftext|>x", "a ♥ b", "été, (où)!", ""]
    want = [direct(t) for t in texts]
    ids, n = ENC.encode(pa.array(texts, pa.string()))
    assert n.tolist() == [len(w.ids) for w in want] and ids.tolist() == [i for w in want for i in w.ids]
    ids, s, e, n = SPANS.encode_with_offsets(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for w in want for i in w.ids]
    assert list(zip(s.tolist(), e.tolist())) == [o for w in want for o in w.offsets]


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_assign_by_rule(data):
    cuts = sorted(data.draw(st.sets(st.integers(0, 40), min_size=2, max_size=8)))
    spans = list(zip(cuts[::2], cuts[1::2]))
    tokens = [(a, a + data.draw(st.integers(1, 12))) for a in data.draw(st.lists(st.integers(0, 40), max_size=10))]
    a = [np.array(x, np.int64) for x in (*zip(*tokens), *zip(*spans))] if tokens else None
    if a is None:
        return
    inside = lambda p: next((k for k, (x, y) in enumerate(spans) if x <= p < y), -1)
    over = [[min(y, e) - max(x, s) for x, y in spans] for s, e in tokens]
    assert ta.assign(*a, "start").tolist() == [inside(s) for s, _ in tokens]
    assert ta.assign(*a, "end").tolist() == [inside(e - 1) for _, e in tokens]
    assert ta.assign(*a, "largest").tolist() == [o.index(max(o)) if max(o) > 0 else -1 for o in over]


def test_attribution_of_odd_rows(spark, odd, none):
    rows = ta.attribute(odd).collect()
    assert ta.attribute(none).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.section, r.start, r.end, r.n_tokens) for r in by[3]] == [(0, 0, 0, 0)] and len(by[6]) == 2
    assert sorted((r.section, r.start, r.end) for r in by[9]) == [(0, 0, 0), (1, 1, 1), (2, 2, 4), (3, 5, 5)]
    for r in odd.select("doc_id", "text").collect():
        if r.doc_id not in (6,) and r.text and r.doc_id:
            assert sum(x.n_tokens for x in by[r.doc_id]) == len(direct(r.text).ids)


def test_attribution_to_given_sections(spark):
    docs = spark.createDataFrame([(1, "unbelievable things happen"), (2, "no sections")], "doc_id bigint, text string")
    cut = spark.createDataFrame([(1, 0, 4), (1, 4, 15)], "doc_id bigint, start bigint, end bigint")
    parts = ta.with_sections(docs, cut)
    got = {rule: {(r.doc_id, r.section): r.n_tokens for r in ta.attribute(parts, rule, "sections").collect()} for rule in ta.RULES}
    spans = direct("unbelievable things happen").offsets
    assert got["start"][1, 0] == sum(s < 4 for s, _ in spans) and got["end"][1, 0] == sum(e <= 4 for _, e in spans)
    for g in got.values():
        assert g[1, 0] + g[1, 1] + g.get((1, -1), 0) == len(spans) and g[2, -1] == 2
    with pytest.raises(ValueError):
        ta.attribute(docs, "middle")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 300), st.integers(0, 1 << 30))
def test_block_round_trip(n, kinds, seed):
    rng = np.random.default_rng(seed)
    ids = (rng.zipf(1.3, n) % kinds).astype(np.uint32)
    at, count = np.unique(ids, return_counts=True)
    table = tb.Table(at, tb.scale_counts(at, count))
    assert table.freq.sum() == 1 << tb.SCALE_BITS and table.freq.min() >= 1
    cut = sorted(rng.integers(0, n + 1, 3).tolist())
    sizes = np.diff([0, *cut, n])
    payload = tb.encode_block(ids, np.arange(len(sizes)), sizes, 7, table)
    block = tb.Block(payload)
    assert block.start == 7 and block.sizes.tolist() == sizes.tolist() and (tb.decode_block(block, table) == ids).all()
    broken = bytearray(payload)
    broken[rng.integers(0, len(payload))] ^= 1
    with pytest.raises(ValueError):
        tb.Block(bytes(broken))


def test_segments_decode_alone():
    ids = np.random.default_rng(0).integers(0, 50_000, 600_000).astype(np.uint32)
    at, count = np.unique(ids, return_counts=True)
    table = tb.Table(at, tb.scale_counts(at, count))
    block = tb.Block(tb.encode_block(ids, np.array([1]), np.array([len(ids)]), 0, table))
    step = tb.CHECK_STEPS * block.lanes
    assert len(block.at) == -(-len(ids) // step) > 1
    for k in reversed(range(len(block.at))):
        assert (tb.decode_segment(block, k, table) == ids[k * step:(k + 1) * step]).all()
    with pytest.raises(ValueError):
        tb.decode_segment(block, 0, tb.Table(at, tb.scale_counts(at, count[::-1])))


def test_scale_keeps_rare_ids():
    count = np.r_[10 ** 12, np.ones(1000, np.int64)]
    freq = tb.scale_counts(np.arange(1001), count, 12)
    assert freq.sum() == 4096 and freq.min() == 1


def test_files_hold_every_row_in_order(spark, odd, none):
    path = scratch_path(spark, "blocks")
    tb.write_blocks(odd, path, block_tokens=50)
    rows = sorted(tb.read_blocks(spark, path).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    start = 0
    assert [r.doc_id for r in rows] == [w[0] for w in want]
    for r, (_, text) in zip(rows, want):
        ids = direct(text).ids + [tb.END_ID]
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(ids), struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    short = {r.start: r.ids_crc32 for r in tb.read_summary(spark, path).collect()}
    assert short == {r.start: zlib.crc32(bytes(r.ids)) for r in rows}
    path = scratch_path(spark, "blocks")
    tb.write_blocks(none, path)
    assert tb.read_summary(spark, path).count() == 0


def test_tokenizer_is_a_path():
    assert tokenizer_path("/x/y.json") == "/x/y.json" and tokenizer_path(TOKENIZER).endswith(TOKENIZER)
