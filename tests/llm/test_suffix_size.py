"""Operator 8 with full filters and hot anchors: what it moves, and that results are whole."""
import random

import numpy as np
import pyarrow as pa

from graphwright.llm import suffix_dedup as sd

from test_near import brute_suffix, repeated_corpus

CUTS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


class Shared:
    def __init__(self, value):
        self.value = value


EVERY = Shared(np.full(1 << sd.FILTER_BITS >> 6, (1 << 64) - 1, np.uint64))  # all documents are first: no chunk is left out


def batches(rows):
    return [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t]), pa.array([7])], ["key", "text", "mark"]) for k, t in rows]


def letters(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))


def gathered(rows, width):
    out = np.zeros((256, 1 << width >> 14), np.uint64)
    for b in rows:
        out[b.column(0)[0].as_py()] |= np.frombuffer(b.column(1)[0].as_py(), "<u8")
    return out.ravel()


def segments(rows, parts=1):
    """The segments of all rounds, by the steps of the operator in one process."""
    def counted(hot=None):
        found = list(sd._anchor_rows(EVERY, hot=hot)(batches(rows)))
        return list(sd._counted(pa.Table.from_batches(found).sort_by("shard").to_batches())) if found else []

    found = counted()
    hot = gathered(sd._hot_bits(found, 8), sd.HOT_BITS)
    finer = counted(Shared(hot))
    very = gathered(sd._hot_bits(finer, 8), sd.HOT_BITS)
    out = []
    for k in range(parts):
        bits = gathered(sd._bits(found + finer, 8, k, parts), sd.FILTER_BITS)
        out += sd._segments(EVERY, Shared((bits, hot, very)), k, parts)(batches(rows))
    return pa.Table.from_batches(out).sort_by("route")


def removed(rows, found):
    cuts = {}
    for b in sd._shards(found.to_batches(max_chunksize=7)):
        for r in b.to_pylist():
            cuts.setdefault(r["key"], []).append({"start": r["start"], "stop": r["stop"]})
    out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows]), pa.array([cuts.get(k) for k, _ in rows], CUTS)],
                                     ["doc_id", "text", "cuts"])
    return sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for b in sd._remove([out]) for r in b.to_pylist())


def test_anchors_are_dealt_evenly_to_shards():
    rng = random.Random(3)
    size = np.zeros(256)
    for b in sd._anchor_rows(EVERY)(batches([(k, letters(rng, 100_000)) for k in range(4)])):
        for shard, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            size[shard] += len(raw)
    assert size.max() < 2 * size.mean()


def test_a_filter_with_many_anchors_still_drops_what_occurs_once(monkeypatch):
    monkeypatch.setattr(sd, "FILTER_BITS", 22)
    rng = random.Random(5)
    copies = [letters(rng, 100_000) for _ in range(40)]
    rows = [*enumerate(copies), *enumerate(copies, 100), *((k, letters(rng, 100_000)) for k in range(1000, 1004))]
    packed = pa.Table.from_batches(list(sd._anchor_rows(EVERY)(batches(rows)))).sort_by("shard").to_batches()
    bits, hot = np.zeros((256, 1 << sd.FILTER_BITS >> 14), np.uint64), np.zeros((256, 1 << sd.HOT_BITS >> 14), np.uint64)
    for b in sd._repeated(packed):
        shard = b.column(0)[0].as_py()
        bits[shard], hot[shard] = np.frombuffer(b.column(1)[0].as_py(), "<u8"), np.frombuffer(b.column(2)[0].as_py(), "<u8")
    found = pa.Table.from_batches(list(sd._segments(EVERY, Shared((bits.ravel(), hot.ravel())))(batches(rows))))
    keys = found["key"].to_numpy()
    assert (keys < 40).sum() > 200_000 and (keys >= 1000).sum() < 2000  # of about 28,000 in rows that have no copy


def test_phrases_common_by_chance_do_not_go_window_by_window(monkeypatch):
    monkeypatch.setattr(sd, "HOT_COUNT", 8)
    rng = random.Random(7)
    phrase = letters(rng, 30)
    rows = [(k, letters(rng, 200) + phrase + letters(rng, 200)) for k in range(60)]
    found = segments(rows)
    assert found.num_rows < 60  # one by one it is about 20 for each row
    assert removed(rows, found) == brute_suffix(rows) and not any(r[2] for r in brute_suffix(rows))


def test_copies_of_a_hot_line_leave_a_task_as_spans(monkeypatch):
    monkeypatch.setattr(sd, "HOT_COUNT", 8)
    rng = random.Random(9)
    line = letters(rng, 120)
    rows = [(k, letters(rng, 100) + line + letters(rng, 100)) for k in range(60)]
    found = segments(rows)
    whole = [r for r in found.to_pylist() if r["bytes"] is not None]
    # what sticks out of the line by less than a part is sent; one by one it is 71 and more for each row
    assert len(whole) < 60 * 2 * sd.PART and found.num_rows < 60 * 2 * sd.PART
    assert removed(rows, found) == brute_suffix(rows)


def test_hot_parts_and_rounds_equal_brute_force(monkeypatch):
    rows = repeated_corpus(40)
    rows += [(20_000 + i, "b" * n) for i, n in enumerate((49, 50, 51, 300, 90, 300))]
    for count, parts in ((2, 1), (3, 1), (6, 3), (2048, 3)):
        monkeypatch.setattr(sd, "HOT_COUNT", count)
        for seen in (1 << 20, 5):
            monkeypatch.setattr(sd, "SEEN", seen)
            assert removed(rows, segments(rows, parts)) == brute_suffix(rows)


def test_suffix_dedup_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(sd, "ROUND_ANCHORS", 50)
    rows = repeated_corpus(30)
    got = sd.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_suffix(rows)


def test_coded_values_and_texts_come_back():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 32, 1000, dtype=np.uint64)).astype(np.uint32)
    assert (sd._decoded(sd._coded(v)) == v).all() and not len(sd._decoded(sd._coded(v[:0])))
    rows = [(1, "é" * 400), (2, ""), (3, "z" * 5000), (4, "short")]
    for z in sd._zipped(batches(rows)):
        cuts = pa.array([None] * z.num_rows, CUTS)
        back = [r for b in sd._unzipped([pa.RecordBatch.from_arrays([z["key"], z["n"], z["frame"], cuts], ["doc_id", "n", "frame", "cuts"])], 100)
                for r in b.to_pylist()]
        assert [(r["doc_id"], r["text"].decode()) for r in back] == [x for x in rows if x[0] == z["key"][0].as_py()]
