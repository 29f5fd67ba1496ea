"""Token-ID output: static range asymmetric numeral system (rANS) blocks.

``write_blocks`` encodes every document with a public tokenizer, appends an end
id, and writes the ids in ascending ``doc_id`` order as independent blocks:

* one frequency table of the whole corpus, scaled to ``2**SCALE_BITS``, is
  written beside the blocks and named by its checksum in every block;
* a block holds whole documents (about ``block_tokens`` ids); its ids go round
  robin to interleaved lanes, each a 64-bit rANS state with 32-bit output words;
* every ``CHECK_STEPS`` steps a checkpoint keeps the lane states, the place in
  the words and the checksum of the ids up to the next one, so that segments of
  a block decode on their own (``decode_segment``) and blocks in parallel.

The dataset is a folder of Parquet files (``range=`` folders in ascending
document order), whose ``payload`` bytes are the self-describing blocks;
Spark's committer makes the write safe when executors are lost.

Rows: null text counts as empty (only the end id).  Repeated ``doc_id`` rows
are all kept, in order of their text.  A null ``doc_id`` sorts first and is
kept.  An empty table gives an empty dataset.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import buffers, materialise, slices, text_or_empty
from .tokenizing import MEMO_WORDS, TOKENIZER, encoder

END_ID = 2
SCALE_BITS = 18
LANES = 2048
CHECK_STEPS = 256
BLOCK_TOKENS = 1 << 20
LOW = np.uint64(1 << 31)
# magic, lanes, tokens, documents, words, checkpoints, scale bits, table checksum, first token's place
HEAD = struct.Struct("<4sIQIIIIIQ")
MAGIC = b"GWR1"
NULL_ID = -(1 << 63)


def scale_counts(ids: np.ndarray, counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies of at least 1 that add up to ``2**bits``, near the counts."""
    total = 1 << bits
    if len(ids) > total:
        raise ValueError("more distinct ids than the scale has slots")
    share = counts.astype(np.float64) / counts.sum()
    freq = np.maximum(1, np.floor(share * total)).astype(np.int64)
    left = total - int(freq.sum())
    order = np.lexsort((ids, -counts))
    if left >= 0:  # what rounding down left goes to the most frequent id
        freq[order[0]] += left
    else:  # rare ids were lifted to 1: take it from the frequent ones
        for i in order:
            take = min(int(freq[i]) - 1, -left)
            freq[i] -= take
            left += take
            if not left:
                break
    return freq


class Table:
    """Scaled frequencies of the corpus, ready for coding."""

    def __init__(self, ids, freq, bits: int = SCALE_BITS):
        order = np.argsort(ids)
        self.ids, self.freq, self.bits = np.asarray(ids, np.uint32)[order], np.asarray(freq, np.uint64)[order], bits
        self.cum = np.cumsum(self.freq) - self.freq
        self.slots = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))
        self.crc = zlib.crc32(self.ids.tobytes() + self.freq.tobytes())
        self.place = np.zeros(int(self.ids.max()) + 1 if len(self.ids) else 1, np.uint32)
        self.place[self.ids] = np.arange(len(self.ids), dtype=np.uint32)


def encode_block(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray, start: int, table: Table) -> bytes:
    n = len(ids)
    lanes = min(LANES, n)
    steps = -(-n // lanes)
    at = table.place[ids]
    freq, cum = table.freq[at], table.cum[at]
    bits, x = np.uint64(table.bits), np.full(lanes, LOW, np.uint64)
    top = np.uint64((1 << 31 >> table.bits) << 32)
    words, marks, sums, emitted = [], [], [], 0
    for step in range(steps - 1, -1, -1):
        lo, hi = step * lanes, min(n, (step + 1) * lanes)
        f, s = freq[lo:hi], x[:hi - lo]
        full = s >= top * f
        out = s[full]
        if len(out):
            words.append((out & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            emitted += len(out)
            s[full] = out >> np.uint64(32)
        q = s // f
        x[:hi - lo] = (q << bits) + (s - q * f) + cum[lo:hi]
        if step % CHECK_STEPS == 0:
            marks.append((emitted, x.copy()))
            sums.append(zlib.crc32(ids[lo:min(n, (step + CHECK_STEPS) * lanes)].astype("<u4").tobytes()))
    marks.reverse()
    sums.reverse()
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    body = b"".join((
        HEAD.pack(MAGIC, lanes, n, len(doc_ids), emitted, len(marks), table.bits, table.crc, start),
        doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(),
        np.array([emitted - m for m, _ in marks], "<u4").tobytes(), np.array(sums, "<u4").tobytes(),
        *(s.astype("<u8").tobytes() for _, s in marks), stream.astype("<u4").tobytes()))
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A parsed block; raises ``ValueError`` when its checksum does not hold."""

    def __init__(self, payload: bytes):
        if len(payload) < HEAD.size + 4 or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("block checksum differs")
        (magic, self.lanes, self.n, docs, words, marks, self.bits, self.table_crc,
         self.start) = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a block")
        at = HEAD.size

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.sizes = take("<i8", docs), take("<u4", docs)
        self.at, self.sums = take("<u4", marks), take("<u4", marks)
        self.states = take("<u8", marks * self.lanes).reshape(marks, self.lanes)
        self.words = take("<u4", words)


def decode_segment(block: Block, k: int, table: Table) -> np.ndarray:
    """Ids from checkpoint ``k`` up to the next one."""
    if block.table_crc != table.crc:
        raise ValueError("the block was written with another frequency table")
    lanes, bits, low = block.lanes, np.uint64(block.bits), LOW
    mask = np.uint64((1 << block.bits) - 1)
    x, at = block.states[k].astype(np.uint64), int(block.at[k])
    lo = k * CHECK_STEPS * lanes
    hi = min(block.n, (k + 1) * CHECK_STEPS * lanes)
    out = np.empty(hi - lo, np.uint32)
    for p in range(0, hi - lo, lanes):
        s = x[:min(lanes, hi - lo - p)]
        slot = s & mask
        sym = table.slots[slot]
        out[p:p + len(s)] = sym
        s[:] = table.freq[sym] * (s >> bits) + slot - table.cum[sym]
        need = np.flatnonzero(s < low)
        if len(need):
            s[need] = (s[need] << np.uint64(32)) | block.words[at:at + len(need)]
            at += len(need)
    ids = table.ids[out]
    if zlib.crc32(ids.astype("<u4").tobytes()) != block.sums[k]:
        raise ValueError("segment checksum differs")
    return ids


def decode_block(block: Block, table: Table) -> np.ndarray:
    return np.concatenate([decode_segment(block, k, table) for k in range(len(block.at))])


TOKENS = "part int, doc_id bigint, n_tokens bigint, local_start bigint, ids binary"
BLOCKS = "range int, start bigint, n_docs bigint, n_tokens bigint, payload binary"


def id_type(tokenizer: str, end_id: int) -> str:
    """The narrowest type for the ids of the intermediate table."""
    most = max(encoder(tokenizer).tokenizer.get_vocab_size() - 1, end_id)
    return "<u2" if most < 1 << 16 else "<u4"


def _tokens(tokenizer: str, end_id: int, kind: str, memo_words: int):
    def run(batches):
        part, place, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer, memo_words=memo_words)
        for b in slices(batches, 1):
            ids, n = enc.encode(b.column(1))
            sizes = n + 1
            ends = np.cumsum(sizes)
            flat = np.full(int(ends[-1]), end_id, kind)
            keep = np.ones(len(flat), bool)
            keep[ends - 1] = False
            flat[keep] = ids
            raw = flat.tobytes()
            width = flat.itemsize
            cut = (ends - sizes) * width
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(n), part, np.int32)), b.column(0), pa.array(sizes),
                pa.array(place + ends - sizes),
                pa.array([raw[a:a + s * width] for a, s in zip(cut.tolist(), sizes.tolist())], pa.binary()),
            ], ["part", "doc_id", "n_tokens", "local_start", "ids"])
            place += int(ends[-1])
    return run


def token_table(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                memo_words: int = MEMO_WORDS) -> DataFrame:
    """Ids of every document in ascending ``doc_id`` order: range partitions,
    sorted, each row with its place within its partition (written once)."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    ordered = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(_tokens(tokenizer, end_id, id_type(tokenizer, end_id), memo_words), TOKENS), "tokens", compression="snappy")


def corpus_table(tokens: DataFrame, kind: str) -> Table:
    """Frequency table of all ids; its size is bounded by the vocabulary."""
    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            c = np.bincount(buffers(b.column(0))[1].view(kind), minlength=len(total))
            if len(c) > len(total):
                total = np.pad(total, (0, len(c) - len(total)))
            total[:len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = (tokens.select("ids").mapInArrow(count, "id bigint, n bigint")
            .groupBy("id").agg(F.sum("n").alias("n")).toPandas())
    if not len(rows):
        return Table(np.zeros(0, np.uint32), np.zeros(0, np.uint64))
    ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
    return Table(ids, scale_counts(ids, n))


def _blocks(shared, block_tokens: int, kind: str):
    def run(batches):
        table, bases = shared.value
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size
            part, first = held[0][0], held[0][3]
            ids = np.frombuffer(b"".join(h[4] for h in held), kind)
            doc_ids = np.array([NULL_ID if h[1] is None else h[1] for h in held], np.int64)
            sizes = np.array([h[2] for h in held], np.int64)
            start = bases[part] + first
            row = [part, start, len(held), len(ids), encode_block(ids, doc_ids, sizes, start, table)]
            held, size = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                ["range", "start", "n_docs", "n_tokens", "payload"])

        for batch in slices(batches, 4):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != held[-1][0] or row[3] != held[-1][3] + held[-1][2] or size + row[2] > block_tokens):
                    yield flush()
                held.append(row)
                size += row[2]
        if held:
            yield flush()
    return run


def write_blocks(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 block_tokens: int = BLOCK_TOKENS, memo_words: int = MEMO_WORDS) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) into ``path``: ``blocks`` and ``table``.
    ``memo_words`` bounds the memory of a worker (about 200 bytes each) against time."""
    spark = docs.sparkSession
    tokens = token_table(docs, tokenizer, end_id, memo_words)
    kind = id_type(tokenizer, end_id)
    table = corpus_table(tokens, kind)
    # one total per range partition: bounded by the number of partitions
    totals = sorted((r.part, r.n) for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, place = {}, 0
    for part, n in totals:
        bases[part] = place
        place += n
    shared = spark.sparkContext.broadcast((table, bases))
    blocks = tokens.mapInArrow(_blocks(shared, block_tokens, kind), BLOCKS)
    blocks.write.option("compression", "none").partitionBy("range").parquet(f"{path}/blocks")
    spark.createDataFrame(list(zip(table.ids.tolist(), table.freq.tolist())), "id bigint, freq bigint") \
        .coalesce(1).write.parquet(f"{path}/table")


def read_table(spark, path: str) -> Table:
    t = spark.read.parquet(f"{path}/table").toPandas()  # bounded by the vocabulary
    return Table(t["id"].to_numpy(), t["freq"].to_numpy())


def read_blocks(spark, path: str) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids`` (ids: 32-bit little-endian bytes)."""
    return _read(spark, path, "doc_id bigint, start bigint, n_tokens bigint, ids binary",
                 lambda raw: pa.array(raw, pa.binary()), "ids")


def read_summary(spark, path: str) -> DataFrame:
    """As ``read_blocks``, with the unsigned crc32 of the ids in place of the ids."""
    return _read(spark, path, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
                 lambda raw: pa.array([zlib.crc32(r) for r in raw], pa.int64()), "ids_crc32")


def _read(spark, path, schema, last, name) -> DataFrame:
    shared = spark.sparkContext.broadcast(read_table(spark, path))

    def run(batches):
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                block = Block(payload)
                raw = decode_block(block, shared.value).astype("<u4").tobytes()
                sizes = block.sizes.astype(np.int64)
                ends = np.cumsum(sizes)
                pieces = [raw[4 * (e - s):4 * e] for e, s in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.doc_ids, mask=block.doc_ids == NULL_ID),
                    pa.array(block.start + ends - sizes), pa.array(sizes), last(pieces)],
                    ["doc_id", "start", "n_tokens", name])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("payload")
    return blocks.mapInArrow(run, schema)
