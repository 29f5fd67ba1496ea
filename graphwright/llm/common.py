"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path


_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context.  Arrow
    batches get ``BATCH_ROWS`` rows unless the session says otherwise: whole texts
    make Spark's default of 10,000 rows some tens of MB on both sides of each task."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if getattr(sc, "_shipped_packages", None):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._shipped_packages = [path]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a columnar
    lineage cut that survives the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def word_list(text: Column) -> Column:
    """Lower-cased words of a text as Spark expressions: maximal runs of
    letters, marks, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w != F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], column: int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of a piece stays near ``max_bytes``
    (one row at least), which bounds what a task holds besides one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets, _ = buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0, one more than rows) and bytes of a string or binary column
    without nulls."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], raw[o[0]:o[-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    if not total:
        return out
    heads = np.cumsum(n) - n
    out[0] = s[0]
    out[heads[1:]] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def bitmap(hashes: DataFrame, bits: int, column: str = "h") -> np.ndarray:
    """Bitmap of ``2**bits`` bits over the top bits of 64-bit hashes.  Its size is
    fixed whatever the number of hashes; a set bit is no proof, an unset one is.
    Tasks pack the bits of a range, so the driver gets at most ``2**bits`` bits."""
    low = bits - 8

    def pack(batches):
        now, flags = None, None
        for b in batches:
            shard, at = (b.column(i).to_numpy() for i in (0, 1))
            for k in np.unique(shard).tolist():
                if k != now:
                    if now is not None:
                        yield _packed(now, flags)
                    now, flags = k, np.zeros(1 << low, np.uint8)
                flags[at[shard == k]] = 1
        if now is not None:
            yield _packed(now, flags)

    bit = F.shiftrightunsigned(column, 64 - bits)
    rows = (hashes.select(bit.alias("b")).distinct()
            .select(F.shiftright("b", low).cast("int").alias("shard"), F.expr(f"cast(b & {(1 << low) - 1}L AS int)").alias("at"))
            .repartition("shard").sortWithinPartitions("shard").mapInArrow(pack, "shard int, bits binary"))
    out = np.zeros((256, 1 << low >> 6), np.uint64)
    for shard, raw in rows.toLocalIterator():
        out[shard] = np.frombuffer(raw, "<u8")
    return out.ravel()


def _packed(shard: int, flags: np.ndarray) -> pa.RecordBatch:
    raw = np.packbits(flags, bitorder="little").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([raw], pa.binary())], ["shard", "bits"])
