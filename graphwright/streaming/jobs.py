"""Structured Streaming jobs.

Sources are file streams (Parquet parts arriving in a folder).  What a job remembers is
in Spark's state store (RocksDB, kept with the checkpoint in the shared folder):
running counts, the first context of each concept, the triples seen.  A micro-batch reads
its own files and the state of its own keys, however much was ingested before.  Sinks
write a slice of each batch's own (overwritten when a batch is replayed) or Spark's file sink
with its log, so a replay after a failure adds nothing twice.  Checkpoints live under the
shared checkpoint folder.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import exists
from ..operators import entities as E, relations as R, triples as T

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_store(spark: SparkSession):
    """State on disk instead of the executors' heaps, for queries started inside (a query
    keeps the settings that it started with)."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The files of a folder as a stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _run(writer, ckpt: str) -> None:
    """Run a stream over all files there are."""
    spark = SparkSession.active()
    with _state_store(spark):
        q = writer.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def _slice_sink(out: str, make):
    """A sink that writes ``make(batch)`` to a slice of the batch's own; a replayed
    batch overwrites its slice, so nothing counts twice."""
    def sink(batch: DataFrame, batch_id: int):
        make(batch).write.mode("overwrite").parquet(f"{out}/slices/batch_id={batch_id}")
    return sink


def compact_slices(spark: SparkSession, out: str, merge, schema: str) -> None:
    """Merge all slices up to now into one table, ``compact/upto=<last batch>``.
    Readers take the newest one and the slices after it, so a run of the job
    reads what is new and not every slice ever written."""
    upto = _last(spark, f"{out}/slices")
    if upto is not None and upto != _last(spark, f"{out}/compact"):
        merge(_state(spark, out, schema)).write.mode("overwrite").parquet(f"{out}/compact/upto={upto}")


def _last(spark: SparkSession, folder: str) -> int | None:
    """Largest number in the ``name=<n>`` folders that hold a finished write."""
    if not exists(spark, folder):
        return None
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    done = [int(p.getName().split("=")[1]) for p in names
            if "=" in p.getName() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def _state(spark: SparkSession, out: str, schema: str) -> DataFrame:
    upto = _last(spark, f"{out}/compact")
    rows = spark.createDataFrame([], schema)
    if exists(spark, f"{out}/slices"):
        after = spark.read.schema(schema + ", batch_id bigint").parquet(f"{out}/slices")
        rows = rows.unionByName((after if upto is None else after.where(F.col("batch_id") > upto)).drop("batch_id"))
    if upto is not None:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{out}/compact/upto={upto}"))
    return rows


COUNTS = "value string, n bigint"


def _largest(rows: DataFrame) -> DataFrame:
    """Counts only grow, so the newest one of a value is its largest."""
    return rows.groupBy("value").agg(F.max("n").alias("n"))


def stream_identifier_stats(spark: SparkSession, src: str, out: str, ckpt: str, schema, json_col: str = "data",
                            files_per_batch: int | None = None) -> DataFrame:
    """Running identifier counts: a grouped count in the state store.  Documents are
    walked to any depth in a projection; a micro-batch writes the counts that it changed."""
    counts = E.keyed_identifiers(file_stream(spark, src, schema, files_per_batch), json_col).groupBy("value").agg(F.count("*").alias("n"))
    _run(counts.writeStream.outputMode("update").foreachBatch(_slice_sink(out, lambda batch: batch)), ckpt)
    compact_slices(spark, out, _largest, COUNTS)
    return current_counts(spark, out)


def current_counts(spark: SparkSession, out: str) -> DataFrame:
    return _largest(_state(spark, out, COUNTS))


_ORDER = ("doc_id", "uid", "atom_ix", "side")
FIRSTS = "concept string, first struct<doc_id: bigint, uid: bigint, atom_ix: bigint, side: int, context: string>"


def _concepts(responses: DataFrame, *more: str) -> DataFrame:
    """``concept, first`` (its place, then its context) for both sides of every atom."""
    a = R.complete_atoms(R.atoms(responses))
    first = lambda side: F.struct(*(F.col(c).cast("bigint").alias(c) for c in _ORDER[:3]), F.lit(side).alias("side"),
                                  F.col("sentence").alias("context"))
    sides = F.array(*(F.struct(F.col(c).alias("concept"), first(i).alias("first")) for i, c in enumerate(("concept1", "concept2"))))
    return a.select(*more, F.inline(sides))


def _first_context(rows: DataFrame) -> DataFrame:
    """The context of the smallest order key (document, sentence, atom, side) per concept."""
    return rows.groupBy("concept").agg(F.min("first").alias("first"))


def stream_concept_worklist(spark: SparkSession, src: str, out: str, ckpt: str, schema,
                            files_per_batch: int | None = None) -> DataFrame:
    """Concepts with their first context, kept in the state store: the batch result, in whatever
    order the files arrive.  A micro-batch writes the concepts that it changed."""
    firsts = _first_context(_concepts(file_stream(spark, src, schema, files_per_batch)))
    _run(firsts.writeStream.outputMode("update").foreachBatch(_slice_sink(out, lambda batch: batch)), ckpt)
    compact_slices(spark, out, _first_context, FIRSTS)
    return _first_context(_state(spark, out, FIRSTS)).select("concept", "first.doc_id", "first.uid", "first.context")


def stream_new_concepts(spark: SparkSession, src: str, out: str, ckpt: str, schema, event_time: str, within: str = "1 day",
                        files_per_batch: int | None = None) -> DataFrame:
    """Concepts as they are first seen, with state that is forgotten: a concept is
    written when no row of it came in the last ``within`` of ``event_time``."""
    stream = file_stream(spark, src, schema, files_per_batch)
    # atoms drop columns that they do not know, so the time goes along as the sentence's key
    timed = stream.withColumn("sentence", F.to_json(F.struct(F.col(event_time).alias("t"), F.col("sentence").alias("s"))))
    parts = F.from_json("first.context", "t timestamp, s string")
    rows = _concepts(timed).select("concept", parts["t"].alias(event_time), "first.doc_id", "first.uid", parts["s"].alias("context"))
    fresh = rows.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["concept"])
    _own_sink(spark, out, ckpt)
    _run(fresh.writeStream.format("parquet").option("path", out), ckpt)
    return spark.read.schema(f"concept string, `{event_time}` timestamp, doc_id bigint, uid bigint, context string").parquet(out)


GRAPH = "s string, p string, o string, o_kind string, lang string"


def _own_sink(spark: SparkSession, out: str, ckpt: str) -> None:
    """The file sink skips batches that its log has, so a folder belongs to one checkpoint."""
    if exists(spark, f"{out}/_spark_metadata") and not exists(spark, f"{ckpt}/offsets"):
        raise ValueError(f"{out} was written from another checkpoint")


def stream_ingest(spark: SparkSession, src: str, out: str, ckpt: str, schema, strict_case: bool = True,
                  files_per_batch: int | None = None) -> DataFrame:
    """Document-at-a-time ingest: replies -> atoms -> SKOS triples; each triple is written when it is
    seen first.  Triples seen are keys of the state store, so a batch reads its own
    replies and no part of the graph that was written before."""
    triples = T.kg_skos(R.atoms(file_stream(spark, src, schema, files_per_batch)), strict_case, distinct=False)
    new = triples.select(*T.TRIPLE_COLS).dropDuplicates(list(T.TRIPLE_COLS))
    _own_sink(spark, out, ckpt)
    _run(new.writeStream.format("parquet").option("path", out), ckpt)
    return spark.read.schema(GRAPH).parquet(out)
