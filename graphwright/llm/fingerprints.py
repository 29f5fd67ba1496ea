"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch is the ascending array of the ``K`` smallest distinct 48-bit shingle
hashes of a text (all of them if there are fewer; a text of fewer than five
words is one shingle).  Everything is a Spark expression on such arrays:

* ``merge(a, b)`` and ``merge_groups`` give the sketch of a union of parts;
* ``resemblance(a, b)`` and ``containment(a, b)`` estimate the likeness of the
  shingle sets and the part of the first that the second holds;
* ``distinct(a)`` estimates the number of distinct shingles.

Rows: null and empty texts (and texts without words) have the empty sketch;
two empty sketches are alike (1), an empty and a full one are not (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, text_or_empty

K, SIZE, BITS = 128, 5, 48
BUCKET_BITS = 8
FIRST_ID = -(1 << 63)


def sketch(text: Column, k: int = K, size: int = SIZE) -> Column:
    w = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+"), "")

    def of(words):
        runs = F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1)))
        hashes = F.transform(runs, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(words, i, size)), 64 - BITS))
        return F.when(F.size(words) > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    # a one-element array binds the words, so that they are split once
    hashes = F.transform(F.array(w), of)[0]
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """The merged ``sketch`` of each group of parts.  Each task first cuts its part
    of a group to ``k`` hashes, so a group of any size meets in ``k`` per task."""
    hashes = df.select(*keys, F.explode(sketch_col).alias("_h")).distinct()
    low = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    return low.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    low = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(low, a), b))
    return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(both / F.size(low))


def distinct(a: Column, k: int = K) -> Column:
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(
        F.lit(float(k - 1)) * F.lit(float(1 << BITS)) / (F.element_at(a, k) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Part of the shingles of ``a`` that ``b`` holds: shared shingles of the union
    over the shingles of ``a``."""
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct(a, k)))


def as_string(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), " ")


def _next_buckets(keys: DataFrame) -> DataFrame:
    """``key`` (first of a bucket) and ``before`` (the bucket that precedes it, cyclically).
    Buckets are in range partitions; only one row of each partition meets in one task."""
    firsts = keys.groupBy("bucket").agg(F.min("key").alias("key"))
    parts = materialise(firsts.repartitionByRange("bucket").withColumn("part", F.spark_partition_id()), "buckets")
    ends = parts.groupBy("part").agg(F.max("bucket").alias("last"))
    over = Window.orderBy("part")  # one row per partition
    last = F.lag("last").over(over)
    ends = ends.select("part", F.coalesce(last, F.max("last").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("wrap"))
    inside = F.lag("bucket").over(Window.partitionBy("part").orderBy("bucket"))
    return parts.withColumn("inside", inside).join(ends, "part").select("key", F.coalesce("inside", "wrap").alias("before"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text`` and the sketches of both; next by ascending
    ``doc_id``, after the last the first (null ids first, repeated ids by text).

    Documents go to buckets of ``2**BUCKET_BITS`` ids, one shuffle of the texts;
    the first document of the following bucket is sent along as a guest."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    d = d.withColumn("key", F.coalesce("doc_id", F.lit(FIRST_ID))).withColumn("bucket", F.shiftright("key", BUCKET_BITS))
    guests = d.drop("bucket").join(_next_buckets(d.select("key", "bucket")), "key").select(
        "doc_id", "text", "key", F.col("before").alias("bucket"), F.lit(1).alias("guest"))
    rows = d.withColumn("guest", F.lit(0)).unionByName(guests).repartition("bucket")
    rows = rows.withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", "key", "text")
    return (rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
            .where("guest = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Every document beside its edited text, whose last half of the code points is
    replaced by the first ones of the next document."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("sketch")).alias("fingerprint"),
                       as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
                       resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
                       distinct(F.col("sketch")).alias("n_shingles_estimate"))
