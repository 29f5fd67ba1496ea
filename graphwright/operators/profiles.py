"""Profiles that merge: a state for each column of a part of a table, so parts that are
appended are profiled alone.

A state holds rows, nulls, least and largest value, sum, and three sketches of Spark's own:
distinct values (HyperLogLog, ``2**LG_DISTINCT`` registers: a relative standard error of
``1.04 / sqrt(2**LG_DISTINCT)``), quantiles of numbers (KLL: ranks within 2% at Spark's default
size) and most common texts (frequent items, ``TRACKED`` counters: counts within
rows / ``TRACKED``, values above that are never missed).  States merge in any order and grouping, and their size does not
depend on the number of rows.  One aggregate makes the states of all columns, with no row
repeated for a column.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import exists
from .questions import _is_num, sql_type

LG_DISTINCT = 12
TRACKED = 4096
_SUMS = ("n_rows", "n_nulls", "sum_num")


def column_states(df: DataFrame, *by: str) -> DataFrame:
    """One state for each column, and each value of ``by`` (names of columns that are not profiled)."""
    fields = [f for f in df.schema.fields if f.name not in by]
    aggs: list[Column] = []
    structs = []
    none = lambda t: F.lit(None).cast(t)
    for i, f in enumerate(fields):
        c, num = F.col(f"`{f.name}`"), _is_num(f.dataType)
        text = c.cast("string")
        state = {
            "n_nulls": F.count_if(c.isNull()), "sum_num": F.sum(c.cast("double")) if num else none("double"),
            "min_num": F.min(c).cast("double") if num else none("double"), "max_num": F.max(c).cast("double") if num else none("double"),
            "min_str": none("string") if num else F.min(text), "max_str": none("string") if num else F.max(text),
            "distinct_sketch": F.hll_sketch_agg(text, LG_DISTINCT),
            "quantile_sketch": F.kll_sketch_agg_double(c.cast("double")) if num else none("binary"),
            "common_sketch": F.call_function("approx_top_k_accumulate", none("string") if num else text, F.lit(TRACKED)),
        }
        aggs += [v.alias(f"{k}_{i}") for k, v in state.items()]
        structs.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(sql_type(f.dataType)).alias("column_type"),
                                F.col("n_rows").alias("n_rows"), *(F.col(f"{k}_{i}").alias(k) for k in state)))
    one = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    return one.select(*by, F.inline(F.array(*structs)))


def merge_states(states: DataFrame) -> DataFrame:
    """One state for each column."""
    return states.groupBy("column_name", "column_type").agg(
        *(F.sum(c).alias(c) for c in _SUMS), *(F.min(c).alias(c) for c in ("min_num", "min_str")),
        *(F.max(c).alias(c) for c in ("max_num", "max_str")), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.call_function("approx_top_k_combine", F.col("common_sketch"), F.lit(TRACKED)).alias("common_sketch"))


def profile(states: DataFrame, quantiles=(0.25, 0.5, 0.75), most_common: int = 3) -> DataFrame:
    """``column_name, column_type, n_rows, n_nulls, n_distinct, min_num, max_num, avg_num, min_str, max_str,
    quantiles, most_common``; quantiles are null for texts and columns without a value."""
    m = merge_states(states)
    some = F.col("n_rows") > F.col("n_nulls")
    return m.select(
        "column_name", "column_type", "n_rows", "n_nulls", F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), "min_num", "max_num",
        F.when(some, F.col("sum_num") / (F.col("n_rows") - F.col("n_nulls"))).alias("avg_num"), "min_str", "max_str",
        F.when(F.col("min_num").isNotNull(), F.array(*(F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(q))) for q in quantiles))).alias("quantiles"),
        F.when(F.col("min_str").isNotNull(), F.call_function("approx_top_k_estimate", F.col("common_sketch"), F.lit(most_common))).alias("most_common"))


def _place(file: str) -> tuple[str, ...]:
    """A file by its parts: a URI is written with one slash or with three."""
    return tuple(urlsplit(file)[:3])


def refresh(spark: SparkSession, folder: str, store: str) -> DataFrame:
    """States of a folder of Parquet files, kept in ``store``: only files that it does not
    know yet are read.  Files of the folder are written once and never changed."""
    df = spark.read.parquet(folder)
    known = spark.read.parquet(store) if exists(spark, store) else None
    seen = set() if known is None else {_place(r.file) for r in known.select("file").distinct().collect()}
    new = [f for f in df.inputFiles() if _place(f) not in seen]
    if new:
        rows = spark.read.schema(df.schema).parquet(*new).withColumn("file", F.col("_metadata.file_path"))
        column_states(rows, "file").write.mode("append").parquet(f"{store}/added={uuid.uuid4().hex}")
    return spark.read.parquet(store).drop("added")
