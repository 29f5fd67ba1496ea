"""Parquet table access.

Only ``spark.read.parquet`` is used, so projections and filters written later
reach the scan (``ReadSchema`` / ``PushedFilters``).  The schema of a table
path is inferred once and passed explicitly afterwards, which skips the
footer-reading job on every later read (the input tables are read-only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

_SCHEMAS: dict[tuple[str, str], object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    # remembered for the application: a later one reads the footers anew
    key = (spark.sparkContext.applicationId, path)
    schema = _SCHEMAS.get(key)
    if schema is None:
        df = spark.read.parquet(path)
        _SCHEMAS[key] = df.schema
        return df
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many parts as the session's parallelism: a table of few row groups is
    dealt out before heavy work, one with enough of them stays where it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
