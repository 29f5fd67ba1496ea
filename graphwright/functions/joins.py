"""Join helpers.

Broadcast is used in three ways only:

* ``join_fixed``: the small side is a fixed lookup table (a few rows of fixed
  values), so its size is bounded by construction;
* ``skew_join``: the list of hot keys, at most ``HOT_SHARE`` by their definition;
* ``scan_csv_union``: one small row for each file or block, as in the listing that the driver holds.

Everything else is a plain join: AQE measures the real shuffle output at
runtime, turns the join into a broadcast join only under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and splits skewed partitions
of the big side when a key is hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def join_fixed(big: DataFrame, fixed: DataFrame, on, how: str = "inner") -> DataFrame:
    return big.join(F.broadcast(fixed), on, how)


def fixed_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A fixed lookup table built from a handful of fixed values."""
    return spark.createDataFrame(list(rows), schema)


# A key is hot if it has at least HOT_ROWS rows and more than one in HOT_SHARE of all; so
# at most HOT_SHARE keys are, whatever the data, and their list may be broadcast.  Its rows are
# dealt to ceil(rows / ROWS_PER_TASK) salts.
HOT_ROWS = 1_000_000
HOT_SHARE = 4096
ROWS_PER_TASK = 1_000_000
# Null keys match nothing; they are spread over this many salts.
NULL_SALTS = 1 << 20

_UNHASHABLE = ("map<", "variant")


def hot_keys(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _s`` of the hot keys of a table of counts ``keys, _n``: at most ``HOT_SHARE``
    rows, found inside the plan that uses them."""
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.where((F.col("_n") >= HOT_ROWS) & (F.col("_n") > total / HOT_SHARE))
    return hot.select(*keys, F.ceil(F.col("_n") / F.lit(ROWS_PER_TASK)).cast("bigint").alias("_s"))


def skew_join(big: DataFrame, dim: DataFrame, on, how: str = "inner",
              count_col: str | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Join ``big`` to ``dim`` (few rows per key) when one key of ``big`` may
    hold a large share of its rows.

    Keys are counted by a partial aggregate over the key columns alone, of ``counted`` if that
    is a cheaper table with the same keys, or come from ``dim`` if ``count_col`` names its
    column of group sizes.  A hot key's big rows get a salt (hash of the
    row, stable on retry; identical rows stay together), its dim rows are
    repeated once per salt, and the join runs on ``(key, salt)``.  Rows with a
    null key match nothing and are spread by a salt of their own, so that a
    left join does not gather them in one task.  No job runs before the result is asked for.
    """
    keys = [on] if isinstance(on, str) else list(on)
    missing = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    counts = (dim.select(*keys, F.col(count_col).alias("_n")) if count_col else
              (big if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    split = F.broadcast(hot_keys(counts.where(~missing), keys))
    hashable = [F.col(f"`{f.name}`") for f in big.schema.fields
                if not any(t in f.dataType.simpleString() for t in _UNHASHABLE)]
    row_hash = F.xxhash64(*hashable)
    null_salt = F.when(missing, F.pmod(row_hash, F.lit(NULL_SALTS)))
    b = (big.join(split, keys, "left")
         .withColumn("_salt", F.coalesce(null_salt, F.pmod(row_hash, F.col("_s")), F.lit(0).cast("bigint"))).drop("_s"))
    d = (dim.join(split, keys, "left")
         .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_s"), F.lit(1)) - 1))).drop("_s"))
    return b.join(d, keys + ["_salt"], how).drop("_salt")
