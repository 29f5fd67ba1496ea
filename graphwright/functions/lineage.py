"""Lineage cuts that survive executor loss (reliable checkpoints only)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir, scratch_path


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder named by
    ``spark.checkpoint.dir`` (set only when the session has none)."""
    try:
        ensure_checkpoint_dir(df.sparkSession)
    except Exception:  # noqa: BLE001 - sessions without a SparkContext handle it server-side
        pass
    return df.checkpoint(eager=eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once, as columns, to the shared folder and read it back: for a table that
    several branches of a plan read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
