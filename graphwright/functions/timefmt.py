"""Time rendering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import LOCAL_TIME_ZONE


def local_time_text(ts_utc: Column, zone: str = LOCAL_TIME_ZONE) -> Column:
    """``Mon, 01 Jul 2024 12:00:00 CEST`` for a UTC wall-clock timestamp.

    The zone abbreviation is derived from the offset (two hours -> summer
    time), which is what the Central European zone uses."""
    ntz = ts_utc.cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ntz)
    minutes = F.timestamp_diff("MINUTE", ntz, local)
    abbr = F.when(minutes == 120, F.lit("CEST")).otherwise(F.lit("CET"))
    return F.concat(F.date_format(local, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" "), abbr)
