"""Scan tables: one row per scan with an array of readings and an explicit row key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def merge_scans(arrays: DataFrame, stamps: DataFrame, row: str, utc_s: str, min_s: float,
                shift_s: float) -> DataFrame:
    """Parallel datasets joined by row number; a row missing on either side is cut.

    Clocks not after ``min_s`` are dropped, the raw clock is kept next to the
    shifted one.
    """
    d = arrays.join(stamps.filter(F.col(utc_s) > min_s), row)
    return d.withColumn("local_s", F.col(utc_s) + shift_s)


def gather(scans: DataFrame, requests: DataFrame, row: str, position: str) -> DataFrame:
    """Scans by requested row number; ``position`` keeps the request order."""
    return requests.select(position, row).join(scans, row)
