"""Refresh of a yearly stage: only missing or forced years are computed and replaced.

The source study has no stream. Its nearest counterpart is this refresh, a batch job
that overwrites single year partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def years_to_refresh(wanted: DataFrame, have: DataFrame, year: str, forced: list[int] | None = None, force_all: bool = False) -> DataFrame:
    """Wanted years without a stored partition, plus the forced ones."""
    if force_all:
        return wanted.select(year).distinct()
    stored = have.select(year).distinct()
    if forced:
        stored = stored.where(~F.col(year).isin(forced))
    return wanted.select(year).distinct().join(stored, year, "left_anti")


def replace_years(df: DataFrame, path: str, year: str) -> None:
    """Overwrite only the year partitions that ``df`` has."""
    df.hint("rebalance", year).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year).parquet(path)
