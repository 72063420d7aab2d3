"""Panel windows: values of other years of the same entity.

All of them share one partitioning (entity) and one order (year), so Spark plans a
single shuffle for any combination. A window holds one row per year of one entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalis.functions.scalar import ratio, row_mean
from annalis.spec import PanelSpec


def at_year_offset(c: str, k: int, spec: PanelSpec) -> Column:
    """Value of the row exactly k years away; a gap gives NULL. Needs unique panel keys."""
    return F.max(c).over(spec.years_away(k))


def exact_year_shift(df: DataFrame, cols: list[str], k: int, suffix: str, spec: PanelSpec) -> DataFrame:
    return df.withColumns({f"{c}{suffix}": at_year_offset(c, k, spec) for c in cols})


def target_year(spec: PanelSpec) -> Column:
    """Next year when the entity has a row there, whatever its values."""
    present = F.count(F.lit(1)).over(spec.years_away(1)) > 0
    return F.when(present, F.col(spec.year) + 1).cast("int")


def delta(c: str, spec: PanelSpec) -> Column:
    return F.col(c) - at_year_offset(c, -1, spec)


def row_lag(c: str, k: int, spec: PanelSpec) -> Column:
    """Value k rows earlier, gaps ignored; negative k looks ahead."""
    return F.lag(c, k).over(spec.history())


def guarded_lead(c: str, h: int, spec: PanelSpec) -> Column:
    """Value h rows ahead, kept only when that row is exactly h years later."""
    ahead = F.lead(spec.year, h).over(spec.history())
    return F.when(ahead == F.col(spec.year) + h, F.lead(c, h).over(spec.history()))


def rolling_mean_rows(c: str, rows: int, spec: PanelSpec) -> Column:
    return F.avg(c).over(spec.history().rowsBetween(1 - rows, 0))


def expanding_mean(c: str, spec: PanelSpec) -> Column:
    """Mean of the known values so far; NULL values of the current row keep the earlier mean."""
    return F.avg(c).over(spec.history().rowsBetween(Window.unboundedPreceding, 0))


def running_sum(c: str, spec: PanelSpec) -> Column:
    return F.sum(c).over(spec.history().rowsBetween(Window.unboundedPreceding, 0))


def cumulative_rate(df: DataFrame, count: str, size: str, spec: PanelSpec) -> DataFrame:
    out = df.withColumns({"cum_count": running_sum(count, spec), "cum_size": running_sum(size, spec)})
    return out.withColumn("pooled", ratio(100 * F.col("cum_count"), F.col("cum_size")))


def recent_mean(c: str, rows: int, spec: PanelSpec) -> Column:
    """Mean of the current and the rows-1 earlier rows from explicit lags."""
    return row_mean([F.col(c), *[row_lag(c, k, spec) for k in range(1, rows)]])


def demean_within(df: DataFrame, c: str, by: list[str], out: str, calendar: bool = False) -> DataFrame:
    """Value minus the mean of its group. The group means are aggregated first and joined
    back, so a large group is never sorted in one task. ``calendar`` says that the groups are
    years: their means are then broadcast, otherwise Spark decides by size."""
    means = df.groupBy(*by).agg(F.avg(c).alias("_mean"))
    means = F.broadcast(means) if calendar else means
    return df.join(means, by).withColumn(out, F.col(c) - F.col("_mean")).drop("_mean")


def ever_flagged(flag: str, spec: PanelSpec) -> Column:
    return F.max(flag).over(Window.partitionBy(spec.entity))


def longitudinal(
    df: DataFrame, lags: list[str], deltas: list[str], nexts: list[str], spec: PanelSpec, target: str = "ANO_ALVO"
) -> DataFrame:
    """Lag, change and next-year columns plus the target year, in one shuffle."""
    return df.withColumns(
        {
            target: target_year(spec),
            **{f"{c}_LAG1": at_year_offset(c, -1, spec) for c in lags},
            **{f"{c}_DELTA1": delta(c, spec) for c in deltas},
            **{f"{c}_T1": at_year_offset(c, 1, spec) for c in nexts},
        }
    )
