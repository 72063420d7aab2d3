"""Declarative checks of a panel.

Every check gives rows (section, check_name, subject, status, n_bad). Row conditions of
one table share one aggregate. Nothing but these small results reaches the driver.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalis.functions.scalar import ratio
from annalis.operators import profile, reconcile, sets, shifts
from annalis.spec import PanelSpec


class Check(NamedTuple):
    """One line of a report: ``bad`` is an aggregate or a column of a one-row table."""

    section: str
    name: str
    subject: str
    bad: Column
    otherwise: str = "fail"


def report(one_row: DataFrame, checks: list[Check]) -> DataFrame:
    """Rows of a report from a one-row table with the columns that the checks use."""
    cells = [
        F.struct(
            F.lit(c.section).alias("section"), F.lit(c.name).alias("check_name"), F.lit(c.subject).alias("subject"),
            F.when(F.coalesce(c.bad, F.lit(0)) == 0, "ok").otherwise(c.otherwise).alias("status"),
            F.coalesce(c.bad, F.lit(0)).cast("bigint").alias("n_bad"),
        )
        for c in checks
    ]
    return one_row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def row_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Checks whose ``bad`` is a row condition: all of them in one aggregate."""
    one = df.agg(*[F.sum(F.coalesce(c.bad, F.lit(False)).cast("bigint")).alias(f"b{i}") for i, c in enumerate(checks)])
    return report(one, [c._replace(bad=F.col(f"b{i}")) for i, c in enumerate(checks)])


def verdict(results: DataFrame) -> DataFrame:
    """Number of results per status."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("checks"))


def type_contract(df: DataFrame, expected: dict[str, type[T.DataType]]) -> DataFrame:
    """Columns whose type is not the expected kind."""
    types = {f.name: f.dataType for f in df.schema.fields}
    one = df.agg(F.count(F.lit(1)).alias("rows"))
    return report(one, [Check("types", "type", c, F.lit(0 if isinstance(types.get(c), t) else 1)) for c, t in expected.items()])


def exact_columns(df: DataFrame, expected: list[str], subject: str) -> DataFrame:
    missing, extra = set(expected) - set(df.columns), set(df.columns) - set(expected)
    one = df.agg(F.count(F.lit(1)).alias("rows"))
    return report(one, [Check("columns", "missing columns", subject, F.lit(len(missing))), Check("columns", "extra columns", subject, F.lit(len(extra)))])


def unique_key(df: DataFrame, keys: list[str], subject: str) -> DataFrame:
    one = reconcile.repeated_keys(df, keys).agg(F.count(F.lit(1)).alias("bad"))
    return report(one, [Check("key", "unique key", subject, F.col("bad"))])


def no_marker(df: DataFrame, marker: str = "--") -> DataFrame:
    cols = profile.text_columns(df)
    return row_checks(df, [Check("marker", "no residual marker", c, F.trim(c) == marker) for c in cols])


def year_cover(df: DataFrame, years: int, spec: PanelSpec) -> DataFrame:
    """Rows equal distinct entities in every year, and all years are there."""
    one = profile.rows_per_year(df, spec).agg(
        F.sum((F.col("rows") != F.col("entities")).cast("bigint")).alias("repeated"), F.count(F.lit(1)).alias("years")
    )
    return report(one, [Check("cover", "rows equal entities", "every year", F.col("repeated")), Check("cover", "years present", str(years), F.abs(F.col("years") - years))])


def in_range(df: DataFrame, cols: list[str], low: float = 0.0, high: float = 100.0) -> DataFrame:
    return row_checks(df, [Check("range", "in range or NULL", c, (F.col(c) < low) | (F.col(c) > high)) for c in cols])


def yearly_direction(df: DataFrame, rate: str, spec: PanelSpec) -> DataFrame:
    """Mean of a rate per year and whether it fell or rose against the year before.

    The window runs over one row per year, not over the panel.
    """
    means = df.groupBy(spec.year).agg(F.avg(rate).alias("_m"))
    before = F.lag("_m").over(Window.orderBy(spec.year))
    direction = F.when(F.col("_m") < before, "fell").when(F.col("_m") > before, "rose")
    return means.select(spec.year, F.round("_m", 6).alias("mean"), direction.alias("direction"))


def temporal_curve(df: DataFrame, rate: str, lower: tuple[int, int], higher: tuple[int, int], spec: PanelSpec) -> DataFrame:
    """``lower``: (a, b) with mean(a) < mean(b) expected; ``higher``: (a, b) with mean(a) > mean(b)."""

    def mean(y: int) -> Column:
        return F.avg(F.when(F.col(spec.year) == y, F.col(rate)))

    wanted = df.where(F.col(spec.year).isin([*lower, *higher]))
    one = wanted.agg(
        (~F.coalesce(mean(lower[0]) < mean(lower[1]), F.lit(False))).cast("int").alias("l"),
        (~F.coalesce(mean(higher[0]) > mean(higher[1]), F.lit(False))).cast("int").alias("h"),
    )
    return report(one, [Check("curve", "lower than", f"{lower[0]}<{lower[1]}", F.col("l")), Check("curve", "higher than", f"{higher[0]}>{higher[1]}", F.col("h"), "warn")])


def lag_coherent(df: DataFrame, value: str, lag: str, spec: PanelSpec, tol: float = 0.01) -> DataFrame:
    rows = df.select(F.abs(shifts.row_lag(value, 1, spec) - F.col(lag)).alias("gap"))
    return row_checks(rows, [Check("lag", "lag is the previous row", lag, F.col("gap") > tol)])


def next_coherent(df: DataFrame, value: str, nxt: str, spec: PanelSpec, tol: float = 0.01) -> DataFrame:
    rows = df.select(F.abs(shifts.row_lag(value, -1, spec) - F.col(nxt)).alias("gap"))
    return row_checks(rows, [Check("next", "next year's value is the next row", nxt, F.col("gap") > tol)])


def delta_coherent(df: DataFrame, value: str, lag: str, delta: str, tol: float = 0.01) -> DataFrame:
    gap = F.abs(F.col(value) - F.col(lag) - F.col(delta))
    return row_checks(df, [Check("delta", "delta is value minus lag", delta, gap > tol)])


def target_year_rules(df: DataFrame, target: str, last_year: int, spec: PanelSpec) -> DataFrame:
    """No target year in the last year; elsewhere a missing one means that the entity is absent."""
    last = row_checks(df, [Check("target year", "no target in the last year", str(last_year), (F.col(spec.year) == last_year) & F.col(target).isNotNull())])
    wrong = reconcile.present_despite_missing_target(df.where(F.col(spec.year) <= last_year), target, spec)
    one = wrong.agg(F.count(F.lit(1)).alias("bad"))
    return last.unionByName(report(one, [Check("target year", "missing target means absent", "other years", F.col("bad"))]))


def domain(df: DataFrame, cols: list[str], values: list, section: str = "domain") -> DataFrame:
    return row_checks(df, [Check(section, "values in domain", c, ~F.col(c).isin(values)) for c in cols])


def feature_cover(df: DataFrame, cols: list[str], low_year: int, min_years: int, spec: PanelSpec, good: float = 99.0, poor: float = 50.0) -> DataFrame:
    """Enough years with nearly full cover, and no poorly covered year but the known one.

    The first check speaks up only when it passes, as a fact; the second warns.
    """
    filled = reduce(lambda a, b: a + b, [profile.known(c) for c in cols])
    cover = df.groupBy(spec.year).agg(ratio(100 * F.sum(filled), F.count(F.lit(1)) * len(cols)).alias("cover"))
    one = cover.agg(
        F.sum((F.col("cover") > good).cast("bigint")).alias("good_years"),
        F.sum(((F.col("cover") < poor) & (F.col(spec.year) != low_year)).cast("bigint")).alias("poor_years"),
    )
    return report(one, [
        Check("cover", "years with full cover", f"at least {min_years}", F.greatest(F.lit(0), F.lit(min_years) - F.col("good_years")), "info"),
        Check("cover", "poorly covered years", f"only {low_year}", F.col("poor_years"), "warn"),
    ])


def published_equals(stage: DataFrame, published: DataFrame) -> DataFrame:
    one = sets.table_differences(stage, published).agg(F.coalesce(F.sum(F.abs("surplus")), F.lit(0)).alias("bad"))
    return report(one, [Check("published", "identical to the last stage", "published", F.col("bad"))])


def same_rows_per_year(df: DataFrame, upstream: DataFrame, keys: list[str], year: str) -> DataFrame:
    """Counts per year equal upstream, and so do the key sets (counts alone can hide a swap).

    With only the year as key it compares the counts.
    """
    mine = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"))
    theirs = upstream.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    both = mine.join(theirs, keys, "full").select(year, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    yearly = both.groupBy(year).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("k"))
    one = yearly.agg(F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("years"), F.sum("k").alias("keys"))
    return report(one, [Check("upstream", "rows per year", "all years", F.col("years")), Check("upstream", "same keys", "all years", F.col("keys"))])


def input_shape(rows: DataFrame, columns: int, names: str, year: str, of_file: str) -> DataFrame:
    """Every input has the expected number of columns and one year."""
    per_file = rows.groupBy(of_file).agg(
        F.max((F.size(names) != columns).cast("int")).alias("bad_columns"), (F.min(year) != F.max(year)).cast("int").alias("bad_year")
    )
    one = per_file.agg(F.sum("bad_columns").alias("c"), F.sum("bad_year").alias("y"))
    return report(one, [Check("input", "column count", str(columns), F.col("c")), Check("input", "constant year", "every file", F.col("y"))])


def id_format(df: DataFrame, c: str, pattern: str = r"^[0-9]{8}$") -> DataFrame:
    return row_checks(df, [Check("id", "format", c, ~F.col(c).rlike(pattern))])


def no_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    return row_checks(df, [Check("nulls", "no NULL", c, F.col(c).isNull()) for c in cols])


def categories_every_year(df: DataFrame, cols: list[str], spec: PanelSpec) -> DataFrame:
    """Categories that are missing in some year, per column."""
    cells = F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).cast("string").alias("v")) for c in cols])
    seen = df.select(spec.year, F.explode(cells).alias("r")).where("r.v is not null").select(spec.year, "r.*").distinct()
    years = df.select(spec.year).distinct().agg(F.count(F.lit(1)).alias("years"))
    per_value = seen.groupBy("subject", "v").agg(F.count(F.lit(1)).alias("present"))
    bad = per_value.groupBy("subject").agg(F.sum((F.col("present") < years.scalar()).cast("bigint")).alias("n_bad"))
    return bad.select(
        F.lit("categories").alias("section"), F.lit("present every year").alias("check_name"), "subject",
        F.when(F.col("n_bad") == 0, "ok").otherwise("fail").alias("status"), "n_bad",
    )


def target_cover(df: DataFrame, targets: list[str]) -> DataFrame:
    """Filled targets; the whole stage (first) must cover at least as much as its parts."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(t).alias(t) for t in targets])
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.col(t).alias("filled"), F.round(ratio(100 * F.col(t), F.col("rows")), 1).alias("filled_pct"),
                     F.when(F.col(targets[0]) >= F.col(t), "ok").otherwise("fail").alias("status"))
            for t in targets
        ]
    )
    return one.select(F.explode(cells).alias("r")).select("r.*")
