"""Linear models of all folds and sensitivity runs from one scan.

A model needs its training rows only as sums of products. These are taken once per year, over
columns that don't depend on a fold: for each number its value with NULL as 0 and a missing
flag, for each category one flag per level. The sums of a fold are those of its years added
up, without those of left-out years; filling a number with the fold's median is a linear map
of value and flag, and scaling a division of rows and columns. So every fold, every run and
every penalty is solved from the same small table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalis.operators import order
from annalis.operators.evaluate import FOLD, per_fold, test_rows
from annalis.spec import PanelSpec

#: Penalty of each model: ridge with the penalty of the study, and least squares.
PENALTIES = {"ridge": 1.0, "ols": 0.0}
MISSING = "Missing"
#: Levels of one category; the table of products grows with the square of all levels.
MAX_LEVELS = 200


@dataclass(frozen=True)
class Run:
    """Train on the years before ``fold`` (after ``first_year``, but for those of ``without``), test on ``fold``."""

    fold: int
    name: str = "all years"
    without: tuple[int, ...] = ()
    first_year: int | None = None

    def trains_on(self, year: int) -> bool:
        return year < self.fold and year not in self.without and (self.first_year is None or year > self.first_year)


@dataclass
class LinearFit:
    run: Run
    model: str
    rows: int
    intercept: float
    numeric: np.ndarray  # per number
    fills: np.ndarray
    levels: np.ndarray  # per level of all categories, in order


def category_levels(df: DataFrame, categories: list[str]) -> list[list[str]]:
    """Sorted levels of each category, NULL as MISSING; at most MAX_LEVELS each."""
    if not categories:
        return []
    cells = F.array(*[F.struct(F.lit(k).alias("k"), level_of(c).alias("v")) for k, c in enumerate(categories)])
    rows = df.select(F.explode(cells).alias("x")).select("x.*").distinct().limit(MAX_LEVELS * len(categories) + 1).collect()
    found = [sorted(r["v"] for r in rows if r["k"] == k) for k in range(len(categories))]
    for name, levels in zip(categories, found, strict=True):
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{name} has more than {MAX_LEVELS} levels")
    return found


def level_of(category: str) -> Column:
    return F.coalesce(F.col(category).cast("string"), F.lit(MISSING))


def _products(width: int, levels: list[list[str]]):
    """Sums of products per year of one batch: 1, numbers, missing flags, levels and target against each other."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2 : 2 + width]]) if width else np.zeros((batch.num_rows, 0))
            missing = np.isnan(numbers)
            flags = [np.zeros((batch.num_rows, 0))]
            for column, names in zip(batch.columns[2 + width :], levels, strict=True):
                at = pc.index_in(column, value_set=pa.array(names, column.type)).to_numpy(zero_copy_only=False)
                flags.append(np.equal.outer(at, np.arange(len(names))).astype(float))
            target = batch.columns[1].to_numpy(zero_copy_only=False)[:, None]
            all_ = np.column_stack([np.ones((batch.num_rows, 1)), np.where(missing, 0, numbers), missing, *flags, target])
            years = batch.columns[0].to_numpy()
            found = np.unique(years)
            sums = [(all_[years == y].T @ all_[years == y]).ravel() for y in found]
            yield pa.record_batch([pa.array(found, pa.int32()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], ["year", "sums"])

    return run


def yearly_products(df: DataFrame, target: str, numeric: list[str], categories: list[str], levels: list[list[str]], spec: PanelSpec) -> dict[int, np.ndarray]:
    """One symmetric table of sums per year. Tasks send one such table per batch and year, not rows."""
    cols = [F.col(spec.year).cast("int"), F.col(target).cast("double"), *[F.col(c).cast("double") for c in numeric], *[level_of(c) for c in categories]]
    named = df.select(*[c.alias(f"c{k}") for k, c in enumerate(cols)])
    sums = named.mapInArrow(_products(len(numeric), levels), "year int, sums array<double>")
    total = sums.select("year", F.posexplode("sums").alias("at", "s")).groupBy("year", "at").agg(F.sum("s").alias("s"))
    by_year: dict[int, dict[int, float]] = {}
    for r in total.collect():
        by_year.setdefault(r["year"], {})[r["at"]] = r["s"]
    size = 2 + 2 * len(numeric) + sum(map(len, levels))
    return {y: np.array([s[k] for k in range(size * size)]).reshape(size, size) for y, s in by_year.items()}


def run_medians(df: DataFrame, numeric: list[str], runs: list[Run], spec: PanelSpec) -> dict[tuple[int, str], float]:
    """Exact training medians of every run. Values are counted per year; only counts are copied to the runs."""
    if not numeric:
        return {}
    counted = order.tally(order.stacked(df, [spec.year], numeric), [spec.year, "column"], "value")
    year = F.col(spec.year)
    mine = [F.when((year < r.fold) & ~year.isin(*r.without, -1) & (year > F.lit(r.first_year if r.first_year is not None else -(1 << 31))), F.lit(k)) for k, r in enumerate(runs)]
    spread = counted.withColumn("run", F.explode(F.filter(F.array(*mine), lambda x: x.isNotNull())))
    summed = spread.groupBy("run", "column", "value").agg(F.sum("n").alias("n"))
    rows = order.quantiles_of_counts(summed, ["run", "column"], "value", {"median": 0.5}).collect()
    return {(r["run"], r["column"]): r["median"] for r in rows}


def solve(products: np.ndarray, fills: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of filled numbers and levels. Numbers are scaled by their deviation before the penalty.

    Columns that are constant in training, such as an unseen level, get 0.
    """
    p, size = len(fills), len(products)
    fill = np.zeros((size - p, size))
    fill[0, 0] = 1
    fill[np.arange(1, p + 1), np.arange(1, p + 1)] = 1
    fill[np.arange(1, p + 1), np.arange(p + 1, 2 * p + 1)] = fills
    fill[np.arange(p + 1, size - p), np.arange(2 * p + 1, size)] = 1
    sums = fill @ products @ fill.T
    n = sums[0, 0]
    means = sums[0] / n
    spread = (sums - n * np.outer(means, means))[1:, 1:]
    x, xy = spread[:-1, :-1], spread[:-1, -1]
    noise = 1e-12 * np.maximum(np.diag(sums)[1:-1], 1)
    live = np.diag(x) > noise
    scale = np.ones(len(xy))
    scale[:p] = np.where(live[:p], np.sqrt(np.maximum(np.diag(x)[:p], 0) / n), 1)
    scaled = (x / np.outer(scale, scale))[np.ix_(live, live)]
    beta = np.zeros(len(xy))
    wanted = (xy / scale)[live]
    if penalty:
        beta[live] = np.linalg.solve(scaled + penalty * np.eye(live.sum()), wanted)
    else:
        beta[live] = np.linalg.lstsq(scaled, wanted, rcond=1e-10)[0]
    beta /= scale
    return float(means[-1] - beta @ means[1:-1]), beta


def fit_all(
    df: DataFrame, target: str, numeric: list[str], categories: list[str], runs: list[Run], spec: PanelSpec,
    penalties: dict[str, float] | None = None, min_train: int = 1,
) -> tuple[list[LinearFit], list[list[str]]]:
    """Every model of every run, and the levels of the categories. Runs with fewer than ``min_train`` training rows are left out."""
    rows = df.where(order.known(target))
    levels = category_levels(rows, categories)
    products = yearly_products(rows, target, numeric, categories, levels, spec)
    medians = run_medians(rows, numeric, runs, spec)
    fits = []
    for k, run in enumerate(runs):
        mine = [m for year, m in sorted(products.items()) if run.trains_on(year)]
        if not mine or sum(m[0, 0] for m in mine) < min_train:
            continue
        total = reduce(np.add, mine)
        fills = np.array([medians.get((k, c), 0.0) for c in numeric])
        for name, penalty in (penalties or PENALTIES).items():
            intercept, beta = solve(total, fills, penalty)
            fits.append(LinearFit(run, name, int(total[0, 0]), intercept, beta[: len(numeric)], fills, beta[len(numeric) :]))
    return fits, levels


def predict(df: DataFrame, target: str, numeric: list[str], categories: list[str], fits: list[LinearFit], levels: list[list[str]], spec: PanelSpec) -> DataFrame:
    """Test rows of all runs: fold, run, model, entity, y, pred. An unseen level adds nothing."""
    rows = [(f.run.fold, f.run.name, f.model, f.intercept, f.numeric.tolist(), f.fills.tolist(), f.levels.tolist()) for f in fits]
    spark = df.sparkSession
    known = spark.createDataFrame(rows, f"{FOLD} int, run string, model string, _b0 double, _b array<double>, _fill array<double>, _level array<double>")
    test = test_rows(df.where(order.known(target)), sorted({f.run.fold for f in fits}), spec).join(per_fold(known), FOLD)

    def number(k: int, c: str) -> Column:
        value = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        return F.get("_b", F.lit(k)) * F.coalesce(value, F.get("_fill", F.lit(k)))

    parts, first = [number(k, c) for k, c in enumerate(numeric)], 0
    for c, names in zip(categories, levels, strict=True):
        at = F.array_position(F.array(*[F.lit(v) for v in names]), level_of(c)).cast("int")
        parts.append(F.when(at > 0, F.get("_level", at - 1 + first)).otherwise(0.0))
        first += len(names)
    pred = reduce(lambda a, b: a + b, parts, F.col("_b0"))
    return test.select(FOLD, "run", "model", spec.entity, F.col(target).cast("double").alias("y"), pred.alias("pred"))


def walk_forward(
    df: DataFrame, target: str, numeric: list[str], categories: list[str], runs: list[Run], spec: PanelSpec,
    penalties: dict[str, float] | None = None, min_train: int = 1,
) -> DataFrame:
    """Predictions of all linear models for the test rows of all runs, from one scan of the training rows."""
    fits, levels = fit_all(df, target, numeric, categories, runs, spec, penalties, min_train)
    return predict(df, target, numeric, categories, fits, levels, spec)
