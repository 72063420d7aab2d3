"""Exact order statistics that never sort a whole group in one task.

Rows are first counted per distinct value, so heavy ties (for instance a third of
all rows being zero) shrink to one row. The counts are written once and cut into as many
value ranges as there are shuffle partitions; each range is summed by its own task and
the totals of the ranges before it are added. Tables of every size take this path. NaN
counts as NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalis.functions.scalar import ratio
from annalis.session import staged

def known(value: str) -> Column:
    """Neither NULL nor NaN."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def tally(df: DataFrame, by: list[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct value that is known: ``n`` rows and the requested sums."""
    extra = [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    return df.where(known(value)).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *extra)


def value_ranges(counted: DataFrame, value: str, ranges: int | None = None) -> list[float]:
    """Cut points between ``ranges`` value ranges, by default one per shuffle partition.

    Any cut points give the same result, so approximate percentiles are enough.
    """
    n = ranges or int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / n for i in range(1, n)]
    values = counted.select(F.col(value).cast("double").alias("v"))
    return sorted(set(values.approxQuantile("v", probs, 0.5 / n))) if probs else []


def running_totals(
    counted: DataFrame, by: list[str], value: str, sums: list[str], descending: bool = False, ranges: int | None = None
) -> DataFrame:
    """Add ``before_<s>`` (sum over the values ranked before) and ``all_<s>`` per group.

    ``counted`` has one row per (group, value).
    """
    direction = F.col(value).desc() if descending else F.col(value).asc()
    counted = staged(counted, "tally")
    splits = [float("-inf"), *value_ranges(counted, value, ranges), float("inf")]
    ranged = counted.withColumn("_value", F.col(value).cast("double")).withColumn("_range", F.lit(0.0))
    if len(splits) > 2:  # else there is one value at most, or one range was asked for
        ranged = Bucketizer(splits=splits, inputCol="_value", outputCol="_range").transform(ranged.drop("_range"))
    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    group = Window.partitionBy(*by)
    earlier = group.orderBy(range_order).rowsBetween(Window.unboundedPreceding, -1)
    per_range = ranged.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_in_{s}") for s in sums])
    offsets = per_range.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_in_{s}").over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_in_{s}").over(group).alias(f"all_{s}") for s in sums],
    )
    cell = Window.partitionBy(*by, "_range").orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(s).over(cell), F.lit(0)).alias(f"_loc_{s}") for s in sums])
    return local.join(offsets, [*by, "_range"]).select(
        *counted.columns,
        *[(F.col(f"_loc_{s}") + F.col(f"_off_{s}")).alias(f"before_{s}") for s in sums],
        *[f"all_{s}" for s in sums],
    )


def quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], ranges: int | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group that has a value."""
    return quantiles_of_counts(tally(df, by, value), by, value, probs, ranges)


def quantiles_of_counts(
    counted: DataFrame, by: list[str], value: str, probs: dict[str, float], ranges: int | None = None
) -> DataFrame:
    """Quantiles from one row per (group, value) with its number of rows ``n``."""
    ordered = running_totals(counted, by, value, ["n"], ranges=ranges)

    def covers(position: Column) -> Column:
        return (F.col("before_n") <= position) & (position < F.col("before_n") + F.col("n"))

    spots = {}
    for name, q in probs.items():
        spot = F.lit(float(q)) * (F.col("all_n") - 1)
        spots[name] = (spot, F.floor(spot), F.ceil(spot))
    needed = reduce(lambda a, b: a | b, [covers(lo) | covers(hi) for _, lo, hi in spots.values()])
    picked = ordered.where(needed).groupBy(*by).agg(
        *[
            F.max(F.when(covers(edge), F.col(value).cast("double"))).alias(f"_{name}_{tag}")
            for name, (_, lo, hi) in spots.items()
            for tag, edge in (("lo", lo), ("hi", hi))
        ],
        *[F.max(spot - F.floor(spot)).alias(f"_{name}_part") for name, (spot, _, _) in spots.items()],
    )
    return picked.select(
        *by,
        *[
            (F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_part")).alias(name)
            for name in probs
        ],
    )


def stacked(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Long form (by..., column, value): numeric columns as doubles."""
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(by, cols, "column", "value")


def column_quantiles(df: DataFrame, by: list[str], cols: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of several columns in one pass: (by..., column, quantile columns)."""
    return quantiles(stacked(df, by, cols), [*by, "column"], "value", probs)


def with_average_ranks(rows: DataFrame, by: list[str], values: dict[str, str], weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """Adds to every row the rank of each value within its group; ties share their mean rank.

    ``values`` names the rank columns, ``<rank>_of`` is the size of the group. A row stands for
    ``weight`` rows. Rows where a value is NULL or NaN go. No row is joined back on a value:
    cut points split a value's range into open intervals and the cut points themselves, with
    one small table of their counts. Values are compared as doubles. Within an interval a window ranks the rows; a value with a
    large share of all rows is a cut point, whose rank follows from that table alone, so that
    its rows can be dealt to any number of tasks.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.where(reduce(lambda a, b: a & b, [known(v) for v in values]))
    rows = staged(rows if weight else rows.withColumn("_rows", F.lit(1)), "unranked")
    weight = weight or "_rows"
    typed = rows.select(*[F.col(v).cast("double").alias(f"_v{k}") for k, v in enumerate(values)])
    probs = [i / n for i in range(1, n)]
    cuts = [sorted(set(c)) for c in typed.approxQuantile(typed.columns, probs, 0.25 / n)] if probs else [[] for _ in values]
    marked = rows
    for k, (value, points) in enumerate(zip(values, cuts, strict=True)):
        cell, typed_value = f"_cell{k}", F.col(value).cast("double") + F.lit(0.0)  # negative zero is zero
        if points:
            splits = [float("-inf"), *points, float("inf")]
            marked = Bucketizer(splits=splits, inputCol=f"_v{k}", outputCol=cell).transform(marked.withColumn(f"_v{k}", typed_value)).drop(f"_v{k}")
            at_cut = typed_value == F.get(F.lit(splits), F.col(cell).cast("int"))
            marked = marked.withColumn(cell, 2 * F.col(cell).cast("int") + F.when(at_cut, 0).otherwise(1))  # the cut point before the interval above it
        else:
            marked = marked.withColumn(cell, F.lit(1))
    out = marked
    for k, (value, name) in enumerate(values.items()):
        cell = f"_cell{k}"
        inside = marked.groupBy(*by, cell).agg(F.sum(weight).alias("_in"))
        group = Window.partitionBy(*by)
        before = F.coalesce(F.sum("_in").over(group.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = inside.select(*by, cell, "_in", before.alias("_before"), F.sum("_in").over(group).alias(f"{name}_of"))
        is_cut = F.col(cell) % 2 == 0
        out = out.withColumn("_deal", F.when(is_cut, F.pmod(F.hash(*rows.columns), F.lit(n))).otherwise(0))
        place = Window.partitionBy(*by, cell, "_deal")
        upto = F.sum(weight).over(place.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        ties = F.sum(weight).over(Window.partitionBy(*by, cell, "_deal", value))
        out = out.withColumn("_local", upto - (ties - 1) / 2).join(inside, [*by, cell])
        rank = F.col("_before") + F.when(is_cut, (F.col("_in") + 1) / 2).otherwise(F.col("_local"))
        out = out.withColumn(name, rank).drop("_local", "_deal", "_in", "_before", cell)
    return out.drop("_rows")


def spearman(
    df: DataFrame, by: list[str], x: str, y: str, min_rows: int = 1, out: str = "spearman", ranges: int | None = None
) -> DataFrame:
    """Rank correlation per group over the rows where both values are known.

    NULL when a side is constant or there are fewer than ``min_rows`` rows.
    """
    pairs = (
        df.where(known(x) & known(y))
        .groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = with_average_ranks(pairs, by, {"_x": "_x_rank", "_y": "_y_rank"}, "n", ranges)
    middle = (F.col("_x_rank_of") + 1) / 2
    dx, dy = F.col("_x_rank") - middle, F.col("_y_rank") - middle
    moments = ranked.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") * dx * dy).alias("_xy"),
        F.sum(F.col("n") * dx * dx).alias("_xx"),
        F.sum(F.col("n") * dy * dy).alias("_yy"),
    )
    rho = ratio(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))
    return moments.select(*by, "rows", F.when(F.col("rows") >= min_rows, rho).alias(out))


def top_k(
    df: DataFrame, by: list[str], score: str, k: int | Column, ties: list[str], ascending: bool = False, rank: str = "position"
) -> DataFrame:
    """First ``k`` rows per group by score, ties in the order of ``ties``; NULL scores rank last.

    With a literal ``k`` Spark keeps at most k rows per group in every task before
    it shuffles (WindowGroupLimit), so a hot group stays small.
    """
    first = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    order = [first, *[F.col(t).asc() for t in ties]]
    if not by and isinstance(k, int):
        df = df.orderBy(*order).limit(k)
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, position).where(F.col(rank) <= k)
