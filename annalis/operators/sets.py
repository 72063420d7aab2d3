"""Unions over years and set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_years(parts: list[DataFrame]) -> DataFrame:
    """Years with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_drifting(parts: list[DataFrame]) -> DataFrame:
    """Years with different columns: the union of the columns in order of first appearance."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b.distinct(), a.columns, "left_anti")


def domain_violations(df: DataFrame, cols: list[str], domain: list) -> DataFrame:
    """Known values outside a closed domain, per column: one aggregate."""
    one = df.agg(*[F.sum((~F.col(c).isin(domain)).cast("bigint")).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("outside")) for c in cols])
    return one.select(F.explode(cells).alias("r")).select("r.*")


def table_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, counted with repetition, that only one of two tables has. Empty when they are equal.

    One grouped count over the union instead of two set differences.
    """
    if a.columns != b.columns:
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")
    cols = a.columns
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("_side").alias("surplus")).where(F.col("surplus") != 0)


def tables_equal(a: DataFrame, b: DataFrame) -> bool:
    same_schema = [(f.name, f.dataType) for f in a.schema.fields] == [(f.name, f.dataType) for f in b.schema.fields]
    return same_schema and table_differences(a, b).isEmpty()
