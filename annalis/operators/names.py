"""Comparison of column names and kinds of many files, on the table of ``sources.names``.

A group is what its files stand for (a year); files of one group count as one layout, and
a column that only some of them hold counts as present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalis.functions.scalar import col, semantic_key
from annalis.operators.select import RATE_NAME


def layout(names: DataFrame, group: str) -> DataFrame:
    """One row per group and column: first position, kind ('mixed' when its files differ) and files that hold it."""
    kind = F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed")
    return names.groupBy(group, "column").agg(F.min("ordinal").alias("ordinal"), kind.alias("kind"), F.count_distinct("file").alias("files"))


def is_rate_name(name: Column | str) -> Column:
    """Rate columns of any layout generation."""
    return col(name).rlike(f"(?u)^(?:{RATE_NAME.pattern})")


def map_to_layout(groups: DataFrame, official: DataFrame, group: str) -> DataFrame:
    """Column of every group for each official column: the same name first (priority 1), else
    the first by position with the same semantic key (2). Columns without a match give no row.
    ``official`` has one row per column."""
    mine = groups.select(group, F.col("column").alias("mine"), "ordinal")
    wanted = official.select("column", semantic_key("column").alias("_key"))
    same = mine.join(wanted, F.col("mine") == F.col("column")).select(group, "column", "mine", "ordinal", F.lit(1).alias("priority"))
    keyed = mine.withColumn("_key", semantic_key("mine")).where(F.col("_key").isNotNull())
    alike = keyed.join(wanted, "_key").select(group, "column", "mine", "ordinal", F.lit(2).alias("priority"))
    best = same.unionByName(alike).groupBy(group, "column").agg(F.min_by(F.struct("mine", "priority"), F.struct("priority", "ordinal", "mine")).alias("_b"))
    return best.select(group, "column", "_b.*")


def leaked_columns(features: DataFrame, targets: DataFrame, group: str) -> DataFrame:
    """(group, column) of the features of a group that are targets of any group."""
    return features.select(group, "column").distinct().join(targets.select("column"), "column", "left_semi").select(group, "column")


def _each_expected(groups: DataFrame, group: str, expected: dict[str, str]) -> DataFrame:
    """Every group with every expected (column, kind): a literal list, so no join of pairs."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("expected")) for c, k in expected.items()]))
    return groups.select(group).distinct().select(group, cells.alias("_x")).select(group, "_x.*")


def kind_contract(groups: DataFrame, group: str, expected: dict[str, str]) -> DataFrame:
    """Per group and expected column: expected and found kind (NULL when absent) and status ok or fail."""
    found = groups.select(group, "column", F.col("kind").alias("found"))
    both = _each_expected(groups, group, expected).join(found, [group, "column"], "left")
    return both.withColumn("status", F.when(F.col("found").eqNullSafe(F.col("expected")), "ok").otherwise("fail"))


def column_contract(groups: DataFrame, group: str, expected: list[str]) -> DataFrame:
    """(group, column, 'missing' or 'extra'): how the columns of a group differ from the expected ones."""
    wanted = _each_expected(groups, group, dict.fromkeys(expected, ""))
    missing = wanted.join(groups, [group, "column"], "left_anti").select(group, "column", F.lit("missing").alias("difference"))
    extra = groups.where(~F.col("column").isin(expected)).select(group, "column", F.lit("extra").alias("difference"))
    return missing.unionByName(extra)
