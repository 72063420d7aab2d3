"""Joins on the panel key with checks, and comparison of two sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalis.functions.scalar import normalise_id, to_number_lenient
from annalis.operators.profile import as_rows
from annalis.spec import PanelSpec


class RepeatedKeyError(ValueError):
    """A side of a one-to-one join has a repeated key."""


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: list[str], label: str) -> None:
    """Stop when a key repeats. Only one example row reaches the driver."""
    example = repeated_keys(df, keys).limit(1).collect()
    if example:
        raise RepeatedKeyError(f"{label}: key {keys} repeats, for example {example[0].asDict()}")


def enrich_left_1to1(df: DataFrame, features: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Left join on a key that is unique on both sides; the rows of ``df`` stay as they are."""
    if check:
        assert_unique(df, keys, "left side")
        assert_unique(features, keys, "right side")
    return df.join(features, keys, "left")


def join_1to1(df: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on a key that is unique on both sides, proved inside the join itself.

    Both sides are stacked and grouped by the key in one shuffle; a group holds at most one
    row of a side, or the job stops with the key's name. No job runs before the result is
    asked for. A key with a NULL part has no partner, but may not repeat either.
    """
    cols, extra = [c for c in df.columns if c not in keys], [c for c in features.columns if c not in keys]

    def side(rows: DataFrame, names: list[str], label: str) -> DataFrame:
        return rows.select(*keys, F.struct(F.lit(True).alias("_in"), *[F.col(c).alias(f"{label}{i}") for i, c in enumerate(names)]).alias(label))

    both = side(df, cols, "_l").unionByName(side(features, extra, "_r"), allowMissingColumns=True)
    met = both.groupBy(*keys).agg(
        *[F.count(s).alias(f"{s}_n") for s in ("_l", "_r")], *[F.first(s, ignorenulls=True).alias(s) for s in ("_l", "_r")]
    )
    repeats = (F.col("_l_n") > 1) | (F.col("_r_n") > 1)
    shown = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    stop = F.raise_error(F.concat(F.lit(f"one-to-one join: key {', '.join(keys)} repeats, for example "), shown))
    kept = met.where(F.when(repeats, stop.cast("boolean")).otherwise(F.col("_l_n") > 0))
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return kept.select(
        *keys,
        *[F.col(f"_l._l{i}").alias(c) for i, c in enumerate(cols)],
        *[F.when(complete, F.col(f"_r._r{i}")).alias(c) for i, c in enumerate(extra)],
    )


def join_blocks(base: DataFrame, blocks: list[DataFrame], keys: list[str], check: bool = True) -> DataFrame:
    return reduce(lambda left, right: enrich_left_1to1(left, right, keys, check), blocks, base)


def attach_attributes(pred: DataFrame, attributes: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Attributes of the panel rows next to their predictions."""
    return pred.join(attributes.select(*keys, *cols), keys, "left")


def null_mismatch(a: Column, b: Column) -> Column:
    return F.sum((a.isNull() != b.isNull()).cast("bigint"))


def reconcile(
    df: DataFrame, other: DataFrame, cols: list[str], keys: list[str], tol: float = 1e-9, only: dict[str, Column] | None = None
) -> DataFrame:
    """Per column: rows where only one side is NULL and rows where the known values differ.

    ``only`` limits single columns to some rows, for instance lags to the years after the first.
    """
    theirs = other.select(*keys, *[F.col(c).alias(f"{c}__other") for c in cols])
    joined = df.select(*keys, *cols).join(theirs, keys)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    sums = [F.count(F.lit(1)).alias("common_rows")]
    for c in cols:
        a, b = F.col(c), F.col(f"{c}__other")
        keep = (only or {}).get(c, F.lit(True))
        differs = (F.abs(a.cast("double") - b.cast("double")) > tol) if c in numeric else (a != b)
        sums.append(F.sum((keep & (a.isNull() != b.isNull())).cast("bigint")).alias(f"na|{c}"))
        sums.append(F.sum(F.coalesce(keep & differs, F.lit(False)).cast("bigint")).alias(f"dif|{c}"))
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col("common_rows"),
            F.coalesce(F.col(f"`na|{c}`"), F.lit(0)).alias("null_mismatch"), F.coalesce(F.col(f"`dif|{c}`"), F.lit(0)).alias("value_mismatch"),
        )
        for c in cols
    ]
    return as_rows(joined.agg(*sums), [], cells)


def reconcile_mapped(
    mine: DataFrame, official: DataFrame, mapping: dict[str, str], year: str, my_id: str, official_id: str, tol: float = 0.01
) -> DataFrame:
    """Compare mapped columns per year on normalised ids: values compared, different ones, largest difference.

    ``mapping`` gives, per official column, the column of mine. Columns without a pair of
    known values in a year do not appear.
    """

    names = sorted(mapping)

    def wide(df: DataFrame, key: str, source: dict[str, str], mark: str) -> DataFrame:
        cells = [to_number_lenient(F.col(f"`{source[n]}`")).alias(f"{mark}|{n}") for n in names]
        return df.select(F.col(year), normalise_id(key).alias("_id"), *cells).where(F.col("_id").isNotNull())

    # The rows are joined as they are and compared column by column in one aggregate, so that
    # the shuffle carries each row once and not once per column.
    both = wide(mine, my_id, mapping, "a").join(wide(official, official_id, {n: n for n in names}, "b"), [year, "_id"])
    sums = []
    for n in names:
        gap = F.abs(F.col(f"`a|{n}`") - F.col(f"`b|{n}`"))
        sums += [F.count(gap).alias(f"n|{n}"), F.sum((gap > tol).cast("bigint")).alias(f"d|{n}"), F.max(gap).alias(f"g|{n}")]
    cells = [
        F.struct(F.lit(n).alias("column"), F.col(f"`n|{n}`").alias("compared"), F.col(f"`d|{n}`").alias("different"), F.col(f"`g|{n}`").alias("largest"))
        for n in names
    ]
    return as_rows(both.groupBy(year).agg(*sums), [year], cells).where(F.col("compared") > 0)


def key_set_diff(a: DataFrame, b: DataFrame, year: str, key: str, examples: int = 5) -> DataFrame:
    """Per year: keys only in a, only in b, in both, with the first few of each side."""
    mine = a.select(year, F.col(key).alias("k")).where("k is not null").distinct().withColumn("_a", F.lit(1))
    theirs = b.select(year, F.col(key).alias("k")).where("k is not null").distinct().withColumn("_b", F.lit(1))
    both = mine.join(theirs, [year, "k"], "full")
    side = F.when(F.col("_b").isNull(), "a").when(F.col("_a").isNull(), "b").otherwise("both")
    sided = both.select(year, "k", side.alias("side"))
    counts = sided.groupBy(year).agg(*[F.sum((F.col("side") == s).cast("bigint")).alias(n) for s, n in (("a", "only_a"), ("b", "only_b"), ("both", "common"))])
    from annalis.operators import order

    firsts = order.top_k(sided.where(F.col("side") != "both"), [year, "side"], "k", examples, [], ascending=True)
    shown = firsts.groupBy(year).agg(
        *[F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("k"))))).alias(n) for s, n in (("a", "examples_a"), ("b", "examples_b"))]
    )
    return counts.join(shown, year, "left").withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("examples_a", "examples_b")})


def equal_columns(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Largest difference and NULL mismatches of column pairs that must agree."""
    one = df.agg(
        *[F.max(F.abs(F.col(a) - F.col(b))).alias(f"gap|{a}") for a, b in pairs],
        *[null_mismatch(F.col(a), F.col(b)).alias(f"na|{a}") for a, b in pairs],
    )
    cells = [
        F.struct(
            F.lit(a).alias("column"), F.lit(b).alias("mapped"),
            F.col(f"`gap|{a}`").alias("largest_gap"), F.col(f"`na|{a}`").alias("null_mismatch"),
        )
        for a, b in pairs
    ]
    return as_rows(one, [], cells)


def assert_equal_columns(df: DataFrame, pairs: list[tuple[str, str]], tol: float = 1e-9) -> None:
    bad = equal_columns(df, pairs).where((F.coalesce("largest_gap", F.lit(0.0)) >= tol) | (F.col("null_mismatch") > 0)).collect()
    if bad:
        raise ValueError(f"mapping disagrees: {[r.asDict() for r in bad]}")


def present_despite_missing_target(df: DataFrame, target: str, spec: PanelSpec) -> DataFrame:
    """Rows without a target year whose entity does have a row in the next year; must be empty.

    The keys of a whole panel compress to a small file, which Spark would broadcast; they are
    merged instead, so that a task holds no more than its own range of keys.
    """
    nexts = df.select((F.col(spec.year) - 1).alias(spec.year), spec.entity).hint("merge")
    return df.where(F.col(target).isNull()).join(nexts, spec.keys, "left_semi")


def entity_lookup(df: DataFrame, entity_values: DataFrame, entity: str) -> DataFrame:
    """Map an entity-level table back to the rows."""
    return df.join(entity_values, entity, "left")


def compare_with_official(own: DataFrame, official: DataFrame, keys: list[str], value: str, official_value: str) -> DataFrame:
    return own.join(official, keys).withColumn("difference", F.col(value) - F.col(official_value))


def map_columns(mine: DataFrame, official: DataFrame) -> DataFrame:
    """Column of mine for every official column: same name first, otherwise the first one,
    by position, with the same semantic key. Inputs have (column, ordinal, key)."""
    by_name = official.select("column").join(mine.select(F.col("column").alias("mine")), F.col("column") == F.col("mine"))
    first = mine.where(F.col("key").isNotNull()).groupBy("key").agg(F.min_by("column", "ordinal").alias("mine"))
    by_key = official.where(F.col("key").isNotNull()).join(first, "key").select("column", "mine")
    both = by_name.select("column", "mine", F.lit(1).alias("priority")).unionByName(by_key.withColumn("priority", F.lit(2)))
    return both.groupBy("column").agg(F.min_by("mine", "priority").alias("mine"), F.min("priority").alias("priority"))
