"""Delimited text files with drifting headers, and the census features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalis import fixed_values as fv
from annalis.functions.scalar import coalesce_candidates, to_number_lenient


def sniff_delimiter(spark: SparkSession, path: str, seps: tuple[str, ...] = (";", ",", "|"), min_cols: int = 5) -> str | None:
    """First separator that splits the first line into enough columns. Reads one line."""
    line = spark.read.text(path).first()
    return next((s for s in seps if line and len(line[0].split(s)) >= min_cols), None)


def scan_delimited(spark: SparkSession, path: str, sep: str, encoding: str = "ISO-8859-1", columns: list[str] | None = None) -> DataFrame:
    """All columns as text. Column selection and filters reach the reader."""
    df = spark.read.csv(path, sep=sep, encoding=encoding, header=True, inferSchema=False)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def read_base_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ";") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, schema=schema)


def detect_scope_column(cols: list[str]) -> tuple[str | None, str | None]:
    """State column by name: letter codes first, then numeric codes."""
    for names, mode in ((fv.STATE_LETTER_COLUMNS, "letters"), (fv.CENSUS_STATE_NUMBER_COLUMNS, "number")):
        for c in cols:
            if c.upper() in names:
                return c, mode
    return None, None


def detect_id_by_name(cols: list[str]) -> str | None:
    return next((c for c in cols if c.upper() in fv.CENSUS_ID_COLUMNS), None)


def in_scope(column: str, mode: str) -> Column:
    if mode == "letters":
        return F.trim(F.upper(F.col(f"`{column}`"))) == fv.SCOPE_STATE
    return to_number_lenient(F.col(f"`{column}`")) == fv.SCOPE_STATE_NUMBER


def feature_columns(available: list[str], features: dict[str, list[str]] = fv.CENSUS_FEATURES) -> list[Column]:
    return [coalesce_candidates(cands, available).alias(name) for name, cands in features.items()]


def census_year(df: DataFrame, year: int, features: dict[str, list[str]] = fv.CENSUS_FEATURES) -> DataFrame:
    """Feature rows of one census year: scope filter and candidate columns in one scan."""
    return census_rows(df, F.lit(year), features)


def census_rows(df: DataFrame, year: Column, features: dict[str, list[str]] = fv.CENSUS_FEATURES) -> DataFrame:
    """Feature rows of all years that share the columns of ``df``, in one scan; ``year`` is the year of a row.

    A candidate that a year's file lacks is NULL in its rows, so that the next one counts.
    """
    scope, mode = detect_scope_column(df.columns)
    key = detect_id_by_name(df.columns)
    if scope is None or key is None:
        raise ValueError(f"no state or id column among {df.columns[:5]}")
    rows = df.where(in_scope(scope, mode))
    return rows.select(year.cast("int").alias("ANO"), F.trim(F.col(f"`{key}`")).alias("CO_ENTIDADE"), *feature_columns(df.columns, features))


def assemble_year(main: DataFrame, sides: list[DataFrame], key: str) -> DataFrame:
    """Left join of side tables, each adding only the columns that are not there yet."""

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        new = [c for c in right.columns if c not in left.columns]
        return left.join(right.select(key, *new), key, "left")

    return reduce(add, sides, main)


def position_rename(
    df: DataFrame, year: int, keep: list[Column], new: list[str] = fv.SEGMENTS_NEW, old: list[str] = fv.SEGMENTS_OLD,
    prefixes: list[tuple[str, str, str]] = fv.SEGMENT_PREFIXES, first_new_year: int = fv.FIRST_YEAR_OF_NEW_SEGMENTS,
) -> DataFrame:
    """Rate columns of one year under common names; old and new lists match by position."""
    cells = [
        to_number_lenient(F.col(f"`{pn + n if year >= first_new_year else pv + v}`")).alias(f"{short}_{n}")
        for pn, pv, short in prefixes
        for n, v in zip(new, old)
    ]
    return df.select(F.lit(year).alias("ANO"), *keep, *cells)


def position_rename_all(
    df: DataFrame, year: Column, keep: list[Column], new: list[str] = fv.SEGMENTS_NEW, old: list[str] = fv.SEGMENTS_OLD,
    prefixes: list[tuple[str, str, str]] = fv.SEGMENT_PREFIXES, first_new_year: int = fv.FIRST_YEAR_OF_NEW_SEGMENTS,
) -> DataFrame:
    """Rate columns of all years under common names, in one scan of a table that holds both generations of names.

    A generation whose column is not there gives NULL.
    """
    there = set(df.columns)
    cell = lambda name: F.col(f"`{name}`") if name in there else F.lit(None).cast("string")
    cells = [
        to_number_lenient(F.when(year >= first_new_year, cell(pn + n)).otherwise(cell(pv + v))).alias(f"{short}_{n}")
        for pn, pv, short in prefixes
        for n, v in zip(new, old)
    ]
    return df.select(year.cast("int").alias("ANO"), *keep, *cells)
