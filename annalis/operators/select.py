"""Row and column selection: universes, stage datasets, leakage checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalis import fixed_values as fv

RATE_NAME = re.compile(
    "|".join([
        *[f"{m.old_prefix}_|{m.digit}_CAT_" for m in fv.MEASURE_CODES],
        *[f"(?i:{re.escape(prefix)})" for prefix in fv.SPELLED_RATE_PREFIXES],
    ])
)


def select_rate_columns(cols: list[str]) -> list[str]:
    """Rate columns of any layout generation, by name."""
    return list(filter(RATE_NAME.match, cols))


def universe(df: DataFrame, public: str, year: str, target_year: str, first_year: int | None = None, target_years: list[int] | None = None) -> DataFrame:
    """Public rows after the first year, with a target year (optionally one of a list)."""
    out = df.where((F.col(public) == 1) & F.col(target_year).isNotNull())
    if first_year is not None:
        out = out.where(F.col(year) > first_year)
    return out.where(F.col(target_year).isin(target_years)) if target_years else out


def split_inference(df: DataFrame, target_year: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a target year, rows kept for scoring)."""
    return df.where(F.col(target_year).isNotNull()), df.where(F.col(target_year).isNull())


def stage_columns(cols: list[str], any_of: list[str], none_of: list[str] | None = None) -> list[str]:
    return [c for c in cols if any(p in c for p in any_of) and not any(p in c for p in none_of or [])]


def stage_dataset(df: DataFrame, target: str, base: list[str], any_of: list[str], none_of: list[str] | None = None) -> DataFrame:
    """Rows with the target; identification columns plus the columns of one stage."""
    cols = [c for c in stage_columns(df.columns, any_of, none_of) if c not in base]
    return df.where(F.col(target).isNotNull()).select(*base, *cols)


def feature_list(df: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted features that the table has."""
    return [c for c in wanted if c in df.columns]


def assert_no_leakage(features: list[str], targets: list[str] = fv.TARGETS) -> None:
    leaked = sorted(set(features) & set(targets))
    if leaked:
        raise ValueError(f"targets among the features: {leaked}")
