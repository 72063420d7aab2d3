"""The panel build: raw sheets -> selected -> longitudinal -> census features -> base.

Each stage is a lazy DataFrame written once; later stages read the written table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalis import fixed_values as fv
from annalis.functions.scalar import flag_any_present, flag_public
from annalis.operators import quality, reconcile, sets, shifts
from annalis.session import staged
from annalis.sources import delimited, layouts, raw, stages
from annalis.spec import PanelSpec

SPEC = PanelSpec()
IDENTITY = ["NO_ENTIDADE", "CO_MUNICIPIO", "NO_MUNICIPIO", "LOCALIZACAO", "DEPENDENCIA"]
SELECTED = ["ANO", "CO_ENTIDADE", *IDENTITY, *layouts.rate_names()]
LONGITUDINAL = [
    "ANO", "ANO_ALVO", "CO_ENTIDADE", *IDENTITY, "REDE_PUBLICA", "DISP_REND", *layouts.rate_names(),
    *[f"{c}_LAG1" for c in fv.LAG_COLUMNS], *[f"{c}_DELTA1" for c in fv.DELTA_COLUMNS], *[f"{c}_T1" for c in fv.NEXT_COLUMNS],
]


@dataclass(frozen=True)
class Stages:
    """Paths of the stage tables below one folder."""

    root: str

    @property
    def scope(self) -> str:
        return f"{self.root}/01_raw_scope"

    @property
    def stats(self) -> str:
        return f"{self.root}/01_ingest_stats"

    @property
    def selected(self) -> str:
        return f"{self.root}/02a_selected"

    @property
    def longitudinal(self) -> str:
        return f"{self.root}/02b_longitudinal"

    @property
    def census(self) -> str:
        return f"{self.root}/03_census_features"

    @property
    def base(self) -> str:
        return f"{self.root}/04_base"

    @property
    def published(self) -> str:
        return f"{self.root}/base_current"


def ingest(raw_cells: DataFrame, out: Stages, year: str = "year") -> tuple[DataFrame, DataFrame]:
    """Stage 01: rows of the state from all sheets, with the staged names per sheet."""
    cells = raw.normalise_mixed_types(raw_cells)
    headers = staged(raw.build_header_names(cells, raw.detect_header(cells), year), "headers")
    layouts.assert_label(headers, year)
    rows = raw.data_rows(cells, headers)
    scope = staged(raw.scope_per_sheet(rows, headers), "scope")
    stages.write_stage(raw.filter_entity_scope(rows, scope), out.scope, partition_by=year)
    stages.write_stage(raw.ingest_stats(rows, headers, scope), out.stats)
    return stages.read_stage(raw_cells.sparkSession, out.scope), headers


def select(rows: DataFrame, headers: DataFrame, out: Stages, year: str = "year") -> DataFrame:
    """Stage 02a: the harmonised panel of 19 columns; keys must be unique."""
    stages.write_stage(layouts.harmonise(rows, headers, year).select(*SELECTED), out.selected)
    selected = stages.read_stage(rows.sparkSession, out.selected)
    reconcile.assert_unique(selected, SPEC.keys, "selected")
    return selected


def derive(selected: DataFrame, out: Stages) -> DataFrame:
    """Stage 02b: flags, exact-year lags, changes and next-year targets (30 columns)."""
    flagged = selected.withColumns(
        {"REDE_PUBLICA": flag_public("DEPENDENCIA"), "DISP_REND": flag_any_present(layouts.rate_names())}
    )
    panel = shifts.longitudinal(flagged, fv.LAG_COLUMNS, fv.DELTA_COLUMNS, fv.NEXT_COLUMNS, SPEC)
    stages.write_stage(panel.select(*LONGITUDINAL), out.longitudinal)
    return stages.read_stage(selected.sparkSession, out.longitudinal)


def census(years: dict[int, DataFrame], out: Stages) -> DataFrame:
    """Stage 03: 17 binary features of all census years."""
    parts = [delimited.census_year(df, y) for y, df in sorted(years.items())]
    table = sets.union_years(parts)
    stages.write_stage(table, out.census)
    return stages.read_stage(table.sparkSession, out.census)


def enrich(longitudinal: DataFrame, features: DataFrame, out: Stages) -> DataFrame:
    """Stage 04: left join of the features, written and published."""
    key = F.trim(F.col("CO_ENTIDADE"))
    joined = reconcile.join_1to1(longitudinal.withColumn("CO_ENTIDADE", key), features.withColumn("CO_ENTIDADE", key), list(SPEC.keys))
    stages.write_stage(joined, out.base)
    return stages.publish(longitudinal.sparkSession, out.base, out.published)


def build_panel(raw_cells: DataFrame, census_years: dict[int, DataFrame], root: str, year: str = "year") -> DataFrame:
    """All stages; returns the published base."""
    out = Stages(root)
    rows, headers = ingest(raw_cells, out, year)
    longitudinal = derive(select(rows, headers, out, year), out)
    return enrich(longitudinal, census(census_years, out), out)


def validate(spark: SparkSession, root: str, years: int, last_year: int, low_year: int = 2007) -> DataFrame:
    """The validation suite over the written stages, one row per check."""
    out = Stages(root)
    published = stages.read_published(spark, out.published).drop("_all")
    sel, lon, base, rows = (
        stages.read_stage(spark, p) for p in (out.selected, out.longitudinal, out.base, out.scope)
    )
    rates = layouts.rate_names()
    features = [c for c in base.columns if c.startswith(fv.CENSUS_FEATURE_PREFIXES)]
    types = {"CO_ENTIDADE": T.StringType, "CO_MUNICIPIO": T.StringType, "ANO": T.IntegralType, **{c: T.DoubleType for c in rates}}
    parts = [
        quality.type_contract(sel, types),
        quality.exact_columns(sel, SELECTED, "selected"),
        quality.exact_columns(lon, LONGITUDINAL, "longitudinal"),
        *[quality.unique_key(df, SPEC.keys, name) for name, df in (("02a", sel), ("02b", lon), ("04", base), ("published", published))],
        quality.no_marker(base),
        quality.year_cover(sel, years, SPEC),
        quality.in_range(sel, rates),
        quality.no_nulls(sel, ["ANO", "CO_ENTIDADE", "CO_MUNICIPIO", "LOCALIZACAO", "DEPENDENCIA"]),
        quality.id_format(sel, "CO_ENTIDADE"),
        quality.categories_every_year(sel, ["LOCALIZACAO", "DEPENDENCIA"], SPEC),
        quality.lag_coherent(lon, "ABANDONO_FUN_AF", "ABANDONO_FUN_AF_LAG1", SPEC),
        quality.delta_coherent(lon, "ABANDONO_FUN_AF", "ABANDONO_FUN_AF_LAG1", "ABANDONO_FUN_AF_DELTA1"),
        quality.next_coherent(lon, "ABANDONO_FUN_AF", "ABANDONO_FUN_AF_T1", SPEC),
        quality.target_year_rules(lon, "ANO_ALVO", last_year, SPEC),
        quality.domain(lon, ["REDE_PUBLICA"], [0, 1], section="flag"),
        quality.domain(base, features, [0.0, 1.0]),
        quality.feature_cover(base, features, low_year, years - 1, SPEC),
        quality.same_rows_per_year(sel.select("ANO"), rows.select(F.col("year").alias("ANO")), ["ANO"], "ANO"),
        quality.published_equals(base, published),
    ]
    return sets.union_years(parts)
