"""Diagnostics of one stage of schooling: size, structure, forecasts, lists and cohorts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalis import fixed_values as fv
from annalis.operators import evaluate as ev
from annalis.operators import ranking, shifts, structure
from annalis.session import staged
from annalis.spec import PanelSpec


@dataclass(frozen=True)
class StageColumns:
    """Columns of one stage of schooling and the years of the study."""

    name: str
    dropout: str
    approval: str
    failure: str
    size: str
    covariate: str
    years: tuple[int, ...]
    folds: tuple[int, ...]
    list_size: int = fv.LIST_SIZE
    recent_from: int = 2022


def strata(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Strata from the census flags, the capital's code and the location."""
    known = F.col("IN_EDUCACAO_INDIGENA").isNotNull()
    marked = (F.coalesce(F.col("IN_EDUCACAO_INDIGENA") == 1, F.lit(False)) | F.coalesce(F.col("TP_LOCALIZACAO_DIFERENCIADA") == 2, F.lit(False)))
    return structure.stratify(
        panel, F.when(known, marked), F.col("CO_MUNICIPIO") == fv.CAPITAL_TOWN, F.col("LOCALIZACAO") == fv.URBAN_LOCATION, spec
    )


def forecast_columns(counts: DataFrame, rate: str, spec: PanelSpec) -> DataFrame:
    """Values one and two years ahead, and the history up to each row."""
    ahead = {
        f"{new}{h}": shifts.guarded_lead(c, h, spec)
        for h in (1, 2)
        for c, new in ((rate, "y"), ("dropouts", "b"), ("n_use", "n_next"))
    }
    history = {"m3": shifts.recent_mean(rate, 3, spec), "mexp": shifts.expanding_mean(rate, spec)}
    return shifts.cumulative_rate(counts.withColumns({**ahead, **history}), "dropouts", "n_use", spec)


def diagnose(panel: DataFrame, cols: StageColumns, spec: PanelSpec, stratum: str = "ESTRATO", special: str = "INDIG_E") -> dict[str, DataFrame]:
    """All result tables of one stage, by name. ``panel`` holds the public rows with strata.

    The counts, the forecast columns and the fold scores are written once; every table
    below reads them.
    """
    d = staged(structure.counts(panel, cols.approval, cols.failure, cols.dropout, cols.size), "counts")
    last = max(cols.years)
    now = d.where(F.col(spec.year) == last).withColumn("scope", F.lit("all"))
    out = {
        "size_distribution": structure.size_distribution(d, cols.size),
        "strata_last_year": structure.stratum_shares(now, stratum, cols.size, ["scope"]),
        "denominators": structure.denominator_ratio(d, cols.size),
        "series": structure.weighted_series(d, cols.dropout, [spec.year]),
        "series_by_stratum": structure.stratum_year_matrix(d, stratum, spec.year, list(cols.years)),
        "rate_and_count_lists": ranking.rate_vs_count_lists(now, ["scope"], cols.dropout, "dropouts", "n_use", special, [spec.entity], cols.list_size),
        "pareto": structure.pareto_cut(now, ["scope"], "dropouts", [0.5, 0.8]),
        "spearman_years": structure.spearman_year_matrix(d, cols.dropout, spec),
        "variance": structure.variance_budget(d.where(F.col(spec.year) >= cols.recent_from), cols.dropout, spec),
    }
    recent = [y for y in cols.years if y >= cols.recent_from]
    out["persistent_zeros"] = structure.persistent_zeros(d.where(F.col(spec.year).isin(recent)), cols.dropout, len(recent), spec)
    f = staged(forecast_columns(d, cols.dropout, spec), "forecast").withColumnRenamed(special, "ever_special")
    test = staged(ev.fold_scores(f, cols.dropout, cols.covariate, list(cols.folds), min(cols.years), spec), "scores")
    long = staged(ev.score_list(test, ev.strategy_columns(cols.dropout), spec), "score-list")
    k, ties = cols.list_size, [spec.entity]
    expected = test.withColumn("expected", F.round(F.col("eb") * F.col("n_use"), ev.SCORE_DIGITS))
    common = (["fold"], "b1", "n_next1", "ever_special", stratum, fv.STRATUM_CAPITAL)
    out["strategies"] = ev.score_strategies(long, k, spec)
    out["best_and_random"] = ranking.oracle_and_random(test, ["fold"], "y1", "b1", "n_next1", "ever_special", ties, k)
    out["frontier"] = ranking.frontier_summary(
        ranking.rate_count_lists(test, ["fold"], "eb", "n_use", fv.FRONTIER_POWERS, k, ties), test, ["fold", "power"], *common
    )
    out["quotas"] = ranking.frontier_summary(
        ranking.stratum_quota(expected, ["fold"], stratum, "expected", k, ties), expected, ["fold", "weighting"], *common
    )
    out["two_year_horizon"] = ev.two_year_horizon(f, cols.dropout, list(cols.folds), min(cols.years), k, spec)
    out["regression_to_mean"] = ranking.regression_to_mean(test, ["fold"], cols.dropout, "y1", k, ties)
    return out
