"""Queries of the panel windows and of the joins on the panel key."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalis.catalog import adapters as ad
from annalis.catalog.adapters import SPEC
from annalis.catalog.registry import query
from annalis.functions.scalar import flag_any_present
from annalis.operators import shifts

LONG_COLUMNS = [
    "year", "target_year", "entity", "name", "town", "town_name", "location", "dependency", "public", "has_rates",
    "ap", "rp", "ab", "ap_f", "rp_f", "ab_f", "ap_o", "rp_o", "ab_o",
    "ab_LAG1", "ab_f_LAG1", "ab_o_LAG1", "ab_f_DELTA1", "ab_o_DELTA1", "ab_T1", "ab_f_T1", "ab_o_T1",
]


@query(
    "j1_exact_year_shift",
    f"""SELECT {", ".join(c for c in LONG_COLUMNS if c != "has_rates")},
    CASE WHEN coalesce({", ".join(ad.RATES)}) IS NOT NULL THEN 1 ELSE 0 END AS has_rates FROM lp""",
)
def longitudinal(spark, sf):
    return ad.longitudinal_panel(spark, sf).withColumn("has_rates", flag_any_present(ad.RATES)).select(*LONG_COLUMNS)


@query(
    "j1_exact_year_shift_gappy",
    """SELECT p.entity, p.year, p.ab, pv.ab AS ab_prev, nx.ab AS ab_next FROM cp p
    LEFT JOIN cp pv ON pv.entity = p.entity AND pv.year = p.year - 1 LEFT JOIN cp nx ON nx.entity = p.entity AND nx.year = p.year + 1""",
)
def exact_shift_gappy(spark, sf):
    p = ad.customer_panel(spark, sf)
    p = shifts.exact_year_shift(p, ["ab"], -1, "_prev", SPEC)
    return shifts.exact_year_shift(p, ["ab"], 1, "_next", SPEC).select("entity", "year", "ab", "ab_prev", "ab_next")


@query(
    "j2_target_year",
    """SELECT p.entity, p.year, CASE WHEN nx.entity IS NOT NULL THEN CAST(p.year + 1 AS INT) END AS target_year
    FROM cp p LEFT JOIN cp nx ON nx.entity = p.entity AND nx.year = p.year + 1""",
)
def target_year(spark, sf):
    return ad.customer_panel(spark, sf).select("entity", "year", shifts.target_year(SPEC).alias("target_year"))


@query(
    "w1_row_lag_lead",
    """SELECT entity, year, lag(ab, 1) OVER w AS row_lag, lead(ab, 1) OVER w AS row_lead, lag(year, 2) OVER w AS year_two_rows_back
    FROM cp WINDOW w AS (PARTITION BY entity ORDER BY year)""",
)
def row_lag_lead(spark, sf):
    return ad.customer_panel(spark, sf).select(
        "entity", "year",
        shifts.row_lag("ab", 1, SPEC).alias("row_lag"),
        shifts.row_lag("ab", -1, SPEC).alias("row_lead"),
        shifts.row_lag("year", 2, SPEC).alias("year_two_rows_back"),
    )


@query(
    "w2_guarded_lead",
    """SELECT entity, year, CASE WHEN lead(year, 1) OVER w = year + 1 THEN lead(ab, 1) OVER w END AS y1,
    CASE WHEN lead(year, 2) OVER w = year + 2 THEN lead(ab, 2) OVER w END AS y2
    FROM cp WINDOW w AS (PARTITION BY entity ORDER BY year)""",
)
def guarded_lead(spark, sf):
    return ad.customer_panel(spark, sf).select(
        "entity", "year", shifts.guarded_lead("ab", 1, SPEC).alias("y1"), shifts.guarded_lead("ab", 2, SPEC).alias("y2")
    )


@query(
    "w3_rolling_mean_rows",
    """SELECT entity, year, round(avg(ab) OVER (PARTITION BY entity ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS m3 FROM cp""",
)
def rolling_mean(spark, sf):
    return ad.customer_panel(spark, sf).select("entity", "year", F.round(shifts.rolling_mean_rows("ab", 3, SPEC), 6).alias("m3"))


@query(
    "w4_expanding_mean",
    """SELECT entity, year, round(avg(ab) OVER (PARTITION BY entity ORDER BY year ROWS UNBOUNDED PRECEDING), 6) AS mexp FROM cp""",
)
def expanding_mean(spark, sf):
    return ad.customer_panel(spark, sf).select("entity", "year", F.round(shifts.expanding_mean("ab", SPEC), 6).alias("mexp"))


@query(
    "w5_cumulative_rate",
    """SELECT entity, year, CAST(cum_count AS BIGINT) AS cum_count, CAST(cum_size AS BIGINT) AS cum_size, round(100.0 * cum_count / cum_size, 6) AS pooled FROM (
    SELECT entity, year, sum(k_ab) OVER w AS cum_count, sum(n) OVER w AS cum_size FROM sy
    WINDOW w AS (PARTITION BY entity ORDER BY year ROWS UNBOUNDED PRECEDING))""",
)
def cumulative_rate(spark, sf):
    out = shifts.cumulative_rate(ad.supplier_years(spark, sf).select("entity", "year", "k_ab", "n"), "k_ab", "n", SPEC)
    return out.select("entity", "year", "cum_count", "cum_size", F.round("pooled", 6).alias("pooled"))


@query(
    "w6_demean_within",
    "SELECT entity, year, round(ab - avg(ab) OVER (PARTITION BY year), 6) AS centred FROM sp",
)
def demean(spark, sf):
    out = shifts.demean_within(ad.supplier_panel(spark, sf), "ab", ["year"], "centred", calendar=True)
    return out.select("entity", "year", F.round("centred", 6).alias("centred"))


@query(
    "w7_delta",
    """SELECT p.entity, p.year, round(p.ab - pv.ab, 6) AS ab_delta FROM cp p LEFT JOIN cp pv ON pv.entity = p.entity AND pv.year = p.year - 1""",
)
def delta(spark, sf):
    return ad.customer_panel(spark, sf).select("entity", "year", F.round(shifts.delta("ab", SPEC), 6).alias("ab_delta"))
