"""Entity-year panels derived from the driver tables, and the same panels as SQL.

supplier_panel: one row per supplier and ship year (balanced, tens of items per cell).
customer_panel: one row per customer and order year (gappy, few orders per cell).
The return flag / order status plays the part of the three exclusive outcomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalis.catalog.registry import CTES
from annalis.functions.scalar import canonical_category, flag_public
from annalis.operators import shifts, structure
from annalis.session import staged
from annalis.spec import PanelSpec

SPEC = PanelSpec(entity="entity", year="year")
YEARS = list(range(1995, 2002))
FOLDS = [1997, 1998, 1999, 2000]
GRADES = [4, 5, 6, 7]
RATES = ["ap", "rp", "ab", "ap_f", "rp_f", "ab_f", "ap_o", "rp_o", "ab_o"]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{table}.parquet")


def share(k: Column, n: Column) -> Column:
    return F.round(100.0 * k / F.nullif(n, F.lit(0)), 1)


def amount(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def supplier_years(spark: SparkSession, sf: str) -> DataFrame:
    """Item counts per supplier and year; the scan reads five columns."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    outcomes = {"ap": "N", "rp": "R", "ab": "A"}
    items = read(spark, sf, "lineitem")
    return items.groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"),
        amount(status == "F").alias("n_f"),
        amount(status == "O").alias("n_o"),
        *[amount(flag == v).alias(f"k_{m}") for m, v in outcomes.items()],
        *[amount((flag == v) & (status == s)).alias(f"k_{m}_{s.lower()}") for s in "FO" for m, v in outcomes.items()],
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
    )


def supplier_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier with its nation; the nation table is joined by Spark's own size check."""
    nation = read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return (
        read(spark, sf, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("s_suppkey").alias("entity"),
            F.col("s_name").alias("name"),
            F.col("s_nationkey").cast("string").alias("town"),
            F.col("n_name").alias("town_name"),
            F.col("n_regionkey").alias("region"),
            F.when(F.col("s_acctbal") > 3000, "Urbana").otherwise("Rural").alias("location"),
            (F.col("s_nationkey") % 4).alias("dep_code"),
        )
    )


def supplier_panel(spark: SparkSession, sf: str) -> DataFrame:
    e, y = F.col("entity"), F.col("year")
    cells = supplier_years(spark, sf).join(supplier_attributes(spark, sf), "entity")
    drifting = (
        F.when(F.col("dep_code") == 0, "Federal")
        .when(F.col("dep_code") == 1, "Estadual")
        .when(F.col("dep_code") == 2, "Municipal")
        .when(y <= 1997, " Particular")
        .otherwise("Privada")
    )
    rates = {
        "ap": F.when((e + y) % 7 != 0, share(F.col("k_ap"), F.col("n"))),
        "rp": F.when((e + y) % 7 != 0, share(F.col("k_rp"), F.col("n"))),
        "ab": F.when((e + y) % 7 != 0, share(F.col("k_ab"), F.col("n"))),
    }
    for s in ("f", "o"):
        for m in ("ap", "rp", "ab"):
            value = share(F.col(f"k_{m}_{s}"), F.col(f"n_{s}"))
            rates[f"{m}_{s}"] = F.when((e + 2 * y) % 11 != 0, value) if s == "f" else value
    return cells.select(
        "entity", "year", "name", "town", "town_name", "region", "location",
        canonical_category(drifting).alias("dependency"),
        flag_public(canonical_category(drifting)).alias("public"),
        F.when((e * 3 + y) % 29 == 0, 1).otherwise(0).alias("special"),
        "n", "n_f", "n_o", "k_ab",
        F.greatest(F.lit(1), F.col("n") + (e * 7 + y) % 9 - 4).alias("enrolment"),
        *[v.alias(k) for k, v in rates.items()],
        F.round(F.col("disc") / F.col("n"), 3).alias("tdi"),
        F.round(F.col("qty") / F.col("n"), 3).alias("atu"),
    )


def customer_panel(spark: SparkSession, sf: str) -> DataFrame:
    e, y = F.col("entity"), F.col("year")
    cells = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"),
        *[amount(F.col("o_orderstatus") == v).alias(f"k_{m}") for m, v in (("ap", "F"), ("rp", "O"), ("ab", "P"))],
    )
    return cells.select(
        "entity", "year", "n",
        *[F.when((e + y) % 7 != 0, share(F.col(f"k_{m}"), F.col("n"))).alias(m) for m in ("ap", "rp", "ab")],
    )


def grade_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Drop-out rate and enrolment of four grades (line numbers), one column each."""
    e, y, g = F.col("entity"), F.col("year"), F.col("l_linenumber")
    cells = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("year")).agg(
        *[amount(g == k).alias(f"n_g{k}") for k in GRADES],
        *[amount((g == k) & (F.col("l_linestatus") == s)).alias(f"n_g{k}_{s.lower()}") for k in GRADES for s in "FO"],
        *[amount((g == k) & (F.col("l_returnflag") == "A")).alias(f"k_g{k}") for k in GRADES],
        F.count(F.lit(1)).alias("n"),
        amount(F.col("l_returnflag") == "A").alias("k_ab"),
    )
    return cells.select(
        "entity", "year",
        *[f"n_g{k}" for k in GRADES],
        *[F.expr(f"nullif(n_g{k}_{s}, 0)").alias(f"n_g{k}_{s}") for k in GRADES for s in "fo"],
        *[F.when((e + y + k) % 13 != 0, share(F.col(f"k_g{k}"), F.col(f"n_g{k}"))).alias(f"ab_g{k}") for k in GRADES],
        share(F.col("k_ab"), F.col("n")).alias("ab"),
        F.when(e % 10 == 3, 0).otherwise(1).alias("public"),
    )


def longitudinal_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The supplier panel with lag, change, next-year values and target year."""
    cols = ["ab", "ab_f", "ab_o"]
    return shifts.longitudinal(supplier_panel(spark, sf), cols, ["ab_f", "ab_o"], cols, SPEC, target="target_year")


def strata_panel(spark: SparkSession, sf: str) -> DataFrame:
    return structure.stratify(
        supplier_panel(spark, sf),
        F.col("special") == 1,
        F.col("region") == 0,
        F.col("location") == "Urbana",
        SPEC,
        out="stratum",
        ever="ever_special",
    )


def counts_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Public rows with the reconstructed denominator and counts."""
    return structure.counts(strata_panel(spark, sf).where(F.col("public") == 1), "ap", "rp", "ab", "enrolment")


def forecast_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Counts panel with next-year values (h = 1, 2) and running history."""
    d = counts_panel(spark, sf)
    ahead = {
        f"{new}{h}": shifts.guarded_lead(c, h, SPEC)
        for h in (1, 2)
        for c, new in (("ab", "y"), ("dropouts", "b"), ("n_use", "n_next"))
    }
    d = d.withColumns({**ahead, "m3": shifts.recent_mean("ab", 3, SPEC), "mexp": shifts.expanding_mean("ab", SPEC)})
    return shifts.cumulative_rate(d, "dropouts", "n_use", SPEC)


def staged_supplier(spark: SparkSession, sf: str) -> DataFrame:
    return staged(supplier_panel(spark, sf), "panel")


def staged_longitudinal(spark: SparkSession, sf: str) -> DataFrame:
    return staged(longitudinal_panel(spark, sf), "longitudinal")


def staged_counts(spark: SparkSession, sf: str) -> DataFrame:
    return staged(counts_panel(spark, sf), "counts")


def staged_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return staged(forecast_panel(spark, sf), "forecast")


def _sql_share(k: str, n: str) -> str:
    return f"round(100.0 * {k} / nullif({n}, 0), 1)"


def _sql_rates() -> str:
    parts = [f"CASE WHEN (s.entity + s.year) % 7 <> 0 THEN {_sql_share('s.k_' + m, 's.n')} END AS {m}" for m in ("ap", "rp", "ab")]
    parts += [f"CASE WHEN (s.entity + 2 * s.year) % 11 <> 0 THEN {_sql_share(f's.k_{m}_f', 's.n_f')} END AS {m}_f" for m in ("ap", "rp", "ab")]
    parts += [f"{_sql_share(f's.k_{m}_o', 's.n_o')} AS {m}_o" for m in ("ap", "rp", "ab")]
    return ",\n".join(parts)


_FLAGS = {"ap": "N", "rp": "R", "ab": "A"}
CTES["sy"] = f"""
SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n,
  count(*) FILTER (WHERE l_linestatus = 'F') AS n_f, count(*) FILTER (WHERE l_linestatus = 'O') AS n_o,
  {", ".join(f"count(*) FILTER (WHERE l_returnflag = '{v}') AS k_{m}" for m, v in _FLAGS.items())},
  {", ".join(f"count(*) FILTER (WHERE l_returnflag = '{v}' AND l_linestatus = '{s}') AS k_{m}_{s.lower()}" for s in "FO" for m, v in _FLAGS.items())},
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
FROM lineitem GROUP BY 1, 2"""
CTES["sp"] = f"""
SELECT s.entity, s.year, a.s_name AS name, CAST(a.s_nationkey AS VARCHAR) AS town, b.n_name AS town_name, b.n_regionkey AS region,
  CASE WHEN a.s_acctbal > 3000 THEN 'Urbana' ELSE 'Rural' END AS location,
  CASE a.s_nationkey % 4 WHEN 0 THEN 'Federal' WHEN 1 THEN 'Estadual' WHEN 2 THEN 'Municipal' ELSE 'Privada' END AS dependency,
  CASE WHEN a.s_nationkey % 4 = 3 THEN 0 ELSE 1 END AS public,
  CASE WHEN (s.entity * 3 + s.year) % 29 = 0 THEN 1 ELSE 0 END AS special,
  s.n, s.n_f, s.n_o, s.k_ab, greatest(1, s.n + (s.entity * 7 + s.year) % 9 - 4) AS enrolment,
  {_sql_rates()},
  round(s.disc / s.n, 3) AS tdi, round(s.qty / s.n, 3) AS atu
FROM sy s JOIN supplier a ON a.s_suppkey = s.entity LEFT JOIN nation b ON b.n_nationkey = a.s_nationkey"""
CTES["cp"] = f"""
SELECT entity, year, n, {", ".join(f"CASE WHEN (entity + year) % 7 <> 0 THEN {_sql_share('k_' + m, 'n')} END AS {m}" for m in ("ap", "rp", "ab"))}
FROM (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n,
  {", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{v}') AS k_{m}" for m, v in (("ap", "F"), ("rp", "O"), ("ab", "P")))}
  FROM orders GROUP BY 1, 2)"""
CTES["gp"] = f"""
SELECT entity, year, {", ".join(f"n_g{k}" for k in GRADES)},
  {", ".join(f"nullif(n_g{k}_{s}, 0) AS n_g{k}_{s}" for k in GRADES for s in "fo")},
  {", ".join(f"CASE WHEN (entity + year + {k}) % 13 <> 0 THEN {_sql_share(f'k_g{k}', f'n_g{k}')} END AS ab_g{k}" for k in GRADES)},
  {_sql_share('k_ab', 'n')} AS ab, CASE WHEN entity % 10 = 3 THEN 0 ELSE 1 END AS public
FROM (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS k_ab,
  {", ".join(f"count(*) FILTER (WHERE l_linenumber = {k}) AS n_g{k}" for k in GRADES)},
  {", ".join(f"count(*) FILTER (WHERE l_linenumber = {k} AND l_linestatus = '{s}') AS n_g{k}_{s.lower()}" for k in GRADES for s in "FO")},
  {", ".join(f"count(*) FILTER (WHERE l_linenumber = {k} AND l_returnflag = 'A') AS k_g{k}" for k in GRADES)}
  FROM lineitem GROUP BY 1, 2)"""
CTES["lp"] = """
SELECT p.*, CASE WHEN nx.entity IS NOT NULL THEN CAST(p.year + 1 AS INT) END AS target_year,
  pv.ab AS ab_LAG1, pv.ab_f AS ab_f_LAG1, pv.ab_o AS ab_o_LAG1, p.ab_f - pv.ab_f AS ab_f_DELTA1, p.ab_o - pv.ab_o AS ab_o_DELTA1,
  nx.ab AS ab_T1, nx.ab_f AS ab_f_T1, nx.ab_o AS ab_o_T1
FROM sp p LEFT JOIN sp pv ON pv.entity = p.entity AND pv.year = p.year - 1 LEFT JOIN sp nx ON nx.entity = p.entity AND nx.year = p.year + 1"""
CTES["st"] = """
SELECT *, CASE WHEN ever_special = 1 THEN '4-Indígena' WHEN region = 0 AND location = 'Urbana' THEN '1-Capital urbana'
  WHEN location = 'Urbana' THEN '2-Interior urbano' ELSE '3-Rural não indígena' END AS stratum
FROM (SELECT *, CAST(max(special) OVER (PARTITION BY entity) AS DOUBLE) AS ever_special FROM sp)"""
CTES["cand"] = """
SELECT entity, year, arg_min(n, (gap, n)) AS n_rate FROM (
  SELECT entity, year, n, abs(n - enrolment) AS gap, ap, rp, ab, round_even(ab * n / 100, 0) AS b, round_even(rp * n / 100, 0) AS r
  FROM (SELECT entity, year, enrolment, ap, rp, ab, unnest(range(greatest(1, CAST(floor(enrolment * 0.65) AS BIGINT) - 2), CAST(ceil(enrolment * 1.35) AS BIGINT) + 3)) AS n
        FROM st WHERE public = 1 AND ab IS NOT NULL))
WHERE n - b - r >= 0 AND abs(100 * b / n - ab) <= 0.051 AND abs(100 * r / n - rp) <= 0.051 AND abs(100 * (n - b - r) / n - ap) <= 0.051
GROUP BY 1, 2"""
CTES["ct"] = """
SELECT *, round_even(ab * n_use / 100, 0) AS dropouts, round_even(rp * n_use / 100, 0) AS failures
FROM (SELECT st.*, CAST(cand.n_rate AS INT) AS n_rate, CAST(coalesce(cand.n_rate, enrolment) AS DOUBLE) AS n_use
      FROM st LEFT JOIN cand USING (entity, year) WHERE public = 1 AND ab IS NOT NULL)"""
CTES["fp"] = """
SELECT *, 100 * cum_count / cum_size AS pooled FROM (
SELECT *,
  CASE WHEN lead(year, 1) OVER w = year + 1 THEN lead(ab, 1) OVER w END AS y1, CASE WHEN lead(year, 1) OVER w = year + 1 THEN lead(dropouts, 1) OVER w END AS b1,
  CASE WHEN lead(year, 1) OVER w = year + 1 THEN lead(n_use, 1) OVER w END AS n_next1,
  CASE WHEN lead(year, 2) OVER w = year + 2 THEN lead(ab, 2) OVER w END AS y2, CASE WHEN lead(year, 2) OVER w = year + 2 THEN lead(dropouts, 2) OVER w END AS b2,
  CASE WHEN lead(year, 2) OVER w = year + 2 THEN lead(n_use, 2) OVER w END AS n_next2,
  avg(ab) OVER (PARTITION BY entity ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3,
  avg(ab) OVER (PARTITION BY entity ORDER BY year ROWS UNBOUNDED PRECEDING) AS mexp,
  sum(dropouts) OVER (PARTITION BY entity ORDER BY year ROWS UNBOUNDED PRECEDING) AS cum_count,
  sum(n_use) OVER (PARTITION BY entity ORDER BY year ROWS UNBOUNDED PRECEDING) AS cum_size
FROM ct WINDOW w AS (PARTITION BY entity ORDER BY year))"""
