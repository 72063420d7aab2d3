"""Names and types of yearly files, read by tasks and compared as data.

The supplier panel is written as one folder per year with layouts that drift; two years of
each kind of file hold a planted difference.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from annalis.catalog import adapters as ad
from annalis.catalog.adapters import YEARS
from annalis.catalog.registry import query
from annalis.operators import names as op
from annalis.session import shared_folder, staged
from annalis.sources import names as src

# Column names of the delimited files and the panel columns behind them, by generation.
OLD = {"tap_FUN": "ap", "tre_FUN": "rp", "tab_FUN": "ab", "tab_MED": "ab_o", "NO_ENTIDADE": "name"}
NEW = {"1_CAT_FUN": "ap", "2_CAT_FUN": "rp", "3_CAT_FUN": "ab", "3_CAT_MED": "ab_o", "NO_ENTIDADE": "name"}
PLANTED = {
    1997: {"tap_FUN": "ap", "tre_FUN": "rp", "tab_FUN": "ab", "MED; abandono": "ab_o", "NO_ENTIDADE": "name"},
    2000: {"1_CAT_FUN": "ap", "3_CAT_FUN": "ab", "3_CAT_MED": "ab_o", "Abandono - Anos Finais": "ab_f", "NO_ENTIDADE": "name"},
}
LAYOUTS = {y: PLANTED.get(y, OLD if y < 1998 else NEW) for y in YEARS}
NOT_RATES = ("NO_ENTIDADE", "MED; abandono")

# Panel columns of the parquet files; in 1998 `ab` is text, in 2000 `tdi` is missing and `town_name` is there.
TYPED = ["entity", "ab", "tdi", "location"]
KINDS = {"entity": "number", "ab": "number", "tdi": "number", "location": "text"}


def by_year(names):
    return names.withColumn("year", src.path_part("year").cast("int")).where(F.col("year").isNotNull())


def csv_folder(spark, sf):
    """Yearly delimited files, one write per layout."""
    p, folder = ad.staged_supplier(spark, sf), shared_folder(spark, "yearly-csv")
    layouts = {}
    for y, names in LAYOUTS.items():
        layouts.setdefault(tuple(names.items()), []).append(y)
    for names, years in layouts.items():
        wide = p.where(F.col("year").isin(years)).select("year", *[F.col(source).alias(name) for name, source in names])
        wide.write.partitionBy("year").csv(folder, sep=";", header=True, mode="append")
    return folder


def csv_layouts(spark, sf):
    return op.layout(by_year(src.delimited_names(spark, csv_folder(spark, sf))), "year")


def typed_layouts(spark, sf):
    p, folder, year = ad.staged_supplier(spark, sf), shared_folder(spark, "yearly-typed"), F.col("year")
    kept = p.select("year", *TYPED, "town_name")
    kept.where(~year.isin(1998, 2000)).drop("town_name").write.partitionBy("year").parquet(folder, mode="append")
    kept.where(year == 1998).drop("town_name").withColumn("ab", F.col("ab").cast("string")).write.partitionBy("year").parquet(folder, mode="append")
    kept.where(year == 2000).drop("tdi").write.partitionBy("year").parquet(folder, mode="append")
    return by_year(src.parquet_names(spark, folder))


def rows_sql(cells):
    """A row of literals for every year that the panel has; ``cells`` gives those of a year."""
    return "\nUNION ALL\n".join(f"SELECT {row} FROM sp WHERE year = {y} GROUP BY year" for y in YEARS for row in cells(y))


def _typed(y):
    kinds = {**KINDS, "ab": "text"} if y == 1998 else dict(KINDS)
    if y == 2000:
        del kinds["tdi"]
        kinds["town_name"] = "text"
    return kinds


@query("p10_rate_columns_of_files", rows_sql(lambda y: [f"year, '{c}' AS \"column\", count({s}) AS known" for c, s in LAYOUTS[y].items() if c not in NOT_RATES]))
def rate_columns_of_files(spark, sf):
    """Rate columns of every yearly file with their filled cells: one scan over all layouts."""
    folder = csv_folder(spark, sf)
    names = staged(src.delimited_names(spark, folder), "names")
    rates = by_year(src.known_cells(spark, folder, names)).where(op.is_rate_name("column"))
    return rates.groupBy("year", "column").agg(F.sum("known").alias("known"))


def _mapped(y):
    """Expected column of a year for each column of the last layout, by the panel column behind both."""
    own = {source: name for name, source in LAYOUTS[y].items() if name != "MED; abandono"}
    return [f"year, '{c}' AS \"column\", '{own[s]}' AS mine, {1 if own[s] == c else 2} AS priority" for c, s in LAYOUTS[YEARS[-1]].items() if s in own]


@query("p11_map_columns_of_files", rows_sql(_mapped))
def map_columns_of_files(spark, sf):
    """Columns of every year that stand for the columns of the last one."""
    layouts = staged(csv_layouts(spark, sf), "layouts")
    return op.map_to_layout(layouts, layouts.where(F.col("year") == YEARS[-1]), "year")


@query("p19_kinds_of_files", rows_sql(lambda y: [f"year, '{c}' AS \"column\", '{k}' AS kind, count(*) AS rows" for c, k in _typed(y).items()]))
def kinds_of_files(spark, sf):
    names = staged(typed_layouts(spark, sf), "names")
    rows = names.groupBy("year", "column").agg(F.sum("rows").alias("rows"))
    return op.layout(names, "year").select("year", "column", "kind").join(rows, ["year", "column"])


@query("p21_leaks_of_files", "SELECT year, 'ab_f_T1' AS \"column\", count(*) AS rows FROM lp WHERE year IN (1997, 1999) GROUP BY 1")
def leaks_of_files(spark, sf):
    """Feature files against target files; the features of two years hold a target."""
    p, year = ad.staged_longitudinal(spark, sf), F.col("year")
    features, targets = shared_folder(spark, "features"), shared_folder(spark, "targets")
    p.where(~year.isin(1997, 1999)).select("year", "entity", "ab", "ab_f", "ab_f_LAG1").write.partitionBy("year").parquet(features, mode="append")
    p.where(year.isin(1997, 1999)).select("year", "entity", "ab", "ab_f", "ab_f_T1").write.partitionBy("year").parquet(features, mode="append")
    p.select("year", "entity", "ab_f_T1", "ab_T1").write.partitionBy("year").parquet(targets)
    names = staged(by_year(src.parquet_names(spark, features)), "names")
    wanted = src.parquet_names(spark, targets).where(F.col("column").endswith("_T1")).select("column").distinct()
    rows = names.groupBy("year", "column").agg(F.sum("rows").alias("rows"))
    return op.leaked_columns(names, wanted, "year").join(rows, ["year", "column"])


def _contract(y):
    found = _typed(y)
    return [f"year, '{c}' AS \"column\", '{k}' AS expected, {repr(found[c]) if c in found else 'CAST(NULL AS VARCHAR)'} AS found, '{'ok' if found.get(c) == k else 'fail'}' AS status" for c, k in KINDS.items()]


@query("q1_type_contract_of_files", rows_sql(_contract))
def type_contract_of_files(spark, sf):
    return op.kind_contract(staged(op.layout(typed_layouts(spark, sf), "year"), "layouts"), "year", KINDS)


def _differences(y):
    found = _typed(y)
    return [f"year, '{c}' AS \"column\", 'missing' AS difference" for c in TYPED if c not in found] + [f"year, '{c}' AS \"column\", 'extra' AS difference" for c in found if c not in TYPED]


@query("q16_exact_columns_of_files", rows_sql(_differences))
def exact_columns_of_files(spark, sf):
    return op.column_contract(staged(op.layout(typed_layouts(spark, sf), "year"), "layouts"), "year", TYPED)
