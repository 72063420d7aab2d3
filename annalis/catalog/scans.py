"""Queries of the sources, sinks and the sheet ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalis import fixed_values as fv
from annalis.catalog import adapters as ad
from annalis.catalog.registry import query
from annalis.catalog.sheets import HEADER_ROW, MEASURE_RATE, STAGE_RATE, raw_sheets
from annalis.functions.scalar import canonical_category, normalise_id
from annalis.session import shared_folder, staged
from annalis.sources import delimited, discover, layouts, raw, stages
from annalis.streaming import refresh

SHEET_KEYS = ["file", "sheet"]


def year_sources(spark, sf, names):
    """Write the panel once per (year, file name) rule as folders of CSV parts."""
    folder = shared_folder(spark, "sources")
    p = ad.supplier_panel(spark, sf).select("entity", "year", "ab", "ap", "name", "town")
    rows = p.select("*", F.explode(F.array(*names)).alias("file_name")).where("file_name is not null")
    rows.write.partitionBy("file_name").csv(folder, header=True)
    return discover.list_folders(discover.list_files(spark, folder, "*.csv"))


@query("s1_discover_sources", """SELECT DISTINCT CAST(year + 13 AS INT) AS year, CASE WHEN year % 2 = 0 THEN 'a_taxa_rend_escolas_' || (year + 13) || '.zip' ELSE 'TX_REND_ESCOLAS_' || (year + 13) || '.zip' END AS name FROM sp WHERE year + 13 BETWEEN 2009 AND 2014""")
def discover_sources(spark, sf):
    y, even = (F.col("year") + 13).cast("string"), F.col("year") % 2 == 0
    names = [
        F.when(~even, F.concat(F.lit("TX_REND_ESCOLAS_"), y, F.lit(".zip"))),
        F.when(even, F.concat(F.lit("a_taxa_rend_escolas_"), y, F.lit(".zip"))),
        F.concat(F.lit("zz_tx_rend_escolas_"), y, F.lit(".zip")),
        F.concat(F.lit("A_tx_rend_escolas_brasil_"), y, F.lit(".zip")),
        F.concat(F.lit("A_tx_rend_municipios_"), y, F.lit(".zip")),
    ]
    found = discover.discover_sources(year_sources(spark, sf, names), ["tx_rend", "taxa_rend"], ["escola"], ["brasil", "municipio"], (2009, 2014))
    return found.select("year", "name")


@query("s2_pick_source", """SELECT DISTINCT CAST(year + 12 AS INT) AS year, CASE WHEN year >= 1999 THEN 'microdados_' || (year + 12) || '_all.csv' ELSE 'Escola_' || (year + 12) || CASE WHEN year >= 1997 THEN '.csv' ELSE '.zip' END END AS name,
    CASE WHEN year >= 1997 THEN 'extracted' ELSE 'archive' END AS kind FROM sp""")
def pick_source(spark, sf):
    y = (F.col("year") + 12).cast("string")
    few = F.col("entity") % 3 == 0
    names = [
        F.concat(F.lit("microdados_"), y, F.lit("_all.csv")),
        F.when(few, F.concat(F.lit("microdados_"), y, F.lit("_few.csv"))),
        F.when((F.col("year") < 1999) & (F.col("year") >= 1997) & few, F.concat(F.lit("Escola_"), y, F.lit(".csv"))),
        F.when(F.col("year") < 1999, F.concat(F.lit("Escola_"), y, F.lit(".zip"))),
    ]
    return discover.pick_source(year_sources(spark, sf, names)).select("year", "name", "kind")


def census_folder(spark, sf, sep=";"):
    """The supplier panel as census files: text columns, state codes, 0/1 flags, one row per entity and year."""
    e = F.col("entity")
    p = ad.supplier_panel(spark, sf)
    wide = p.select(
        F.col("year").alias("NU_ANO"), F.when(e % 2 == 0, " rr").otherwise("AM").alias("SG_UF"), F.concat(e.cast("string"), F.lit(" ")).alias("CO_ENTIDADE"), "name",
        F.when(e % 3 != 0, (e % 2).cast("string")).alias("IN_AGUA_FILTRADA"), (e % 4 / 2).cast("int").cast("string").alias("IN_AGUA_POTAVEL"),
        F.when(e % 5 == 0, "x").otherwise("1").alias("IN_INTERNET"), F.when(F.col("ab").isNotNull(), "1").otherwise("0").alias("IN_BIBLIOTECA"), "enrolment",
    )
    folder = shared_folder(spark, "census")
    wide.write.csv(folder, header=True, sep=sep, encoding="ISO-8859-1")
    return folder


CENSUS_SQL = """SELECT year AS "ANO", CAST(entity AS VARCHAR) AS "CO_ENTIDADE", CAST(coalesce(CASE WHEN entity % 3 <> 0 THEN entity % 2 END, CAST(floor((entity % 4) / 2) AS INT)) AS DOUBLE) AS "IIB_agua_potavel",
    CASE WHEN entity % 5 <> 0 THEN 1.0::DOUBLE END AS "IEP_internet", CASE WHEN ab IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "IDP_biblioteca", CAST(NULL AS DOUBLE) AS "IDA_despensa" FROM sp WHERE entity % 2 = 0"""


@query("s3_sniff_delimiter", "SELECT s.sep AS found, s.sep AS written, (SELECT count(*) FROM sp) AS rows FROM (SELECT unnest([';', ',', '|']) AS sep) s")
def sniff(spark, sf):
    parts = []
    for sep in (";", ",", "|"):
        folder = census_folder(spark, sf, sep)
        found = delimited.sniff_delimiter(spark, folder)
        rows = delimited.scan_delimited(spark, folder, found).agg(F.count(F.lit(1)).alias("rows"))
        parts.append(rows.select(F.lit(found).alias("found"), F.lit(sep).alias("written"), "rows"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s4_scan_delimited", """SELECT CAST(year AS VARCHAR) AS year, CAST(entity AS VARCHAR) AS id, CASE WHEN entity % 5 = 0 THEN 'x' ELSE '1' END AS "IN_INTERNET" FROM sp WHERE entity % 2 = 0""")
def scan(spark, sf):
    folder = census_folder(spark, sf)
    df = delimited.scan_delimited(spark, folder, ";", columns=["NU_ANO", "CO_ENTIDADE", "SG_UF", "IN_INTERNET"])
    return df.where(delimited.in_scope("SG_UF", "letters")).select(F.col("NU_ANO").alias("year"), F.trim("CO_ENTIDADE").alias("id"), "IN_INTERNET")


@query("p12_coalesce_candidates", CENSUS_SQL)
def census(spark, sf):
    folder = census_folder(spark, sf)
    df = delimited.scan_delimited(spark, folder, delimited.sniff_delimiter(spark, folder))
    return delimited.census_rows(df, F.col("NU_ANO")).select("ANO", "CO_ENTIDADE", "IIB_agua_potavel", "IEP_internet", "IDP_biblioteca", "IDA_despensa")


@query("s14_detect_scope_column", """SELECT 'SG_UF' AS scope_column, 'letters' AS mode, 'CO_ENTIDADE' AS id_column, count(*) FILTER (WHERE entity % 2 = 0) AS in_scope FROM sp""")
def detect_scope(spark, sf):
    df = delimited.scan_delimited(spark, census_folder(spark, sf), ";")
    column, mode = delimited.detect_scope_column(df.columns)
    key = delimited.detect_id_by_name(df.columns)
    found = df.where(delimited.in_scope(column, mode)).agg(F.count(F.lit(1)).alias("in_scope"))
    return found.select(F.lit(column).alias("scope_column"), F.lit(mode).alias("mode"), F.lit(key).alias("id_column"), "in_scope")


@query("s5_assemble_year", "SELECT entity * 10000 + year AS id, ap, rp, ab, n, enrolment FROM sp")
def assemble(spark, sf):
    p = ad.staged_supplier(spark, sf).withColumn("id", F.col("entity") * 10000 + F.col("year"))
    main = p.select("id", "ap", "rp")
    sides = [p.select("id", F.lit(-1.0).alias("rp"), "ab"), p.select("id", "n", F.lit(-1.0).alias("ab"), "enrolment")]
    return delimited.assemble_year(main, sides, "id")


def headers(spark, sf):
    """Raw cells and the staged names per sheet."""
    cells = staged(raw.normalise_mixed_types(raw_sheets(spark, sf)), "sheets")
    return cells, staged(raw.build_header_names(cells, raw.detect_header(cells), "year"), "headers")


def sheet_rows(spark, sf):
    cells, names = headers(spark, sf)
    return raw.data_rows(cells, names), names


@query("s6_detect_header", f"SELECT DISTINCT file, 'Plan1' AS sheet, {HEADER_ROW} AS header_row, CASE WHEN sy >= 2015 THEN 1 ELSE 2 END AS header_lines FROM sheets")
def detect_header(spark, sf):
    return raw.detect_header(staged(raw_sheets(spark, sf), "sheets"))


@query("s7_build_header_names", """SELECT DISTINCT file, CASE WHEN sy <= 2014 THEN 'Código da Escola' ELSE 'CO_ENTIDADE' END AS id_name, CASE WHEN sy <= 2010 THEN 'Total Aprovação Fundamental' WHEN sy <= 2014 THEN 'Total Aprovação no - Ens. Fundamental' WHEN sy <= 2020 THEN 'tap_FUN' ELSE '1_CAT_FUN' END AS first_total, 63 AS names FROM sheets""")
def header_names(spark, sf):
    _, names = headers(spark, sf)
    at = F.when(F.regexp_extract("file", r"(20\d\d)", 1).cast("int") <= 2010, 20).otherwise(9)
    return names.select("file", F.get("names", F.lit(5)).alias("id_name"), F.get("names", at).alias("first_total"), F.size("names").alias("names"))


@query("s8_data_rows", "SELECT file, CAST(entity + 10 AS INT) AS row_no, CAST(entity AS VARCHAR) AS code FROM sheets")
def data_rows(spark, sf):
    rows, _ = sheet_rows(spark, sf)
    return rows.select("file", "row_no", F.get("cells", F.lit(5)).alias("code"))


@query("s9_dedup_column_names", """SELECT DISTINCT file, CASE WHEN sy <= 2010 THEN 'Aprovação série - 1' WHEN sy <= 2014 THEN 'Aprovação série - 4' WHEN sy <= 2020 THEN 'tap_X3' ELSE '1_CAT_X3' END AS plain, 'again' AS first_name, 'again__1' AS second_name, 'again__2' AS third_name FROM sheets""")
def dedup_names(spark, sf):
    _, names = headers(spark, sf)
    doubled = names.withColumn("names", raw.dedup_names(F.concat(F.array(F.lit("again"), F.lit("again")), "names", F.array(F.lit("again")))))
    at = F.when(F.regexp_extract("file", r"(20\d\d)", 1).cast("int") <= 2010, 11).otherwise(14)
    get = lambda i: F.get("names", i)
    return doubled.select("file", get(at).alias("plain"), get(F.lit(0)).alias("first_name"), get(F.lit(1)).alias("second_name"), get(F.lit(65)).alias("third_name"))


@query("s10_normalise_mixed_types", "SELECT entity, year, CASE WHEN entity % 4 = 3 THEN CAST(ab AS VARCHAR) END AS cell, n FROM sp")
def mixed_types(spark, sf):
    e = F.col("entity") % 4
    text = F.when(e == 0, "nan").when(e == 1, "None").when(e == 2, "  ").otherwise(F.col("ab").cast("string"))
    rows = ad.supplier_panel(spark, sf).select("entity", "year", "n", F.array(text).alias("cells"))
    return raw.normalise_mixed_types(rows).select("entity", "year", "n", F.get("cells", F.lit(0)).alias("cell"))


@query("s11_detect_domain_column", """SELECT file, 2 AS pos, "column", CAST(hits AS BIGINT) AS hits FROM (SELECT file, CASE WHEN sy < 2015 THEN 'UF' ELSE 'SG_UF' END AS "column", count(DISTINCT CASE WHEN inside THEN 'RR' ELSE CAST(entity % 7 AS VARCHAR) END) AS hits FROM sheets WHERE sy <= 2016 GROUP BY 1, 2) WHERE hits >= 5""")
def domain_column(spark, sf):
    rows, names = sheet_rows(spark, sf)
    found = raw.detect_domain_column(raw.position_facts(rows), names, fv.STATE_CODES)
    return found.select("file", "pos", "column", "hits")


def scoped_rows(spark, sf):
    rows, names = sheet_rows(spark, sf)
    scope = staged(raw.scope_per_sheet(rows, names), "scope")
    return raw.filter_entity_scope(rows, scope), names


@query("s12_filter_entity_scope", "SELECT file, CAST(entity AS VARCHAR) AS code FROM sheets WHERE inside")
def scope_filter(spark, sf):
    kept, _ = scoped_rows(spark, sf)
    return kept.select("file", F.get("cells", F.lit(5)).alias("code"))


@query("s13_detect_id_column", "SELECT DISTINCT file, CASE WHEN sy <= 2014 THEN 'Código da Escola' ELSE 'CO_ENTIDADE' END AS id_column FROM sheets")
def id_column(spark, sf):
    return raw.detect_id_column(*sheet_rows(spark, sf)).drop("sheet")


@query("s15_read_stage", "SELECT entity, year, ab FROM sp")
def read_stage(spark, sf):
    path = shared_folder(spark, "stage")
    stages.write_stage(ad.supplier_panel(spark, sf), path)
    return stages.read_stage(spark, path, ["entity", "year", "ab"])


@query("s16_read_base_csv", "SELECT CAST(entity AS VARCHAR) AS code, year, ab, location FROM sp")
def base_csv(spark, sf):
    folder = shared_folder(spark, "base")
    p = ad.supplier_panel(spark, sf).select(F.col("entity").alias("code"), "year", "ab", "location")
    p.write.csv(folder, header=True, sep=";")
    return delimited.read_base_csv(spark, folder, "code string, year int, ab double, location string")


@query("s17_write_stage", "SELECT year, entity, ab_f, ab_f_T1 FROM lp")
def write_stage(spark, sf):
    path = shared_folder(spark, "stage")
    stages.write_stage(ad.longitudinal_panel(spark, sf), path, partition_by="year")
    return stages.read_stage(spark, path, ["year", "entity", "ab_f", "ab_f_T1"])


@query("s18_refresh_years", "SELECT year, entity, CASE WHEN year <= 1998 AND year <> 1996 THEN -1.0::DOUBLE ELSE ab END AS ab FROM sp")
def refresh_years(spark, sf):
    """Years up to 1998 are stored with a stale value; 1996 is forced; later years are missing."""
    p = ad.supplier_panel(spark, sf).select("year", "entity", "ab")
    path = shared_folder(spark, "yearly")
    refresh.replace_years(p.where(F.col("year") <= 1998).withColumn("ab", F.lit(-1.0)), path, "year")
    todo = refresh.years_to_refresh(p, spark.read.parquet(path), "year", forced=[1996])
    refresh.replace_years(p.join(staged(todo, "todo"), "year"), path, "year")
    return spark.read.parquet(path).select("year", "entity", "ab")


@query("s19_publish", "SELECT entity, year, ab, ab_T1 FROM lp")
def publish(spark, sf):
    stage, public = shared_folder(spark, "stage"), shared_folder(spark, "published")
    stages.write_stage(ad.longitudinal_panel(spark, sf).select("entity", "year", "ab", "ab_T1"), stage)
    stages.publish(spark, stage, public, part="year")
    stages.publish(spark, stage, public, part="year")  # the second time there is nothing to write
    return stages.read_published(spark, public)


@query("s20_write_table_csv", "SELECT year, count(*) AS rows, round(avg(ab_f), 4) AS mean FROM sp GROUP BY 1")
def write_csv(spark, sf):
    path = shared_folder(spark, "table")
    table = ad.supplier_panel(spark, sf).groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("ab_f"), 4).alias("mean"))
    stages.write_table_csv(table, path)
    return spark.read.csv(path, header=True, schema="year int, rows bigint, mean double")


@query("s21_position_rename", """SELECT CAST(year + 21 AS INT) AS "ANO", entity, ap AS "AP_FUN", ab AS "AB_FUN", ab_f AS "AB_FUN_AF", ab_o AS "AB_MED" FROM sp""")
def position_rename(spark, sf):
    """All years, 21 years later: the old names up to 2020, the new ones from 2021 on; a column of the other generation is NULL."""
    p = ad.staged_supplier(spark, sf)
    year = F.col("year") + 21
    source = {"FUN": "", "FUN_AF": "_f", "MED": "_o"}
    is_old = year < fv.FIRST_YEAR_OF_NEW_SEGMENTS
    cells = []
    for new_prefix, old_prefix, short in fv.SEGMENT_PREFIXES:
        for n, o in zip(fv.SEGMENTS_NEW, fv.SEGMENTS_OLD):
            value = F.col(short.lower() + source[n]).cast("string") if n in source else F.lit("--")
            cells += [F.when(~is_old, value).alias(new_prefix + n), F.when(is_old, value).alias(old_prefix + o)]
    out = delimited.position_rename_all(p.select("entity", year.alias("year"), *cells), F.col("year"), [F.col("entity")])
    return out.select("ANO", "entity", "AP_FUN", "AB_FUN", "AB_FUN_AF", "AB_MED")


@query("s22_ingest_stats", """SELECT file, 63 AS columns, count(*) AS rows, count(*) FILTER (WHERE inside) AS in_scope, CASE WHEN any_value(sy) <= 2016 THEN 'letters' WHEN any_value(sy) = 2019 THEN 'number' ELSE 'name' END AS method,
    CASE WHEN any_value(sy) < 2015 THEN 'UF' WHEN any_value(sy) = 2016 THEN 'SG_UF' WHEN any_value(sy) = 2019 THEN 'CO_UF' ELSE 'NO_UF' END AS "column" FROM sheets GROUP BY 1""")
def ingest_stats(spark, sf):
    rows, names = sheet_rows(spark, sf)
    return raw.ingest_stats(rows, names, staged(raw.scope_per_sheet(rows, names), "scope")).drop("sheet")


HARMONISED = ", ".join(f"{MEASURE_RATE[m.name]}{STAGE_RATE[s]} AS \"{m.name}_{s}\"" for m in fv.MEASURE_CODES for s in fv.STAGES)


@query("p5_harmonise_layout", f"""SELECT sy AS "ANO", CAST(entity AS VARCHAR) AS "CO_ENTIDADE", name AS "NO_ENTIDADE", town AS "CO_MUNICIPIO", town_name AS "NO_MUNICIPIO", location AS "LOCALIZACAO", dependency AS "DEPENDENCIA", {HARMONISED} FROM sheets WHERE inside""")
def harmonise(spark, sf):
    return layouts.harmonise(*scoped_rows(spark, sf), "year")


@query("p6_assert_label", """SELECT sy AS year, 'ABANDONO_FUN_AF' AS rate, 'tab_F58' AS label, count(*) AS rows FROM sheets WHERE sy = 2019 GROUP BY 1""")
def assert_label(spark, sf):
    """A sheet of 2019 with a label of the years before: the check names the position."""
    cells, names = headers(spark, sf)
    layouts.assert_label(names, "year")
    drifted = names.withColumn("names", F.when(F.col("year") == 2019, F.transform("names", lambda x: F.when(x == "tab_F04", "tab_F58").otherwise(x))).otherwise(F.col("names")))
    rows = raw.data_rows(cells, names).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    return layouts.label_violations(drifted, "year").join(rows, "file").select("year", "rate", "label", "rows")


@query("p7_identity_columns", """SELECT sy AS year, CAST(entity AS VARCHAR) AS code, location, dependency FROM sheets""")
def identity(spark, sf):
    rows, names = sheet_rows(spark, sf)
    placed = rows.join(layouts.identity_positions(names, "year"), SHEET_KEYS)
    return placed.select(
        "year", normalise_id(layouts.identity_cell("CO_ENTIDADE")).alias("code"), layouts.identity_cell("LOCALIZACAO").alias("location"),
        canonical_category(layouts.identity_cell("DEPENDENCIA")).alias("dependency"),
    )


def _outside_sql():
    flags = []
    for m in MEASURE_RATE.values():
        flags.append(f"CASE WHEN {m} < least({m}_o, {m}_f) - 0.15 OR {m} > greatest({m}_o, {m}_f) + 0.15 THEN 1 ELSE 0 END")
    return " + ".join(flags)


@query("a5_components_of_sheets", f"SELECT sy AS year, CAST(sum({_outside_sql()}) AS BIGINT) AS outside FROM sheets GROUP BY 1")
def components(spark, sf):
    return layouts.totals_outside_components(sheet_rows(spark, sf)[0], "year")
