"""The supplier panel rendered as header-less sheets of all layout generations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalis import fixed_values as fv
from annalis.catalog import adapters as ad
from annalis.catalog.registry import CTES

# Panel year -> sheet year, so that every layout and label period occurs.
SHEET_YEARS = {1995: 2008, 1996: 2010, 1997: 2012, 1998: 2014, 1999: 2016, 2000: 2019, 2001: 2022}
HEADER_ROW = 3
FIRST_DATA_ROW = 10
STAGE_RATE = {"FUN": "", "FUN_AI": "_o", "FUN_AF": "_f", "MED": "_f"}
MEASURE_RATE = {"APROVACAO": "ap", "REPROVACAO": "rp", "ABANDONO": "ab"}
OTHER_STATES = ["AC", "AL", "AM", "PA", "SP", "RJ", "MG"]


def period(table, year):
    return next(row[2] for row in table if row[0] <= year <= row[1])


def header_lines(year: int) -> list[list[str]]:
    """One or two header lines of a sheet year."""
    ids = period(fv.IDENTITY_NAMES, year)
    one_line = year >= 2015
    state = {2019: "CO_UF", 2022: "NO_UF"}.get(year, "SG_UF" if one_line else "UF")
    first = ["NU_ANO_CENSO" if one_line else "Ano", "NO_REGIAO", state, ids["CO_MUNICIPIO"], ids["NO_MUNICIPIO"],
             ids["CO_ENTIDADE"], ids["NO_ENTIDADE"], ids["LOCALIZACAO"], ids["DEPENDENCIA"]]
    layout = "A" if year <= fv.LAST_YEAR_OF_LAYOUT_A else "B"
    top, low = [], []
    for m in fv.MEASURE_CODES:
        block = [(f"{m.old_prefix}_X{i}" if year < 2021 else f"{m.digit}_CAT_X{i}") if one_line else f"{m.title} série" for i in range(18)]
        second = [f"{i + 1}" for i in range(18)]
        for s in fv.STAGES:
            i = fv.POSITIONS[layout][s] - 10
            if one_line:
                block[i] = period(fv.LABEL_PATTERNS, year)[s].format(title=m.title, old=m.old_prefix, digit=m.digit).strip("^$")
            elif layout == "A":
                block[i], second[i] = {
                    "FUN": (f"Total {m.title} Fundamental", "·"), "FUN_AI": (f"{m.title} 1ª a 4ª", "·"),
                    "FUN_AF": (f"{m.title} 5ª a 8ª", "--"), "MED": (f"Total {m.title} - Médio", "·"),
                }[s]
            else:
                block[i], second[i] = {
                    "FUN": (f"Total {m.title} no", "Ens. Fundamental"), "FUN_AI": (m.title, "Anos Iniciais"),
                    "FUN_AF": (m.title, "Anos Finais"), "MED": (f"Total {m.title} no", "Ens. Médio"),
                }[s]
        top += block
        low += second
    return [first + top] if one_line else [first + top, ["·"] * 9 + low]


def raw_sheets(spark, sf) -> DataFrame:
    """(year, file, sheet, row_no, cells) with decoy rows above the header and a blank row below it."""
    p = ad.supplier_panel(spark, sf)
    y, e = F.col("year"), F.col("entity")
    sheet_year = reduce(lambda acc, kv: F.when(y == kv[0], F.lit(kv[1])).otherwise(acc), SHEET_YEARS.items(), F.lit(None).cast("int"))
    letters = F.when(e % 2 == 0, fv.SCOPE_STATE).otherwise(F.get(F.array(*[F.lit(v) for v in OTHER_STATES]), (e % 7).cast("int")))
    state = (
        F.when(y == 2000, F.when(e % 2 == 0, "14").otherwise((e % 3 + 11).cast("string")))
        .when(y == 2001, F.when(e % 2 == 0, "Roraima").otherwise("Amazonas"))
        .otherwise(letters)
    )
    dependency = F.when((F.col("dependency") == "Privada") & (y <= 1997), "Particular").otherwise(F.col("dependency"))
    ids = [sheet_year.cast("string"), F.lit("Norte"), state, F.col("town"), F.concat(F.col("town_name"), F.lit("  ")),
           e.cast("string"), F.concat(F.lit(" "), F.col("name")), F.col("location"), dependency]

    text = p.select(
        sheet_year.alias("year"), (e + FIRST_DATA_ROW).cast("int").alias("row_no"), F.array(*ids).alias("ids"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(fv.MISSING_MARKER)).alias(c) for c in ad.RATES],
    )

    def block(m, layout):
        """The 18 cells of one measure: grades repeat the rate of their stage."""
        ai, af, med = F.array_repeat(f"{m}_o", 5), F.array_repeat(f"{m}_f", 4), F.array_repeat(f"{m}_f", 5)
        if layout == "A":
            return F.concat(ai, af, F.array(f"{m}_o", f"{m}_f", m), med, F.array(f"{m}_f"))
        return F.concat(F.array(m, f"{m}_o", f"{m}_f"), ai, af, F.array(f"{m}_f"), med)

    old, new = (F.concat("ids", *[block(m, x) for m in MEASURE_RATE.values()]) for x in "AB")
    rows = text.select("year", "row_no", F.when(F.col("year") <= fv.LAST_YEAR_OF_LAYOUT_A, old).otherwise(new).alias("cells"))
    top_rows = []
    for sy in SHEET_YEARS.values():
        lines = [["Taxas de rendimento"] + [None] * 62, [None] * 63, ["Ano", "observação"] + [None] * 61, *header_lines(sy), [None] * 63]
        top_rows += [(sy, i, c) for i, c in enumerate(lines)]
    tops = spark.createDataFrame(top_rows, "year int, row_no int, cells array<string>")  # the header layouts, some forty rows
    heads = rows.select("year").distinct().join(tops, "year")
    both = heads.unionByName(rows)
    return both.select(
        "year", F.concat(F.lit("tx_rend_escola_"), F.col("year").cast("string"), F.lit(".xlsx")).alias("file"), F.lit("Plan1").alias("sheet"), "row_no", "cells"
    )


_YEAR = "CASE year " + " ".join(f"WHEN {k} THEN {v}" for k, v in SHEET_YEARS.items()) + " END"
CTES["sheets"] = f"""SELECT CAST({_YEAR} AS INT) AS sy, 'tx_rend_escola_' || CAST({_YEAR} AS VARCHAR) || '.xlsx' AS file, sp.*, entity % 2 = 0 AS inside FROM sp"""
