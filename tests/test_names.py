"""Names and kinds of files read by tasks, and their comparison."""

import gzip
import io

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from annalis.operators import names as op
from annalis.operators.select import select_rate_columns
from annalis.sources import names as src


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("raw, expected", [
    (b"", []),
    (b"a;b;c\n1;2;3\n", ["a", "b", "c"]),
    (b'"a;b";"c\nd";e\n1;2;3', ["a;b", "c\nd", "e"]),
    ("\ufeffano,código,x".encode(), ["ano", "código", "x"]),
    (b'"a ""b""";c;d\r\n', ['a "b"', "c", "d"]),
    (b"single\n", ["single"]),
])
def test_header_names(raw, expected):
    assert src.header_names(io.BytesIO(raw), "utf-8", (";", ",", "|"), 3) == expected


@pytest.fixture()
def folder(tmp_path):
    """Three years; one of them has two files, one a drifting header."""
    for year, name, text in [
        (2001, "a.csv", "id;tap_FUN;tab_MED\n1;2;\n2;3;4\n"), (2001, "b.csv", "id;tap_FUN;tab_MED\n3;;\n"),
        (2002, "a.csv", "id;tab_MED;tap_FUN\n1;2;\n"), (2003, "a.csv", 'id;"tap;FUN";3_CAT_MED;more\n1;2;3;4\n'),
    ]:
        at = tmp_path / f"year={year}"
        at.mkdir(exist_ok=True)
        (at / name).write_text(text)
    (tmp_path / "year=2001" / "empty.csv").write_text("")
    return str(tmp_path)


def by_year(names):
    return names.withColumn("year", src.path_part("year").cast("int"))


def test_names_and_known_cells_of_drifting_files(spark, folder):
    names = src.delimited_names(spark, folder, min_cols=3)
    found = by_year(src.known_cells(spark, folder, names)).groupBy("year", "column").agg(F.sum("known").alias("known"))
    assert rows(found) == [
        (2001, "id", 3), (2001, "tab_MED", 1), (2001, "tap_FUN", 2), (2002, "id", 1), (2002, "tab_MED", 1), (2002, "tap_FUN", 0),
        (2003, "3_CAT_MED", 1), (2003, "id", 1), (2003, "more", 1), (2003, "tap;FUN", 1),
    ]


def test_drift_is_found_and_follows_the_files(spark, folder, tmp_path):
    layouts = lambda: op.layout(by_year(src.delimited_names(spark, folder, min_cols=3)), "year")
    expected = ["id", "tap_FUN", "tab_MED"]
    planted = [(2003, "3_CAT_MED", "extra"), (2003, "more", "extra"), (2003, "tab_MED", "missing"), (2003, "tap;FUN", "extra"), (2003, "tap_FUN", "missing")]
    assert rows(op.column_contract(layouts(), "year", expected)) == planted
    (tmp_path / "year=2002" / "a.csv").write_text("id;tap_FUN;other\n")
    assert rows(op.column_contract(layouts(), "year", expected)) == sorted([*planted, (2002, "other", "extra"), (2002, "tab_MED", "missing")])


def test_map_to_layout_prefers_names_then_first_position(spark):
    official = spark.createDataFrame([("3_CAT_FUN",), ("3_CAT_MED",), ("1_CAT_FUN",), ("NO_ENTIDADE",)], "column string")
    groups = spark.createDataFrame([(1, "tab_FUN", 2), (1, "TAB_FUN", 1), (1, "3_CAT_MED", 4), (1, "tab_MED", 3), (2, "x", 1)], "year int, column string, ordinal int")
    assert rows(op.map_to_layout(groups, official, "year")) == [(1, "3_CAT_FUN", "TAB_FUN", 2), (1, "3_CAT_MED", "3_CAT_MED", 1)]


def test_rate_names_agree_with_the_list_form(spark):
    names = ["tap_FUN", "TAP_FUN", "1_CAT_MED", "4_CAT_MED", "x tap_FUN", "Aprovação - Anos Finais", "APROVAÇÃO - ANOS", "reprovação", "Taxa de Abandono", "tax", "", "3_CAT_"]
    found = spark.createDataFrame([(n,) for n in names], "column string").where(op.is_rate_name("column"))
    assert [r[0] for r in found.collect()] == select_rate_columns(names)


def test_parquet_kinds_rows_and_contract(spark, tmp_path):
    for year, file, table in [
        (1, "a", {"id": pa.array([1, 2]), "ab": pa.array([1.0, None]), "t": pa.array(["x", "y"])}),
        (1, "b", {"id": pa.array([3]), "ab": pa.array(["1,0"]), "t": pa.array(["z"])}),
        (2, "a", {"id": pa.array([], pa.int32()), "t": pa.array([], pa.string()).dictionary_encode(), "d": pa.array([], pa.date32()), "ok": pa.array([], pa.bool_()), "l": pa.array([], pa.list_(pa.int8()))}),
    ]:
        (tmp_path / f"year={year}").mkdir(exist_ok=True)
        pq.write_table(pa.table(table), tmp_path / f"year={year}" / f"{file}.parquet")
    names = by_year(src.parquet_names(spark, str(tmp_path)))
    layouts = op.layout(names, "year")
    assert rows(layouts.select("year", "column", "kind", "files")) == [
        (1, "ab", "mixed", 2), (1, "id", "number", 2), (1, "t", "text", 2),
        (2, "d", "time", 1), (2, "id", "number", 1), (2, "l", "other", 1), (2, "ok", "flag", 1), (2, "t", "text", 1),
    ]
    assert {r["file"].rsplit("/", 2)[1][-1] + r["file"][-9]: r["rows"] for r in names.collect()} == {"1a": 2, "1b": 1, "2a": 0}
    contract = op.kind_contract(layouts, "year", {"id": "number", "ab": "number"})
    assert rows(contract.where("status <> 'ok'").select("year", "column", "status", F.coalesce("found", F.lit("-")))) == [(1, "ab", "fail", "mixed"), (2, "ab", "fail", "-")]
    leaks = op.leaked_columns(names, spark.createDataFrame([("ab",), ("ok",)], "column string"), "year")
    assert rows(leaks) == [(1, "ab"), (2, "ok")]


def test_compressed_header(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("a,b,c\n1,2,3\n")
    found = src.delimited_names(spark, str(tmp_path), min_cols=3, glob="*.csv.gz")
    assert rows(found.select("ordinal", "column", "kind")) == [(1, "a", "text"), (2, "b", "text"), (3, "c", "text")]
