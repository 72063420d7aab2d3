"""Sheets, layouts, delimited files, stages, and the whole panel build."""

import pytest
from pyspark.sql import functions as F

from annalis.catalog import adapters, sheets
from annalis.operators import profile, select, sets
from annalis.plans import panel_build
from annalis.sources import delimited, discover, layouts, raw

SF = "/root/testdata/sf0.001"


def raw_table(spark, rows):
    return spark.createDataFrame([("f", "s", i, r) for i, r in enumerate(rows)], "file string, sheet string, row_no int, cells array<string>")


def test_header_with_one_technical_line_beats_two_lines(spark):
    spelled = ["Ano"] + ["x"] * 44
    technical = ["NU_ANO_CENSO", "CO_ENTIDADE"] + [f"tap_{i}" for i in range(43)]
    got = raw.detect_header(raw_table(spark, [["t"] + [None] * 44, spelled, ["y"] * 45, technical, ["1"] * 45])).first()
    assert (got["header_row"], got["header_lines"]) == (3, 1)


def test_header_needs_enough_cells_and_early_rows(spark):
    technical = ["NU_ANO_CENSO", "CO_ENTIDADE"] + [f"tap_{i}" for i in range(43)]
    assert raw.detect_header(raw_table(spark, [technical[:30]])).count() == 0
    assert raw.detect_header(raw_table(spark, [[None] * 45] * 30 + [technical])).count() == 0


def test_two_line_names_and_repetitions(spark):
    rows = [["Ano", "Taxa", "Taxa", None, "·"] + ["a"] * 40, ["·", "1ª", "1ª", "só", "--"] + [str(i) for i in range(40)], [None] * 45, ["2010", "1", "2", "3", "4"] + ["5"] * 40]
    cells = raw_table(spark, rows)
    names = raw.build_header_names(cells, raw.detect_header(cells, min_first=4))
    assert names.first()["names"][:5] == ["Ano", "Taxa - 1ª", "Taxa - 1ª__1", "só", "_col_4"]
    assert [r["row_no"] for r in raw.data_rows(cells, names).collect()] == [3]


def test_driver_side_dedup_matches_column_version(spark):
    names = ["a", "b", "a", "a", "b"]
    df = spark.createDataFrame([(names,)], "n array<string>")
    assert df.select(raw.dedup_names(F.col("n"))).first()[0] == ["a", "b", "a__1", "a__2", "b__1"]


def test_label_guard_stops(spark):
    names = sheets.header_lines(2019)[0]
    good = spark.createDataFrame([("f", "s", 2019, names)], "file string, sheet string, ANO int, names array<string>")
    layouts.assert_label(good)
    wrong = [n.replace("tab_F04", "tab_F58") for n in names]
    bad = spark.createDataFrame([("f", "s", 2019, wrong)], good.schema)
    with pytest.raises(layouts.LabelError, match="ABANDONO_FUN_AF"):
        layouts.assert_label(bad)


def test_pick_source_rules(spark):
    files = [("/d/a_2010.csv", "a_2010.csv", 10), ("/d/escola_2010.zip", "escola_2010.zip", 1), ("/d/b_2011.csv", "b_2011.csv", 5), ("/d/c_2011.csv", "c_2011.csv", 50), ("/d/z_2011.zip", "z_2011.zip", 500), ("/d/x_2005.csv", "x_2005.csv", 1)]
    df = spark.createDataFrame(files, "path string, name string, length long")
    assert {(r["year"], r["name"]) for r in discover.pick_source(df).collect()} == {(2010, "escola_2010.zip"), (2011, "c_2011.csv")}


def test_listing_does_not_read_contents(spark, tmp_path):
    (tmp_path / "tx_rend_escolas_2010.zip").write_bytes(b"x" * 100)
    files = discover.list_files(spark, str(tmp_path))
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert files.first()["length"] == 100


def test_sniff_and_scope(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_bytes("ANO|SG_UF|CO_ENTIDADE|IN_INTERNET|NO\n2012|RR|14|1|São João\n2012|AM|15|1|x\n".encode("latin1"))
    sep = delimited.sniff_delimiter(spark, str(path))
    assert sep == "|"
    df = delimited.scan_delimited(spark, str(path), sep)
    out = delimited.census_year(df, 2012)
    assert [(r["CO_ENTIDADE"], r["IEP_internet"], r["IDA_despensa"]) for r in out.collect()] == [("14", 1.0, None)]
    assert df.where("CO_ENTIDADE = '14'").first()["NO"] == "São João"


def test_drifting_union_and_differences(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(2, "y")], "k int, b string")
    assert sets.union_drifting([a, b]).columns == ["k", "a", "b"]
    assert sets.tables_equal(a, a) and not sets.tables_equal(a, a.union(a))


def test_leakage_and_names():
    with pytest.raises(ValueError):
        select.assert_no_leakage(["x", "ABANDONO_MED_T1"])
    assert profile.name_leaks(["ABANDONO_FUN", "x"], ["ABANDONO_FUN_AF_T1"]) == [("ABANDONO_FUN", "ABANDONO_FUN_AF_T1")]
    assert select.select_rate_columns(["tap_FUN", "3_CAT_MED", "Taxa de X", "reprovação"]) == ["tap_FUN", "3_CAT_MED", "Taxa de X"]
    assert profile.match_columns(["IN_AGUA", "IN_AGUA_POCO"], ["IN_AGUA", "AGUA"]) == {"IN_AGUA": ["IN_AGUA"], "AGUA": ["IN_AGUA", "IN_AGUA_POCO"]}


def test_panel_build_recovers_the_source_panel(spark, tmp_path):
    cells = sheets.raw_sheets(spark, SF)
    census = spark.createDataFrame([("RR", str(e), "1", "0") for e in range(0, 10, 2)], "SG_UF string, CO_ENTIDADE string, IN_INTERNET string, IN_AGUA_POTAVEL string")
    base = panel_build.build_panel(cells, {2016: census, 2019: census}, str(tmp_path / "p"))
    assert len(base.columns) == 47
    got = {(r["ANO"], r["CO_ENTIDADE"]): (r["ABANDONO_FUN"], r["ABANDONO_FUN_AF"], r["DEPENDENCIA"], r["IEP_internet"]) for r in base.collect()}
    want = {}
    for r in adapters.supplier_panel(spark, SF).where("entity % 2 = 0").collect():
        year = sheets.SHEET_YEARS[r["year"]]
        want[(year, str(r["entity"]))] = (r["ab"], r["ab_f"], r["dependency"], 1.0 if year in (2016, 2019) else None)
    assert got == want
    checks = panel_build.validate(spark, str(tmp_path / "p"), years=7, last_year=2022).collect()
    failed = {(r["check_name"], r["subject"]) for r in checks if r["status"] == "fail"}
    assert ("unique key", "04") not in failed and ("identical to the last stage", "published") not in failed
    assert len([r for r in checks if r["status"] == "ok"]) > 29
    # The made-up ids are short, so the id format check must speak up.
    assert ("format", "CO_ENTIDADE") in failed


def facts_by_hand(rows, most):
    out = {}
    for file, sheet, _, cells in rows:
        for pos, x in enumerate(cells or []):
            v = None if x is None else x.strip(" ").upper()
            f = out.setdefault((file, sheet, pos), [set(), 0, 0, 0])
            f[0].add(v)
            f[1] += v == "RR"
            f[2] += v in ("14", "14.0", "+14", "014", "1.4E1")
            f[3] += v is not None and "RORAIMA" in v
    return {k: (v[0] if len(v[0]) <= most else most + 1, *v[1:]) for k, v in out.items()}


def test_position_facts_against_plain_sets(spark):
    """Two sheets over several partitions, a column of names, cells of all spellings, short and missing rows."""
    some = ["RR", " rr ", "14", "14.0", "+14", "014", "1.4e1", "Nova Roraima", None, "", "x14", "14 15", "é", "nan"]
    rows = [("f", "st"[k % 2], k, [some[k % 14], f"name {k}", some[(k * 5) % 3]] + ["z"] * (k % 3)) for k in range(300)] + [("f", "s", 300, None), ("f", "t", 301, [])]
    df = spark.createDataFrame(rows, "file string, sheet string, row_no int, cells array<string>").repartition(7)
    got = {(r["file"], r["sheet"], r["pos"]): r for r in raw.position_facts(df, 20).collect()}
    want = facts_by_hand(rows, 20)
    assert got.keys() == want.keys()
    for key, (values, letters, numbers, named) in want.items():
        r = got[key]
        assert (r["letters"], r["numbers"], r["named"]) == (letters, numbers, named)
        assert len(r["values"]) == values if isinstance(values, int) else set(r["values"]) == values
    assert raw.position_facts(df.limit(0)).count() == 0


def test_number_cells_are_those_of_spark(spark):
    """The cells that facts count as the numeric code are those that the filter keeps."""
    cells = ["14", "14.0", " 14 ", "+14", "14.", "1.4E1", "14x", "1 4", "", "0014", "-14", ".14e2", "14e0"]
    df = spark.createDataFrame([("f", "s", 0, [c]) for c in cells], "file string, sheet string, row_no int, cells array<string>")
    scope = spark.createDataFrame([("f", "s", "number", 0, "CO_UF")], "file string, sheet string, method string, pos int, column string")
    assert raw.position_facts(df).first()["numbers"] == raw.filter_entity_scope(df, scope).count()


def test_scope_detection_makes_no_row_per_cell(spark):
    df = spark.createDataFrame([("f", "s", 0, ["RR"])], "file string, sheet string, row_no int, cells array<string>")
    names = spark.createDataFrame([("f", "s", ["UF"])], "file string, sheet string, names array<string>")
    for found in (raw.scope_per_sheet(df, names), raw.detect_domain_column(raw.position_facts(df), names, ["RR"])):
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_years_of_both_generations_in_one_scan(spark):
    """The same rows as year by year, from one scan."""
    names = [(pn + n, pv + v) for pn, pv, _ in delimited.fv.SEGMENT_PREFIXES for n, v in zip(delimited.fv.SEGMENTS_NEW, delimited.fv.SEGMENTS_OLD)]
    rows = [(2019, 1), (2020, 2), (2021, 3), (2022, 4)]
    df = spark.createDataFrame(rows, "year int, e int").select(
        "year", "e", *[F.when(F.col("year") >= 2021, F.col("e") * 100 + k).cast("string").alias(n) for k, (n, _) in enumerate(names)],
        *[F.when(F.col("year") < 2021, F.col("e") * 100 + k).cast("string").alias(o) for k, (_, o) in enumerate(names)])
    once = delimited.position_rename_all(df, F.col("year"), [F.col("e")])
    by_year = sets.union_years([delimited.position_rename(df.where(F.col("year") == y), y, [F.col("e")]) for y, _ in rows])
    assert sets.tables_equal(once, by_year.select(once.columns))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
