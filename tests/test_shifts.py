"""Exact-year shifts against row shifts on a panel with gaps."""

import pytest
from pyspark.sql import functions as F

from annalis import PanelSpec
from annalis.operators import profile, reconcile, shifts
from annalis.session import staged

SPEC = PanelSpec("e", "y")


@pytest.fixture
def gap(spark):
    return spark.createDataFrame([(1, 2000, 5.0), (1, 2001, 6.0), (1, 2003, 8.0), (2, 2001, None), (2, 2002, 4.0)], "e int, y int, v double")


def rows(df, *cols):
    return {(r["e"], r["y"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_exact_and_row_lag_differ_on_gaps(gap):
    out = gap.withColumns({"exact": shifts.at_year_offset("v", -1, SPEC), "row": shifts.row_lag("v", 1, SPEC)})
    got = rows(out, "exact", "row")
    assert got[(1, 2003)] == (None, 6.0)
    assert got[(1, 2001)] == (5.0, 5.0)
    assert got[(2, 2002)] == (None, None)


def test_target_year_needs_a_row_not_a_value(gap):
    got = rows(gap.withColumn("t", shifts.target_year(SPEC)), "t")
    assert got == {(1, 2000): (2001,), (1, 2001): (None,), (1, 2003): (None,), (2, 2001): (2002,), (2, 2002): (None,)}


def test_guarded_lead_two_rows_ahead(spark):
    df = spark.createDataFrame([(1, 2000, 1.0), (1, 2001, 2.0), (1, 2002, 3.0), (2, 2000, 1.0), (2, 2002, 3.0)], "e int, y int, v double")
    got = rows(df.withColumn("h2", shifts.guarded_lead("v", 2, SPEC)), "h2")
    assert got[(1, 2000)] == (3.0,)
    assert got[(2, 2000)] == (None,)  # two rows ahead does not exist, although 2002 does


def test_history(gap):
    out = gap.withColumns({"m": shifts.expanding_mean("v", SPEC), "r": shifts.rolling_mean_rows("v", 3, SPEC), "m3": shifts.recent_mean("v", 3, SPEC)})
    got = rows(out, "m", "r", "m3")
    assert got[(1, 2003)] == pytest.approx((19 / 3,) * 3)
    assert got[(2, 2001)] == (None, None, None)


def test_longitudinal_is_one_shuffle(gap):
    out = shifts.longitudinal(gap, ["v"], ["v"], ["v"], SPEC)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_missing_targets_are_absent(gap):
    p = gap.withColumn("t", shifts.target_year(SPEC))
    assert reconcile.present_despite_missing_target(p, "t", SPEC).count() == 0


def test_missing_targets_are_not_looked_up_by_broadcast(gap):
    """The keys of all rows are one side of the join, however small they look as a file."""
    p = gap.withColumn("t", shifts.target_year(SPEC))
    wrong = p.withColumn("t", F.when(F.expr("NOT (e = 1 AND y = 2000)"), F.col("t")))
    wrong = reconcile.present_despite_missing_target(staged(wrong, "targets"), "t", SPEC)
    assert "Broadcast" not in wrong._jdf.queryExecution().executedPlan().toString()
    assert [(r["e"], r["y"]) for r in wrong.collect()] == [(1, 2000)]


def test_churn_and_balance(gap):
    churn = {r["y"]: (r["entries"], r["exits"]) for r in profile.entity_churn(gap, SPEC).collect()}
    assert churn == {2000: (1, 0), 2001: (0, 1), 2002: (1, 1)}
    assert {r["years"]: r["entities"] for r in profile.panel_balance(gap, SPEC).collect()} == {3: 1, 2: 1}


def test_one_to_one_join_stops_on_repeated_key(spark):
    a = spark.createDataFrame([(1, 1)], "k int, a int")
    b = spark.createDataFrame([(1, 2), (1, 3)], "k int, b int")
    with pytest.raises(reconcile.RepeatedKeyError):
        reconcile.enrich_left_1to1(a, b, ["k"])


@pytest.mark.parametrize("left,right", [([(1, 1), (1, 2)], [(1, 2)]), ([(1, 1)], [(1, 2), (1, 2)]), ([(1, 1)], [(2, 2), (2, 3)]), ([(None, 1), (None, 2)], [(1, 2)])])
def test_join_1to1_stops_by_itself_on_a_repeated_key(spark, left, right):
    a, b = spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b int")
    with pytest.raises(Exception, match="one-to-one join: key k repeats"):
        reconcile.join_1to1(a, b, ["k"]).collect()


def test_join_1to1_is_a_left_join_in_one_shuffle(spark):
    a = spark.createDataFrame([(1, "x", 1, None), (2, "x", 2, 2.0), (None, "y", 3, 3.0), (4, None, 4, 4.0)], "k int, j string, a int, b double")
    b = spark.createDataFrame([("x", 1, 1.5), ("x", 2, None), ("y", None, 9.0), ("z", 7, 7.0)], "j string, k int, b_r double")
    got = reconcile.join_1to1(a, b, ["k", "j"])
    expected = a.join(b, ["k", "j"], "left")
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert sorted(map(str, reconcile.join_1to1(a.select("k", "j"), b.limit(0), ["k", "j"]).collect())) == sorted(map(str, a.select("k", "j").join(b.limit(0), ["k", "j"], "left").collect()))
