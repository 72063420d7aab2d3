"""Distributed order statistics: forced value ranges must agree with NumPy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from annalis.operators import order


@pytest.fixture(scope="module")
def values(spark):
    """Two groups; a third of all rows is one tied value in one hot group."""
    rng = np.random.default_rng(3)
    g = np.where(rng.random(3000) < 0.8, "hot", "cold")
    x = np.where(rng.random(3000) < 0.4, 0.0, rng.lognormal(1, 2, 3000).round(3))
    y = np.where(rng.random(3000) < 0.3, 0.0, (x + rng.normal(0, 5, 3000)).round(1))
    pdf = pd.DataFrame({"i": range(3000), "g": g, "x": x, "y": y})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_quantiles(values, ranges):
    pdf, df = values
    probs = {"a": 0.05, "b": 0.5, "c": 0.8, "d": 1.0}
    got = {r["g"]: [r[k] for k in probs] for r in order.quantiles(df, ["g"], "x", probs, ranges=ranges).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part.x, list(probs.values())))


@pytest.mark.parametrize("descending", [False, True])
def test_many_ranges_equal_one(values, descending):
    _, df = values
    counted = order.tally(df, ["g"], "x", {"s": F.col("y")})
    assert len(order.value_ranges(counted, "x", 40)) > 5
    one, many = (
        order.running_totals(counted, ["g"], "x", ["n", "s"], descending=descending, ranges=k).toPandas().sort_values(["g", "x"]).reset_index(drop=True)
        for k in (1, 40)
    )
    pd.testing.assert_frame_equal(one, many[one.columns], check_exact=False)


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_spearman(values, ranges):
    pdf, df = values
    got = {r["g"]: r["spearman"] for r in order.spearman(df, ["g"], "x", "y", ranges=ranges).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(part.x.rank().corr(part.y.rank()))


def test_spearman_of_constant_or_few_rows_is_null(spark):
    df = spark.createDataFrame([("c", 1.0, 1.0), ("c", 1.0, 2.0), ("f", 1.0, 2.0), ("f", 2.0, 3.0)], "g string, x double, y double")
    assert {r["g"]: r["spearman"] for r in order.spearman(df, ["g"], "x", "y").collect()} == {"c": None, "f": pytest.approx(1.0)}
    assert {r["spearman"] for r in order.spearman(df, ["g"], "x", "y", min_rows=3).collect()} == {None}


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0)], "v double").withColumn("g", F.lit(1))
    got = sorted((r["v"], r["r"], r["r_of"]) for r in order.with_average_ranks(df, ["g"], {"v": "r"}).collect())
    assert got == [(1.0, 1.0, 4), (2.0, 2.0, 4), (3.0, 3.5, 4), (3.0, 3.5, 4)]


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_average_ranks_of_two_values_at_once(values, ranges):
    """A third of the rows shares a value, and most values of the small group are cut points of the large one."""
    pdf, df = values
    rows = order.with_average_ranks(df.select("i", "g", "x", "y"), ["g"], {"x": "rx", "y": "ry"}, ranges=ranges)
    got = rows.toPandas().set_index("i").sort_index()
    for v in "xy":
        assert np.array_equal(got[f"r{v}"], pdf.groupby("g")[v].rank())
        assert (got[f"r{v}_of"] == pdf.groupby("g")[v].transform("size")).all()
    assert order.with_average_ranks(df.limit(0), ["g"], {"x": "rx"}, ranges=ranges).count() == 0


def test_ranks_join_no_row_on_its_value(values):
    _, df = values
    plan = order.spearman(df, ["g"], "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 2 and not any("_x#" in j or "_y#" in j for j in joins)


def test_top_k_ties_go_by_entity(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 5.0), (4, 5.0), (5, None)], "e int, s double")
    assert [r["e"] for r in order.top_k(df, [], "s", 3, ["e"]).orderBy("position").collect()] == [2, 1, 3]
    assert [r["e"] for r in order.top_k(df, [], "s", 2, ["e"], ascending=True).orderBy("position").collect()] == [1, 3]


def test_top_k_limits_groups_before_the_shuffle(values):
    _, df = values
    plan = order.top_k(df, ["g"], "x", 5, ["i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_quantiles_of_empty_groups_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "g string, v double")
    assert [(r["g"], r["m"]) for r in order.quantiles(df, ["g"], "v", {"m": 0.5}).collect()] == [("a", 1.5)]


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_nan_counts_as_null(spark, partitions):
    df = spark.range(1000).select(F.lit("g").alias("g"), F.when(F.col("id") % 10 == 0, F.lit("NaN").cast("double")).otherwise(F.col("id").cast("double")).alias("x"))
    want = np.quantile([k for k in range(1000) if k % 10], 0.5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert order.quantiles(df, ["g"], "x", {"m": 0.5}).first()["m"] == pytest.approx(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
