"""Cleaning, rounding and count reconstruction against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from annalis.functions import scalar as sc


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_half_even(spark):
    assert column(spark, [0.5, 1.5, 2.5, -0.5, 3.49], sc.half_even("v"), "double") == [0, 2, 2, 0, 3]


def test_strict_rate(spark):
    assert column(spark, ["12.5", "--", None, "0"], sc.clean_rate_strict("v")) == [12.5, None, None, 0.0]


def test_strict_rate_stops_on_other_text(spark):
    with pytest.raises(Exception, match="not a rate"):
        column(spark, ["1", "n/d"], sc.clean_rate_strict("v"))


def test_lenient_number(spark):
    assert column(spark, ["1.5", " 2 ", "x", "", "nan", None], sc.to_number_lenient("v")) == [1.5, 2.0, None, None, None, None]


def test_normalise_id(spark):
    assert column(spark, ["14000040", " 14000040 ", "14000040.0", "0007", "abc"], sc.normalise_id("v")) == ["14000040", "14000040", "14000040", "7", None]


def test_category(spark):
    assert column(spark, [" Particular ", "Estadual", None], sc.canonical_category("v")) == ["Privada", "Estadual", None]


@pytest.mark.parametrize("name,key", [
    ("1_CAT_FUN", "TAP_FUN"), ("tab_F04", "TAB_F04"), ("TRE_MED", "TRE_MED"), ("Taxa de Abandono - Anos Finais", "TAB_FUN_AF"),
    ("aprovacao_ai", "TAP_FUN_AI"), ("Reprovação Ensino Médio", "TRE_MED"), ("abandono_medio_03", "TAB_MED_03"), ("NO_ENTIDADE", None), ("Aprovação na 1ª série", None),
])
def test_semantic_key(spark, name, key):
    assert column(spark, [name], sc.semantic_key("v")) == [key]


def test_coalesce_candidates_uses_existing_columns(spark):
    df = spark.createDataFrame([("1", None), (None, "0"), ("x", "1")], "a string, b string")
    got = df.select(sc.coalesce_candidates(["MISSING", "A", "B"], df.columns).alias("v"), sc.coalesce_candidates(["Z"], df.columns).alias("z")).collect()
    assert [tuple(r) for r in got] == [(1.0, None), (0.0, None), (1.0, None)]


def test_grade_enrolment_is_null_only_without_parts(spark):
    df = spark.createDataFrame([(2024, 9, None, None), (2024, 9, 3, None), (2025, 9, 3, 4)], "y int, s int, a int, b int")
    assert [r[0] for r in df.select(sc.grade_enrolment("y", 2025, "s", ["a", "b"])).collect()] == [None, 3.0, 9.0]


def python_denominator(ap, rp, ab, n0, window=0.35, tol=0.051):
    """The definition, one candidate after the other."""
    if None in (ap, rp, ab, n0) or n0 <= 0:
        return None
    hits = []
    for n in range(max(1, math.floor(n0 * (1 - window)) - 2), math.ceil(n0 * (1 + window)) + 3):
        b, r = round(ab * n / 100), round(rp * n / 100)
        parts = ((n - b - r, ap), (r, rp), (b, ab))
        if n - b - r >= 0 and all(abs(100 * k / n - rate) <= tol for k, rate in parts):
            hits.append((abs(n - n0), n))
    return min(hits)[1] if hits else None


def test_denominator_known_cases(spark):
    df = spark.createDataFrame([(85.0, 10.0, 5.0, 40), (89.7, 7.2, 3.1, 101), (50.0, 10.0, 3.0, 40), (85.0, 10.0, 5.0, 0)], "ap double, rp double, ab double, n0 int")
    assert [r[0] for r in df.select(sc.reconstruct_denominator("ap", "rp", "ab", "n0")).collect()] == [40, 97, None, None]


def test_denominator_matches_definition(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        n = rng.choice([rng.randint(1, 60), rng.randint(1, 900)])
        b = rng.randint(0, n)
        r = rng.randint(0, n - b)
        rates = [round(100 * k / n, 1) for k in (n - b - r, r, b)]
        rows.append((*rates, max(1, int(n * rng.uniform(0.6, 1.5)))))
    df = spark.createDataFrame(rows, "ap double, rp double, ab double, n0 int")
    got = [r[0] for r in df.select(sc.reconstruct_denominator("ap", "rp", "ab", "n0", near=5)).collect()]
    assert got == [python_denominator(*r) for r in rows]


def test_denominator_of_large_and_odd_sizes(spark):
    """Sizes beyond the region where a rate decides, impossible sums, ties, fractional sizes and
    rates of more decimals than the tolerance, with intervals far smaller than the range."""
    rng = random.Random(11)
    rows = [(50.0, 50.0, 0.0, 5001.0), (0.0, 50.0, 50.0, 6001.0), (0.0, 50.1, 50.0, 3000.0), (60.0, 30.0, 10.2, 4000.0), (70.0, 20.0, 9.949, 9000.0), (0.0, 33.3, 66.7, 10.5), (85.0, 10.0, 5.0, 30.5)]
    for _ in range(150):
        n = rng.choice([rng.randint(1, 40), rng.randint(500, 2500), rng.randint(3000, 9000)])
        b = rng.randint(0, n)
        r = rng.randint(0, n - b)
        digits = rng.choice([1, 1, 3])
        rates = [max(0.0, round(100 * k / n + rng.choice([0, 0, 0.1]), digits)) for k in (n - b - r, r, b)]
        rows.append((*rates, round(max(0.5, n * rng.uniform(0.6, 1.5)), 1)))
    df = spark.createDataFrame(rows, "ap double, rp double, ab double, n0 double")
    got = [r[0] for r in df.select(sc.reconstruct_denominator("ap", "rp", "ab", "n0", near=3, block=50)).collect()]
    assert got == [python_denominator(*r) for r in rows]


def test_denominator_of_a_billion(spark):
    rows = [(85.0, 10.0, 5.0, 10**9), (60.0, 30.0, 10.2, 10**9), (33.3, 33.3, 33.4, 10**9 + 7)]
    df = spark.createDataFrame(rows, "ap double, rp double, ab double, n0 bigint")
    assert [r[0] for r in df.select(sc.reconstruct_denominator("ap", "rp", "ab", "n0")).collect()] == [10**9, None, 10**9 + 7]


def test_flag_public_keeps_null(spark):
    assert column(spark, ["Privada", "Federal", None], sc.flag_public("v")) == [0, 1, None]


def test_row_mean_skips_null(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(sc.row_mean([F.col(c) for c in "abc"])).collect()] == [2.0, None]
