"""Linear models from yearly sums of products against plain least squares on the rows of each fold."""

import numpy as np
import pytest

from annalis.operators import linear
from annalis.spec import PanelSpec

SPEC = PanelSpec("e", "year")
RUNS = [linear.Run(2003), linear.Run(2005), linear.Run(2005, "without 2002, 2003", (2002, 2003)), linear.Run(2005, "late", (), 2002), linear.Run(2000)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(900):
        year = 2000 + k % 6
        x1, x2 = (None if rng.random() < 0.2 else float(rng.normal(50, 9))), float(rng.integers(0, 5))
        x3 = float("nan") if k % 11 == 0 else (None if year < 2004 else float(rng.normal()))  # NULL in all training rows of 2003
        level = [None, "b", "c", "d"][int(rng.integers(0, 4 if year == 2005 else 3))]  # d is never trained on
        y = None if k % 17 == 0 else 3 + 0.2 * (x1 or 45) - x2 + (level == "b") + float(rng.normal())
        rows.append((k, year, x1, x2, x3, level, y))
    return rows, spark.createDataFrame(rows, "e int, year int, x1 double, x2 double, x3 double, level string, y double").repartition(5)


def by_hand(rows, run, penalty):
    bad = lambda v: v is None or np.isnan(v)
    train = [r for r in rows if run.trains_on(r[1]) and r[6] is not None]
    test = [r for r in rows if r[1] == run.fold and r[6] is not None]
    fills = []
    for j in (2, 3, 4):
        known = [r[j] for r in train if not bad(r[j])]
        fills.append(np.median(known) if known else 0.0)
    names = ["Missing", "b", "c", "d"]
    features = lambda some: np.array([[fills[j] if bad(r[2 + j]) else r[2 + j] for j in range(3)] + [float((r[5] or "Missing") == v) for v in names] for r in some])
    x, y, z = features(train), np.array([r[6] for r in train]), features(test)
    mean, sd = x.mean(0), x.std(0)
    sd[3:] = 1
    sd[sd == 0] = 1
    a = (x - mean) / sd
    full = np.vstack([a, np.sqrt(penalty) * np.eye(7)]), np.append(y - y.mean(), np.zeros(7))
    beta = np.linalg.lstsq(*full, rcond=1e-8)[0]
    return {r[0]: y.mean() + ((v - mean) / sd) @ beta for r, v in zip(test, z)}


@pytest.mark.parametrize("model", ["ridge", "ols"])
def test_all_runs_against_plain_rows(table, model):
    rows, df = table
    found = linear.walk_forward(df, "y", ["x1", "x2", "x3"], ["level"], RUNS, SPEC, {model: linear.PENALTIES[model]}).collect()
    assert {(r["fold"], r["run"]) for r in found} == {(r.fold, r.name) for r in RUNS[:-1]}  # the first year has nothing to train on
    for run in RUNS[:-1]:
        want = by_hand(rows, run, linear.PENALTIES[model])
        got = {r["e"]: r["pred"] for r in found if (r["fold"], r["run"]) == (run.fold, run.name)}
        seen = {k for k in want if model == "ridge" or rows[k][5] != "d"}  # least squares has no one answer for a level it never saw
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in seen)


def test_small_runs_are_left_out(table):
    _, df = table
    fits, _ = linear.fit_all(df, "y", ["x2"], [], RUNS, SPEC, min_train=400)
    sizes = {(r.fold, r.name): sum(x[6] is not None and r.trains_on(x[1]) for x in table[0]) for r in RUNS}
    assert {(f.run.fold, f.run.name): f.rows for f in fits} == {k: n for k, n in sizes.items() if n >= 400}


def test_levels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(linear, "MAX_LEVELS", 3)
    df = spark.range(10).selectExpr("cast(id AS int) AS e", "2000 AS year", "cast(id AS string) AS c", "1.0D AS y")
    with pytest.raises(ValueError, match="more than 3 levels"):
        linear.fit_all(df, "y", [], ["c"], [linear.Run(2001)], SPEC)
