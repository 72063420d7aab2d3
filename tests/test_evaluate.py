"""Metrics, folds, intervals and models against plain definitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from annalis import PanelSpec
from annalis.operators import evaluate as ev
from annalis.operators import models, ranking

SPEC = PanelSpec("e", "y")


def brute_auc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def brute_ap(s, y):
    total, out, last = y.sum(), 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = y[hit].sum() / total
        out += (recall - last) * y[hit].mean()
        last = recall
    return out


def test_classification_metrics(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(200) < 0.2).astype(int)
    s = np.round(rng.random(200) * 0.6 + 0.3 * y, 1)
    df = spark.createDataFrame([("m", float(a), int(b), int(a >= 0.5)) for a, b in zip(s, y)], "model string, score double, label int, flagged int")
    got = ev.classification_metrics(df, ["model"]).first()
    f = s >= 0.5
    assert got["roc_auc"] == pytest.approx(brute_auc(s, y))
    assert got["pr_auc"] == pytest.approx(brute_ap(s, y))
    assert got["precision"] == pytest.approx(y[f].mean())
    assert got["recall"] == pytest.approx(y[f].sum() / y.sum())


def test_no_predicted_positives_gives_zero(spark):
    df = spark.createDataFrame([(1, 0.1, 1, 0), (1, 0.2, 0, 0)], "g int, score double, label int, flagged int")
    got = ev.classification_metrics(df, ["g"]).first()
    assert (got["precision"], got["recall"], got["f1"]) == (0.0, 0.0, 0.0)


def test_recall_at_k_skips_long_lists_and_no_positives(spark):
    df = spark.createDataFrame([("a", i, float(i), int(i in (9, 8, 1))) for i in range(10)] + [("b", i, float(i), 0) for i in range(10)], "g string, e int, s double, l int")
    got = {(r["g"], r["k"]): r for r in ranking.recall_at_k(df, ["g"], "s", "l", ["e"], [2, 5, 50]).collect()}
    assert set(got) == {("a", 2), ("a", 5), ("b", 2), ("b", 5)}
    assert got[("a", 2)]["recall_at_k"] == pytest.approx(2 / 3)
    assert got[("b", 2)]["recall_at_k"] is None and got[("b", 2)]["lift"] is None


def test_constant_prediction_has_null_spearman(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0), ("c", 2.0, 2.0)], "m string, y double, pred double")
    assert ev.regression_metrics(df, ["m"]).first()["spearman"] is None


def test_bootstrap_interval_is_close_to_resampling(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(10, 3, 300)
    p = y + rng.normal(0, 2, 300)
    df = spark.createDataFrame([("m", i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "m string, e int, y double, pred double")
    got = ev.bootstrap_ci(df, ["m"], "e", replicates=600).first()
    draws = [rng.integers(0, 300, 300) for _ in range(2000)]
    mae = [np.abs(p[d] - y[d]).mean() for d in draws]
    r2 = [1 - ((p[d] - y[d]) ** 2).sum() / ((y[d] - y[d].mean()) ** 2).sum() for d in draws]
    for name, ref, tol in (("mae", mae, 0.06), ("r2", r2, 0.03)):
        assert got[f"{name}_low"] == pytest.approx(np.percentile(ref, 2.5), abs=tol)
        assert got[f"{name}_high"] == pytest.approx(np.percentile(ref, 97.5), abs=tol)


def test_resample_weights_are_poisson(spark):
    df = spark.range(20000).withColumn("k", F.col("id"))
    w = ev.with_resample_weight(df, F.col("k"), F.lit(3), 42, "w").groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 20000 for r in w}
    assert share[0] == pytest.approx(np.exp(-1), abs=0.015)
    assert share[1] == pytest.approx(np.exp(-1), abs=0.015)
    assert share[2] == pytest.approx(np.exp(-1) / 2, abs=0.015)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    rows = []
    for e in range(120):
        base = rng.normal(10, 3)
        for y in range(2018, 2023):
            x = base + rng.normal(0, 1)
            rows.append((e, y, float(x), float(rng.normal()), None if y == 2018 else float(x / 2), "ab"[e % 2] if y < 2022 else "abc"[e % 3], float(2 * x + rng.normal(0, 1))))
    return pd.DataFrame(rows, columns=["e", "y", "x", "z", "lag", "cat", "t"]), spark.createDataFrame(rows, "e int, y int, x double, z double, lag double, cat string, t double")


def test_baselines_use_training_years_only(panel):
    pdf, df = panel
    got = {(r["fold"], r["model"]): r["p"] for r in ev.baselines(df, "t", "lag", [2020, 2021], SPEC).groupBy("fold", "model").agg(F.first("pred").alias("p")).collect()}
    for f in (2020, 2021):
        tr = pdf[pdf.y < f]
        assert got[(f, "mean")] == pytest.approx(tr.t.mean())
        assert got[(f, "median")] == pytest.approx(tr.t.median())


def test_folds_need_enough_rows(panel):
    _, df = panel
    assert [r["fold"] for r in ev.walk_forward_folds(df, SPEC).orderBy("fold").collect()] == [2019, 2020, 2021, 2022]
    assert ev.walk_forward_folds(df, SPEC, min_train=300).count() == 2


def test_ridge_equals_closed_form(panel):
    pdf, df = panel
    train, test = ev.temporal_split(df, 2022, "y")
    n, sd = models.label_stats(train, "t")
    model = models.fit(train, "t", {"r": models.ridge(n, sd)}, ["x", "z"], [])["r"]
    got = {r["e"]: r["pred"] for r in model.predict(test).collect()}
    tr, te = pdf[pdf.y < 2022], pdf[pdf.y == 2022]
    mu, s = tr[["x", "z"]].mean(), tr[["x", "z"]].std(ddof=0)
    X = ((tr[["x", "z"]] - mu) / s).to_numpy()
    b = np.linalg.solve(X.T @ X + np.eye(2), X.T @ (tr.t - tr.t.mean()))
    want = tr.t.mean() + ((te[["x", "z"]] - mu) / s).to_numpy() @ b
    assert [got[e] for e in te.e] == pytest.approx(list(want), abs=1e-6)


def test_unknown_category_is_all_zero_and_empty_column_is_dropped(panel):
    _, df = panel
    train, test = df.where("y = 2018"), df.where("y = 2022")
    pre = models.Preprocessor.fit(train, ["x", "lag"], ["cat"])
    assert pre.numeric == ["x"]
    assert pre.feature_owners() == ["x", "cat", "cat"]
    for r in pre.transform(test).select("cat", "features").collect():
        assert list(r["features"].toArray()[1:]) == {"a": [1, 0], "b": [0, 1], "c": [0, 0]}[r["cat"]]


def test_permutation_importance_finds_the_used_column(panel):
    _, df = panel
    train, test = ev.temporal_split(df, 2022, "y")
    n, sd = models.label_stats(train, "t")
    fitted = models.fit(train, "t", {"r": models.ridge(n, sd)}, ["x", "z"], ["cat"])["r"]
    got = {r["column"]: r["mean_drop"] for r in models.permutation_importance(fitted, test, "t", ["e", "y"], repeats=6).collect()}
    assert got["x"] > 1.0 and abs(got["z"]) < 0.05


def test_random_split_is_stable(spark):
    df = spark.range(5000).withColumn("y", F.lit(2020))
    a = ev.random_split(df, ["id", "y"]).where("part = 'test'")
    assert 900 < a.count() < 1100
    assert a.exceptAll(ev.random_split(df.repartition(7), ["id", "y"]).where("part = 'test'")).count() == 0
