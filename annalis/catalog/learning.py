"""Queries of the fitted models. Trees run with few rounds here; the defaults are the full sizes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from annalis import fixed_values as fv
from annalis.catalog import adapters as ad
from annalis.catalog.adapters import FOLDS, SPEC
from annalis.catalog.aggregates import rounded
from annalis.catalog.ranking import FIRST, K, METRIC_SQL, REPLICATES, baseline_rows, scores
from annalis.catalog.registry import CTES, ORACLES, query
from annalis.functions.scalar import ratio
from annalis.operators import evaluate as ev
from annalis.operators import linear, models
from annalis.session import staged

LAST = max(FOLDS)
NUMERIC = ["ab_f", "ab", "tdi", "atu", "ab_f_LAG1"]
CATEGORIES = ["location", "dependency"]
TARGET = "ab_f_T1"


def panel(spark, sf):
    return ad.staged_longitudinal(spark, sf).where(F.col(TARGET).isNotNull())


def last_split(spark, sf):
    return ev.temporal_split(panel(spark, sf), LAST, "year")


def fitted(spark, sf, make):
    train, test = last_split(spark, sf)
    n, sd = models.label_stats(train, TARGET)
    return models.fit(train, TARGET, make(n, sd), NUMERIC, CATEGORIES), test


def predictions(spark, sf, make):
    out, test = fitted(spark, sf, make)
    parts = [m.predict(test).select("entity", "year", F.lit(name).alias("model"), F.round("pred", 6).alias("pred")) for name, m in out.items()]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


@query("m8_preprocess", f"""WITH t AS (SELECT * FROM lp WHERE {TARGET} IS NOT NULL AND year < {LAST}), f AS (SELECT quantile_cont(ab, 0.5) AS fa, quantile_cont(tdi, 0.5) AS ft FROM t),
    s AS (SELECT avg(coalesce(ab, fa)) AS ma, stddev_pop(coalesce(ab, fa)) AS sa, avg(coalesce(tdi, ft)) AS mt, stddev_pop(coalesce(tdi, ft)) AS st_t FROM t, f)
    SELECT entity, year, round((coalesce(ab, fa) - ma) / sa, 6) AS z_ab, round((coalesce(tdi, ft) - mt) / st_t, 6) AS z_tdi, CASE WHEN location = 'Urbana' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS urban
    FROM lp, f, s WHERE {TARGET} IS NOT NULL AND year = {LAST}""")
def preprocess(spark, sf):
    train, test = last_split(spark, sf)
    pre = models.Preprocessor.fit(train, ["ab", "tdi"], ["location"])
    at = pre.labels()[0].index("Urbana")
    out = pre.transform(test)
    return out.select("entity", "year", F.round("_z_ab", 6).alias("z_ab"), F.round("_z_tdi", 6).alias("z_tdi"), F.get(vector_to_array("_h_location"), F.lit(at)).alias("urban"))


@query("m9_ridge", f"""WITH t AS (SELECT *, {TARGET} AS y FROM lp WHERE {TARGET} IS NOT NULL AND year < {LAST}), f AS (SELECT quantile_cont(ab_f, 0.5) AS fa FROM t),
    s AS (SELECT avg(coalesce(ab_f, fa)) AS m1, stddev_pop(coalesce(ab_f, fa)) AS s1, avg(tdi) AS m2, stddev_pop(tdi) AS s2, avg(y) AS my, count(*) AS n FROM t, f),
    x AS (SELECT sum((coalesce(ab_f, fa) - m1) / s1 * ((tdi - m2) / s2)) AS a12, sum((coalesce(ab_f, fa) - m1) / s1 * (y - my)) AS c1, sum((tdi - m2) / s2 * (y - my)) AS c2 FROM t, f, s),
    b AS (SELECT ((n + 1) * c1 - a12 * c2) / ((n + 1) * (n + 1) - a12 * a12) AS b1, ((n + 1) * c2 - a12 * c1) / ((n + 1) * (n + 1) - a12 * a12) AS b2 FROM x, s)
    SELECT entity, year, round(my + b1 * (coalesce(ab_f, fa) - m1) / s1 + b2 * (tdi - m2) / s2, 5) AS pred FROM lp, f, s, b WHERE {TARGET} IS NOT NULL AND year = {LAST}""")
def ridge(spark, sf):
    train, test = last_split(spark, sf)
    n, sd = models.label_stats(train, TARGET)
    model = models.fit(train, TARGET, {"ridge": models.ridge(n, sd)}, ["ab_f", "tdi"], [])["ridge"]
    return model.predict(test).select("entity", "year", F.round("pred", 5).alias("pred"))


@query("m10_random_forest_regressor")
def random_forest(spark, sf):
    return predictions(spark, sf, lambda n, sd: {"random forest": models.random_forest_regressor(trees=10)})


@query("m11_gradient_boosting")
def boosting(spark, sf):
    return predictions(spark, sf, lambda n, sd: {"gradient boosting": models.gradient_boosting(rounds=5)})


@query("m12_hist_gradient_boosting")
def hist_boosting(spark, sf):
    return predictions(spark, sf, lambda n, sd: {"hist gradient boosting": models.hist_gradient_boosting(rounds=5)})


@query("m14_classifiers")
def classifiers(spark, sf):
    p = panel(spark, sf)
    limit = ev.risk_threshold(p, TARGET, [LAST], SPEC).first()["threshold"]
    rows = p.withColumn("risk", (F.col(TARGET) > limit).cast("double"))
    train, test = ev.temporal_split(rows, LAST, "year")
    n, _ = models.label_stats(train, "risk")
    scored = []
    for name, m in models.fit(train, "risk", models.classifiers(n, trees=10, fine_rounds=3), NUMERIC, CATEGORIES).items():
        part = m.predict(test, "score").select(F.lit(name).alias("model"), F.col("risk").cast("int").alias("label"), "score")
        scored.append(part.withColumn("flagged", (F.col("score") >= 0.5).cast("int")))
    rows = scored[0].unionByName(scored[1]).unionByName(scored[2])
    return ev.classification_metrics(rows, ["model"])


ALL_YEARS, WITHOUT = "all years", "without 1997, 1998"
RUNS = [linear.Run(f, name, years) for f in FOLDS for name, years in ((ALL_YEARS, ()), (WITHOUT, (1997, 1998)))]
PAIR = ["ab_f", "tdi"]
_PAIR_RUNS = ", ".join(f"({r.fold}, '{r.name}')" for r in RUNS)
CTES["lin"] = f"""SELECT t.fold, t.run, m.model, p.entity, p.{TARGET} AS y,
    round(my + (CASE m.model WHEN 'ridge' THEN ((nn + 1) * u1 - a12 * u2) / ((nn + 1) * (nn + 1) - a12 * a12) ELSE (nn * u1 - a12 * u2) / (nn * nn - a12 * a12) END) / s1 * (coalesce(p.ab_f, fa) - m1)
    + (CASE m.model WHEN 'ridge' THEN ((nn + 1) * u2 - a12 * u1) / ((nn + 1) * (nn + 1) - a12 * a12) ELSE (nn * u2 - a12 * u1) / (nn * nn - a12 * a12) END) / s2 * (coalesce(p.tdi, ft) - m2), 6) AS pred
    FROM (SELECT *, CAST(n0 AS DOUBLE) AS nn, n0 * c12 / (s1 * s2) AS a12, n0 * c1 / s1 AS u1, n0 * c2 / s2 AS u2 FROM (
      SELECT fold, run, max(fa) AS fa, max(ft) AS ft, count(*) AS n0, avg(a) AS m1, stddev_pop(a) AS s1, avg(b) AS m2, stddev_pop(b) AS s2, avg(y) AS my, covar_pop(a, b) AS c12, covar_pop(a, y) AS c1, covar_pop(b, y) AS c2 FROM (
        SELECT fold, run, fa, ft, coalesce(ab_f, fa) AS a, coalesce(tdi, ft) AS b, {TARGET} AS y FROM (
          SELECT v.fold, v.run, ab_f, tdi, {TARGET}, quantile_cont(ab_f, 0.5) OVER g AS fa, quantile_cont(tdi, 0.5) OVER g AS ft FROM lp, (VALUES {_PAIR_RUNS}) v(fold, run)
          WHERE {TARGET} IS NOT NULL AND year < v.fold AND NOT (v.run = '{WITHOUT}' AND year IN (1997, 1998)) WINDOW g AS (PARTITION BY v.fold, v.run))) GROUP BY 1, 2)) t
    JOIN lp p ON p.year = t.fold AND p.{TARGET} IS NOT NULL, (VALUES ('ridge'), ('ols')) m(model)"""


def linear_rows(spark, sf):
    """Ridge and least squares on two features: test rows of all folds, with and without the unusual years in training."""
    rows = linear.walk_forward(panel(spark, sf), TARGET, PAIR, [], RUNS, SPEC, min_train=fv.MIN_TRAIN_ROWS)
    return staged(rows.withColumn("pred", F.round("pred", 6)), "linear")


@query("m5_walk_forward_models", METRIC_SQL.replace("FROM bl)", f"FROM lin WHERE run = '{ALL_YEARS}')"))
def walk_forward(spark, sf):
    rows = linear_rows(spark, sf).where(F.col("run") == ALL_YEARS)
    return rounded(ev.regression_metrics(rows, ["fold", "model"]), "mae", "rmse", "r2", "spearman")


@query("m9_ridge_all_features")
def ridge_all_features(spark, sf):
    """Predictions of all folds from all numbers and categories; checked against plain least squares in the tests."""
    rows = linear.walk_forward(panel(spark, sf), TARGET, NUMERIC, CATEGORIES, [r for r in RUNS if r.name == ALL_YEARS], SPEC, min_train=fv.MIN_TRAIN_ROWS)
    return rows.select("fold", "model", "entity", "y", F.round("pred", 6).alias("pred"))


_R2 = "1 - avg((pred - y) * (pred - y)) FILTER (WHERE run = '{run}') / var_pop(y) FILTER (WHERE run = '{run}')"


@query("m24_refit_without_years", f"""SELECT fold, model, round(r2_all, 6) AS r2_all_years, round(r2_less, 6) AS r2_without, round(r2_less - r2_all, 6) AS delta_r2 FROM (
    SELECT fold, model, {_R2.format(run=ALL_YEARS)} AS r2_all, {_R2.format(run=WITHOUT)} AS r2_less FROM lin GROUP BY 1, 2) WHERE r2_all IS NOT NULL AND r2_less IS NOT NULL""")
def refit_without_years(spark, sf):
    """All linear models of all folds, refitted without the unusual years, against the same models with them."""
    rows = linear_rows(spark, sf)
    e = F.col("pred") - F.col("y")
    r2 = rows.groupBy("fold", "model", "run").agg((1 - ratio(F.avg(e * e), F.var_pop("y"))).alias("r2"))
    wide = r2.groupBy("fold", "model").agg(*[F.max(F.when(F.col("run") == run, F.col("r2"))).alias(name) for run, name in ((ALL_YEARS, "r2_all_years"), (WITHOUT, "r2_without"))])
    both = wide.where("r2_all_years IS NOT NULL AND r2_without IS NOT NULL").withColumn("delta_r2", F.col("r2_without") - F.col("r2_all_years"))
    return rounded(both, "r2_all_years", "r2_without", "delta_r2")


@query("m21_permutation_importance")
def permutation(spark, sf):
    out, test = fitted(spark, sf, lambda n, sd: {"ridge": models.ridge(n, sd)})
    return models.permutation_importance(out["ridge"], test, TARGET, ["entity", "year"], repeats=5)


@query("m22_impurity_importance")
def impurity(spark, sf):
    out, _ = fitted(spark, sf, lambda n, sd: {"rf": models.random_forest_regressor(trees=10)})
    return models.impurity_importance(out["rf"], spark)


def _ols_sql(extra):
    return f"""SELECT my - b1c * m1 - b2c * m2 AS icept, b1c, b2c FROM (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1c, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2c FROM (
    SELECT avg(mexp) AS m1, avg(tdi) AS m2, avg(y1) AS my, var_pop(mexp) AS s11, var_pop(tdi) AS s22, covar_pop(mexp, tdi) AS s12, covar_pop(mexp, y1) AS s1y, covar_pop(tdi, y1) AS s2y FROM fp WHERE year < {LAST} AND year > {FIRST} AND y1 IS NOT NULL {extra}))"""


@query("m24_sensitivity_without_years", f"""WITH p AS (SELECT a.y1, o.icept + o.b1c * mexp + o.b2c * tdi AS full_p, q.icept + q.b1c * mexp + q.b2c * tdi AS less_p FROM fp a, ({_ols_sql('')}) o, ({_ols_sql('AND year NOT IN (1997, 1998)')}) q WHERE a.year = {LAST} AND a.y1 IS NOT NULL)
    SELECT round(1 - avg((full_p - y1) * (full_p - y1)) / var_pop(y1), 6) AS r2_all_years, round(1 - avg((less_p - y1) * (less_p - y1)) / var_pop(y1), 6) AS r2_without,
    round((1 - avg((less_p - y1) * (less_p - y1)) / var_pop(y1)) - (1 - avg((full_p - y1) * (full_p - y1)) / var_pop(y1)), 6) AS delta_r2 FROM p""")
def sensitivity(spark, sf):
    d = ad.staged_forecast(spark, sf)
    out = {}
    for name, train in (("r2_all_years", d), ("r2_without", d.where(~F.col("year").isin([1997, 1998])))):
        coefs = ev.ols_two_features(train, "y1", "mexp", "tdi", [LAST], SPEC, FIRST)
        test = ev.test_rows(d.where(F.col("y1").isNotNull()), [LAST], SPEC).join(ev.per_fold(coefs), "fold")
        pred = test.select("fold", F.lit("ols").alias("model"), F.col("y1").alias("y"), ev.ols_prediction("mexp", "tdi").alias("pred"))
        out[name] = ev.regression_metrics(pred, ["fold"]).select("fold", F.col("r2").alias(name))
    both = out["r2_all_years"].join(out["r2_without"], "fold").withColumn("delta_r2", F.col("r2_without") - F.col("r2_all_years"))
    return rounded(both.drop("fold"), "r2_all_years", "r2_without", "delta_r2")


@query("m25_strategies_with_models")
def strategies_with_models(spark, sf):
    d = ad.staged_forecast(spark, sf)
    numeric, categories = ["ab", "tdi", "atu", "mexp", "m3", "pooled"], ["location"]
    pred = models.walk_forward(d, "y1", numeric, categories, FOLDS[-2:], SPEC, first_year=FIRST,
                               make=lambda n, sd: {"ridge": models.ridge(n, sd), "rf": models.random_forest_regressor(trees=10)})
    wide = staged(pred, "predictions").groupBy("fold", "entity").pivot("model", ["ridge", "rf"]).agg(F.first("pred"))
    test = scores(spark, sf).where(F.col("fold").isin(FOLDS[-2:])).join(wide, ["fold", "entity"], "left").withColumn("rf_count", F.col("rf") * F.col("n_use"))
    columns = ev.strategy_columns("ab", {"T6 ridge (all features)": "ridge", "T7 random forest (all features)": "rf", "C7 random forest x size": "rf_count"})
    return ev.score_strategies(staged(ev.score_list(test, columns, SPEC), "score-list"), K, SPEC)


CTES["final_metrics"] = METRIC_SQL
CTES["final_ci"] = ORACLES["m17_bootstrap_ci"]


@query("m28_final_test_table", f"SELECT m.*, c.mae_low, c.mae_high, c.r2_low, c.r2_high FROM final_metrics m JOIN final_ci c USING (fold, model) WHERE fold = {LAST}")
def final_test(spark, sf):
    rows = baseline_rows(spark, sf).where(F.col("fold") == LAST)
    metrics = ev.regression_metrics(rows, ["fold", "model"])
    table = metrics.join(ev.bootstrap_ci(rows, ["fold", "model"], "entity", replicates=REPLICATES), ["fold", "model"], "left")
    return rounded(table, "mae", "rmse", "r2", "spearman", "mae_low", "mae_high", "r2_low", "r2_high")


CTES["fin"] = f"""SELECT fold, model, entity, y, pred FROM bl WHERE fold = {LAST} UNION ALL SELECT fold, model, entity, y, pred FROM lin WHERE fold = {LAST} AND run = '{ALL_YEARS}'"""
CTES["fin_metrics"] = METRIC_SQL.replace("FROM bl)", "FROM fin)")
CTES["fin_ci"] = ORACLES["m17_bootstrap_ci"].replace("SELECT bl.*, r FROM bl,", "SELECT fin.*, r FROM fin,")


@query("m28_final_table_with_models", "SELECT m.*, c.mae_low, c.mae_high, c.r2_low, c.r2_high FROM fin_metrics m JOIN fin_ci c USING (fold, model)")
def final_table_with_models(spark, sf):
    """Baselines and fitted models on the last year, with intervals."""
    fitted_rows = linear_rows(spark, sf).where((F.col("fold") == LAST) & (F.col("run") == ALL_YEARS)).drop("run")
    rows = staged(baseline_rows(spark, sf).where(F.col("fold") == LAST).select(fitted_rows.columns).unionByName(fitted_rows), "final-rows")
    table = ev.regression_metrics(rows, ["fold", "model"]).join(ev.bootstrap_ci(rows, ["fold", "model"], "entity", replicates=REPLICATES), ["fold", "model"], "left")
    return rounded(table, "mae", "rmse", "r2", "spearman", "mae_low", "mae_high", "r2_low", "r2_high")
