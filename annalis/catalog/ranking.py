"""Queries of the ranking, forecasting and evaluation operators (no MLlib models)."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalis import fixed_values as fv
from annalis.catalog import adapters as ad
from annalis.catalog.adapters import FOLDS, SPEC
from annalis.catalog.aggregates import _rank, rounded
from annalis.catalog.registry import CTES, query
from annalis.operators import evaluate as ev
from annalis.operators import order, ranking
from annalis.session import staged

K = 20
FIRST = 1995
FOLD_SQL = ", ".join(map(str, FOLDS))
PARTITION = "PARTITION BY fold"

CTES["train"] = "\nUNION ALL\n".join(f"""SELECT {f} AS fold, train_mean, train_median, my - b1c * m1 - b2c * m2 AS icept, b1c, b2c FROM (
  SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1c, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2c FROM (
    SELECT avg(y1) AS train_mean, quantile_cont(ab, 0.5) AS train_median, avg(mexp) AS m1, avg(tdi) AS m2, avg(y1) AS my, var_pop(mexp) AS s11, var_pop(tdi) AS s22,
      covar_pop(mexp, tdi) AS s12, covar_pop(mexp, y1) AS s1y, covar_pop(tdi, y1) AS s2y FROM fp WHERE year < {f} AND year > {FIRST} AND y1 IS NOT NULL))""" for f in FOLDS)
CTES["fs"] = f"""SELECT a.*, a.year AS fold, t.train_mean, t.train_median, 100 * (cum_count + m * p0) / (cum_size + m) AS eb, icept + b1c * mexp + b2c * tdi AS ols2
FROM fp a JOIN prior p ON p.fold = a.year JOIN train t ON t.fold = a.year WHERE a.y1 IS NOT NULL AND a.year IN ({FOLD_SQL})"""
STRATEGIES = {
    "T0 training mean": "train_mean", "T1 persistence: rate(t)": "ab", "T2 three-year mean": "m3", "T3 cumulative rate": "pooled",
    "T4 shrunk cumulative rate (EB)": "eb", "T5 OLS: historical mean + covariate": "ols2", "C0 size only": "n_use", "C1 persistence: count(t)": "dropouts",
    "C3 cumulative rate x size": "pooled * n_use", "C4 EB x size": "eb * n_use", "C5 OLS x size": "ols2 * n_use",
}
CTES["scorelist"] = "\nUNION ALL\n".join(
    f"SELECT fold, entity, y1, b1, n_next1, ever_special, '{s}' AS strategy, round(coalesce({x}, {'train_median' if s[0] == 'T' else '0'}), 9) AS score FROM fs" for s, x in STRATEGIES.items())
CTES["truth"] = f"""SELECT fold, entity, row_number() OVER ({PARTITION} ORDER BY y1 DESC, entity) AS by_rate, row_number() OVER ({PARTITION} ORDER BY b1 DESC, entity) AS by_count FROM fs"""


def scores(spark, sf):
    d = ad.staged_forecast(spark, sf)
    return staged(ev.fold_scores(d, "ab", "tdi", FOLDS, FIRST, SPEC), "scores")


def score_long(spark, sf):
    return ev.score_list(scores(spark, sf), ev.strategy_columns("ab"), SPEC)


@query("t1_sort_panel", "SELECT year, entity, ab FROM sp")
def sort_panel(spark, sf):
    return ad.supplier_panel(spark, sf).select("year", "entity", "ab").orderBy("year", "entity")


@query("t2_top_k", f"""SELECT entity, year, ab, CAST(p AS INT) AS position, 'top' AS side FROM (SELECT *, row_number() OVER (ORDER BY ab DESC, entity, year) AS p FROM cp WHERE ab IS NOT NULL) WHERE p <= {K}
    UNION ALL SELECT entity, year, ab, CAST(p AS INT), 'bottom' FROM (SELECT *, row_number() OVER (ORDER BY ab, entity, year) AS p FROM cp WHERE ab IS NOT NULL) WHERE p <= {K}""")
def top_k(spark, sf):
    p = ad.customer_panel(spark, sf).where(F.col("ab").isNotNull()).select("entity", "year", "ab")
    top = order.top_k(p, [], "ab", K, ["entity", "year"]).withColumn("side", F.lit("top"))
    return top.unionByName(order.top_k(p, [], "ab", K, ["entity", "year"], ascending=True).withColumn("side", F.lit("bottom")))


@query("t3_stable_top_k", f"SELECT year, entity, ab, CAST(p AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY ab DESC NULLS LAST, entity) AS p FROM cp) WHERE p <= {K}")
def stable_top_k(spark, sf):
    return order.top_k(ad.customer_panel(spark, sf).select("year", "entity", "ab"), ["year"], "ab", K, ["entity"])


CTES["labels_f"] = "\nUNION ALL\n".join(f"""SELECT a.entity, {f} AS fold, a.ab_f AS persist, a.ab_f_T1 AS y, q.threshold, q.tmed, CASE WHEN a.ab_f_T1 > q.threshold THEN 1 ELSE 0 END AS label
    FROM lp a, (SELECT quantile_cont(ab_f_T1, 0.8) AS threshold, quantile_cont(ab_f_T1, 0.5) AS tmed FROM lp WHERE year < {f} AND ab_f_T1 IS NOT NULL) q WHERE a.year = {f} AND a.ab_f_T1 IS NOT NULL""" for f in FOLDS)


def labelled(spark, sf):
    """Test rows with risk label; persistence filled with the training median of the target."""
    p = ad.staged_longitudinal(spark, sf).select("entity", "year", "ab_f", "ab_f_T1")
    rows = ev.risk_label(p, "ab_f_T1", FOLDS, SPEC)
    fills = ev.train_quantiles(p.where(F.col("ab_f_T1").isNotNull()), "ab_f_T1", {"fill": 0.5}, FOLDS, SPEC)
    rows = rows.join(ev.per_fold(fills), "fold")
    return staged(rows.withColumn("score", F.coalesce(F.col("ab_f"), F.col("fill"))), "labelled")


@query("t4_recall_at_k", f"""WITH s AS (SELECT fold, label, row_number() OVER (PARTITION BY fold ORDER BY coalesce(persist, tmed) DESC, entity) AS p FROM labels_f),
    t AS (SELECT fold, count(*) AS n, sum(label) AS pos FROM labels_f GROUP BY 1), k AS (SELECT unnest([10, 20, 30, 50]) AS k)
    SELECT s.fold, CAST(k AS INT) AS k, round(k / n, 6) AS list_share, CAST(sum(CASE WHEN p <= k THEN label ELSE 0 END) AS BIGINT) AS hits, round(sum(CASE WHEN p <= k THEN label ELSE 0 END) / k, 6) AS precision_at_k,
    round(sum(CASE WHEN p <= k THEN label ELSE 0 END) / pos, 6) AS recall_at_k, round(k / n, 6) AS random_recall, round((sum(CASE WHEN p <= k THEN label ELSE 0 END) / k) / (pos / n), 6) AS lift
    FROM s JOIN t USING (fold), k WHERE k <= n GROUP BY s.fold, k, n, pos""")
def recall_at_k(spark, sf):
    out = ranking.recall_at_k(labelled(spark, sf), ["fold"], "score", "label", ["entity"])
    return rounded(out, "list_share", "precision_at_k", "recall_at_k", "random_recall", "lift")


@query("t5_topk_overlap", f"SELECT fold, round(count(CASE WHEN by_rate <= {K} AND by_count <= {K} THEN 1 END) / {K}, 6) AS overlap FROM truth GROUP BY 1")
def topk_overlap(spark, sf):
    test = scores(spark, sf)
    a = order.top_k(test, ["fold"], "y1", K, ["entity"])
    b = order.top_k(test, ["fold"], "b1", K, ["entity"])
    return rounded(ranking.topk_overlap(a, b, ["fold"], "entity", K), "overlap")


LIST_SQL = """round(sum(CASE WHEN p <= {k} THEN b1 ELSE 0 END) / sum(b1), 6) AS capture, round(quantile_cont(CASE WHEN p <= {k} THEN n_next1 END, 0.5), 6) AS median_size,
    count(CASE WHEN p <= {k} AND ever_special = 1 THEN 1 END) AS special""".format(k=K)


@query("t6_capture_share", f"""SELECT fold, {LIST_SQL} FROM (SELECT *, row_number() OVER ({PARTITION} ORDER BY round(eb, 9) DESC, entity) AS p FROM fs) GROUP BY 1""")
def capture_share(spark, sf):
    test = scores(spark, sf).withColumn("eb", F.round("eb", 9))
    best = order.top_k(test, ["fold"], "eb", K, ["entity"])
    out = ranking.list_summary(best, test, ["fold"], ["fold"], "b1", "n_next1", "ever_special").drop("captured")
    return rounded(out, "capture", "median_size")


@query("t7_oracle_and_random", f"""SELECT fold, 'oracle by rate' AS rule, {LIST_SQL} FROM (SELECT fs.*, by_rate AS p FROM fs JOIN truth USING (fold, entity)) GROUP BY 1
    UNION ALL SELECT fold, 'oracle by count', {LIST_SQL} FROM (SELECT fs.*, by_count AS p FROM fs JOIN truth USING (fold, entity)) GROUP BY 1
    UNION ALL SELECT fold, 'random', round({K} / count(*), 6), NULL, NULL FROM fs GROUP BY 1""")
def oracle_and_random(spark, sf):
    out = ranking.oracle_and_random(scores(spark, sf), ["fold"], "y1", "b1", "n_next1", "ever_special", ["entity"], K)
    return rounded(out, "capture", "median_size")


FRONT_SQL = LIST_SQL + f""", round(sum(CASE WHEN p <= {K} AND ever_special = 1 THEN b1 ELSE 0 END) / nullif(sum(CASE WHEN ever_special = 1 THEN b1 END), 0), 6) AS special_capture,
    count(CASE WHEN p <= {K} AND stratum = '1-Capital urbana' THEN 1 END) AS capital"""
CTES["front"] = f"""SELECT fold, power, {FRONT_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY fold, power ORDER BY round(eb * pow(n_use, power), 9) DESC, entity) AS p
    FROM fs, (SELECT CAST(unnest([0, 0.25, 0.5, 0.75, 1.0]) AS DOUBLE) AS power)) GROUP BY 1, 2"""


def frontier(spark, sf):
    test = scores(spark, sf)
    chosen = ranking.rate_count_lists(test, ["fold"], "eb", "n_use", fv.FRONTIER_POWERS, K, ["entity"])
    out = ranking.frontier_summary(chosen, test, ["fold", "power"], ["fold"], "b1", "n_next1", "ever_special", "stratum", fv.STRATUM_CAPITAL)
    return rounded(out, "capture", "special_capture", "median_size")


@query("t8_rate_count_frontier", "SELECT * FROM front")
def rate_count_frontier(spark, sf):
    return frontier(spark, sf)


CTES["seat_table"] = f"""SELECT fold, weighting, stratum, CAST(fl + CASE WHEN rest <= {K} - sum(fl) OVER (PARTITION BY fold, weighting) THEN 1 ELSE 0 END AS INT) AS seats FROM (
  SELECT *, floor(q) AS fl, row_number() OVER (PARTITION BY fold, weighting ORDER BY q - floor(q) DESC, stratum) AS rest FROM (
    SELECT fold, weighting, stratum, round(w / sum(w) OVER (PARTITION BY fold, weighting) * {K}, 9) AS q FROM (
      SELECT fold, stratum, unnest(['entities', 'expected', 'root']) AS weighting, unnest([n, e, sqrt(n * e)]) AS w
      FROM (SELECT fold, stratum, CAST(count(*) AS DOUBLE) AS n, sum(round(eb * n_use, 9)) AS e FROM fs GROUP BY 1, 2))))"""


@query("t9_stratum_quota", f"""SELECT fold, weighting, {FRONT_SQL.replace(f"p <= {K}", "p <= seats")} FROM (
    SELECT x.*, s.weighting, s.seats FROM (SELECT *, row_number() OVER (PARTITION BY fold, stratum ORDER BY round(eb * n_use, 9) DESC, entity) AS p FROM fs) x JOIN seat_table s ON s.fold = x.fold AND s.stratum = x.stratum) GROUP BY 1, 2""")
def stratum_quota(spark, sf):
    test = scores(spark, sf).withColumn("expected", F.round(F.col("eb") * F.col("n_use"), 9))
    chosen = ranking.stratum_quota(test, ["fold"], "stratum", "expected", K, ["entity"])
    out = ranking.frontier_summary(chosen, test, ["fold", "weighting"], ["fold"], "b1", "n_next1", "ever_special", "stratum", fv.STRATUM_CAPITAL)
    return rounded(out, "capture", "special_capture", "median_size")


@query("t9_quota_seats", "SELECT fold, weighting, stratum, seats FROM seat_table")
def quota_seats(spark, sf):
    test = scores(spark, sf).withColumn("expected", F.round(F.col("eb") * F.col("n_use"), 9))
    return ranking.quota_seats(test, ["fold"], "stratum", "expected", K)


@query("t10_error_concentration", f"""WITH e AS (SELECT fold, round((eb - y1) * (eb - y1), 9) AS sq, row_number() OVER ({PARTITION} ORDER BY (eb - y1) * (eb - y1) DESC) AS p, count(*) OVER ({PARTITION}) AS n FROM fs)
    SELECT fold, round(sum(CASE WHEN p <= greatest(1, floor(n * 0.05)) THEN sq END) / sum(sq), 6) AS worst_5, round(sum(CASE WHEN p <= greatest(1, floor(n * 0.1)) THEN sq END) / sum(sq), 6) AS worst_10 FROM e GROUP BY 1""")
def error_concentration(spark, sf):
    out = ranking.error_concentration(scores(spark, sf), ["fold"], F.col("eb") - F.col("y1"), [0.05, 0.10])
    return rounded(out, "worst_5", "worst_10")


@query("t11_worst_underestimates", f"""SELECT fold, entity, y1 AS real, round(eb, 6) AS predicted, round(eb - y1, 6) AS error, CAST(p AS INT) AS position FROM (SELECT *, row_number() OVER ({PARTITION} ORDER BY round(eb - y1, 9), entity) AS p FROM fs) WHERE p <= 10""")
def worst_underestimates(spark, sf):
    rows = scores(spark, sf).withColumn("error", F.round(F.col("eb") - F.col("y1"), 9))
    worst = order.top_k(rows, ["fold"], "error", 10, ["entity"], ascending=True)
    return worst.select("fold", "entity", F.col("y1").alias("real"), F.round("eb", 6).alias("predicted"), F.round("error", 6).alias("error"), "position")


@query("t12_regression_to_mean", f"""SELECT fold, round(avg(CASE WHEN p <= {K} THEN ab END), 6) AS top_now, round(avg(CASE WHEN p <= {K} THEN y1 END), 6) AS top_next, count(CASE WHEN p <= {K} AND y1 < ab THEN 1 END) AS fell,
    round(avg(ab), 6) AS all_now, round(avg(y1), 6) AS all_next FROM (SELECT *, row_number() OVER ({PARTITION} ORDER BY ab DESC, entity) AS p FROM fs) GROUP BY 1""")
def regression_to_mean(spark, sf):
    d = ev.test_rows(ad.staged_forecast(spark, sf).where(F.col("y1").isNotNull()), FOLDS, SPEC)
    return rounded(ranking.regression_to_mean(d, ["fold"], "ab", "y1", K, ["entity"]), "top_now", "top_next", "all_now", "all_next")


LISTS_SQL = f"sum(CASE WHEN p <= {K} THEN dropouts ELSE 0 END) AS captured, round(sum(CASE WHEN p <= {K} THEN dropouts ELSE 0 END) / sum(dropouts), 6) AS capture, round(quantile_cont(CASE WHEN p <= {K} THEN n_use END, 0.5), 6) AS median_size, count(CASE WHEN p <= {K} AND ever_special = 1 THEN 1 END) AS special"


@query("t13_rate_vs_count_lists", "\nUNION ALL\n".join(f"SELECT year, '{n}' AS list, {LISTS_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY {c} DESC, entity) AS p FROM ct) GROUP BY 1" for n, c in (("rate", "ab"), ("count", "dropouts"))))
def rate_vs_count(spark, sf):
    out = ranking.rate_vs_count_lists(ad.staged_counts(spark, sf), ["year"], "ab", "dropouts", "n_use", "ever_special", ["entity"], K)
    return rounded(out, "capture", "median_size")


@query("m1_reconstruct_denominator", "SELECT entity, year, ap, rp, ab, enrolment, n_rate FROM ct")
def reconstruct(spark, sf):
    return ad.counts_panel(spark, sf).select("entity", "year", "ap", "rp", "ab", "enrolment", "n_rate")


@query("m2_counts", "SELECT entity, year, n_use, dropouts, failures FROM ct")
def counts(spark, sf):
    return ad.counts_panel(spark, sf).select("entity", "year", "n_use", "dropouts", "failures")


@query("m3_eb_score", "SELECT entity, fold, round(eb, 6) AS eb FROM fs")
def eb_score(spark, sf):
    return scores(spark, sf).select("entity", "fold", F.round("eb", 6).alias("eb"))


CTES["bl"] = "\nUNION ALL\n".join(f"""SELECT {f} AS fold, a.entity, a.ab_f_T1 AS y, m.model, CASE m.model WHEN 'persistence' THEN coalesce(a.ab_f, t.fill, 0) WHEN 'mean' THEN t.mean ELSE t.med END AS pred
    FROM lp a, (SELECT avg(ab_f_T1) AS mean, quantile_cont(ab_f_T1, 0.5) AS med, quantile_cont(ab_f, 0.5) AS fill FROM lp WHERE year < {f} AND ab_f_T1 IS NOT NULL) t, (SELECT unnest(['persistence', 'mean', 'median']) AS model) m
    WHERE a.year = {f} AND a.ab_f_T1 IS NOT NULL""" for f in FOLDS)


def baseline_rows(spark, sf):
    return staged(ev.baselines(ad.staged_longitudinal(spark, sf), "ab_f_T1", "ab_f", FOLDS, SPEC), "baselines")


@query("m4_baselines", "SELECT fold, entity, y, model, round(pred, 6) AS pred FROM bl")
def baselines(spark, sf):
    return rounded(baseline_rows(spark, sf), "pred")


@query("m5_walk_forward_folds", """WITH y AS (SELECT year AS fold, count(*) AS n_test FROM lp WHERE ab_f_T1 IS NOT NULL GROUP BY 1)
    SELECT fold, CAST(n_train AS BIGINT) AS n_train, n_test FROM (SELECT fold, n_test, coalesce(sum(n_test) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_train FROM y) WHERE n_train >= 50 AND n_test >= 30""")
def folds(spark, sf):
    return ev.walk_forward_folds(ad.longitudinal_panel(spark, sf).where(F.col("ab_f_T1").isNotNull()), SPEC)


@query("m6_temporal_split", """SELECT entity, year, target_year, CASE target_year WHEN 2001 THEN 'test' WHEN 2000 THEN 'validation' ELSE 'train' END AS part, CASE WHEN year < 2000 THEN 'train' WHEN year = 2000 THEN 'test' END AS two_way
    FROM lp WHERE target_year IN (1997, 1998, 1999, 2000, 2001)""")
def temporal_split(spark, sf):
    p = ad.longitudinal_panel(spark, sf)
    three = ev.three_way_split(p, "target_year", [1997, 1998, 1999, 2000, 2001]).select("entity", "year", "target_year", "part")
    train, test = ev.temporal_split(three, 2000, "year")
    return train.withColumn("two_way", F.lit("train")).unionByName(test.withColumn("two_way", F.lit("test")))


def mix_chain(source, key, rep, seed, keep):
    """Nested selects that compute the 32-bit hash step by step."""
    q = f"SELECT {keep}, CAST((CAST({key} AS BIGINT) % 2147483647) * 1540483477 + CAST({rep} AS BIGINT) * 668265263 + {seed} AS BIGINT) % 4294967296 AS x0 FROM {source}"
    for i, s in enumerate((15, 13, 16)):
        q = f"SELECT {keep}, CAST((xor(x{i}, x{i} >> {s}) * 1540483477) % 4294967296 AS BIGINT) AS x{i + 1} FROM ({q})"
    return f"SELECT {keep}, xor(x3, x3 >> 15) AS bits FROM ({q})"


@query("m7_random_split", f"SELECT entity, year, CASE WHEN bits % 10000 < 2000 THEN 'test' ELSE 'train' END AS part FROM ({mix_chain('(SELECT *, (entity % 1000003) * 31 + year % 1000003 AS kk FROM sp)', 'kk', '0', 42, 'entity, year')})")
def random_split(spark, sf):
    return ev.random_split(ad.supplier_panel(spark, sf), ["entity", "year"]).select("entity", "year", "part")


METRIC_SQL = """WITH r AS (SELECT fold, model, y, pred, {ry} AS ry, {rp} AS rp FROM bl)
    SELECT fold, model, count(*) AS n, round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, round(1 - avg((pred - y) * (pred - y)) / nullif(var_pop(y), 0), 6) AS r2,
    CASE WHEN count(DISTINCT round(pred, 9)) > 1 THEN round(corr(ry, rp), 6) END AS spearman FROM r GROUP BY 1, 2""".format(ry=_rank("y", "fold, model"), rp=_rank("round(pred, 9)", "fold, model"))
CTES["blm"] = """SELECT fold, model, avg(abs(pred - y)) AS mae, sqrt(avg((pred - y) * (pred - y))) AS rmse, 1 - avg((pred - y) * (pred - y)) / var_pop(y) AS r2 FROM bl GROUP BY 1, 2"""


def baseline_metrics(spark, sf):
    return ev.regression_metrics(baseline_rows(spark, sf), ["fold", "model"])


@query("m15_regression_metrics", METRIC_SQL)
def regression_metrics(spark, sf):
    return rounded(baseline_metrics(spark, sf), "mae", "rmse", "r2", "spearman")


@query("m16_extended_metrics", """SELECT fold, round(sum(n_next1 * abs(eb - y1)) / sum(n_next1), 6) AS weighted_mae, round(1 - var_pop(eb - y1) / var_pop(y1), 6) AS r2_centred, round(avg(eb - y1), 6) AS bias FROM fs GROUP BY 1""")
def extended_metrics(spark, sf):
    out = ev.extended_metrics(scores(spark, sf), ["fold"], "n_next1", "y1", "eb")
    return rounded(out, "weighted_mae", "r2_centred", "bias")


REPLICATES = 200
_POIS = " + ".join(f"CASE WHEN bits >= {s} THEN 1 ELSE 0 END" for s in ev.POISSON_STEPS)


@query("m17_bootstrap_ci", f"""WITH d AS (SELECT fold, model, y, pred - y AS e, r, {_POIS} AS w FROM ({mix_chain(f'(SELECT bl.*, r FROM bl, (SELECT unnest(range(1, {REPLICATES + 1})) AS r))', 'entity', 'r', 42, 'fold, model, entity, y, pred, r')})),
    s AS (SELECT fold, model, r, sum(w) AS w, sum(w * abs(e)) AS ae, sum(w * e * e) AS se, sum(w * y) AS sy, sum(w * y * y) AS syy FROM d WHERE w > 0 GROUP BY 1, 2, 3),
    v AS (SELECT fold, model, ae / w AS mae, 1 - se / (syy - sy * sy / w) AS r2 FROM s WHERE syy - sy * sy / w > 1e-9)
    SELECT fold, model, round(quantile_cont(mae, 0.025), 6) AS mae_low, round(quantile_cont(mae, 0.975), 6) AS mae_high, round(quantile_cont(r2, 0.025), 6) AS r2_low, round(quantile_cont(r2, 0.975), 6) AS r2_high FROM v GROUP BY 1, 2""")
def bootstrap_ci(spark, sf):
    out = ev.bootstrap_ci(baseline_rows(spark, sf), ["fold", "model"], "entity", replicates=REPLICATES)
    return rounded(out, "mae_low", "mae_high", "r2_low", "r2_high")


@query("m18_risk_label", "SELECT fold, entity, y AS target, round(threshold, 6) AS threshold, label FROM labels_f")
def risk_label(spark, sf):
    rows = ev.risk_label(ad.staged_longitudinal(spark, sf), "ab_f_T1", FOLDS, SPEC)
    return rows.select("fold", "entity", F.col("ab_f_T1").alias("target"), F.round("threshold", 6).alias("threshold"), "label")


def class_sql(source, by):
    """Classification metrics of (by, score, label, flagged) rows, curves by plain windows."""
    part = f"PARTITION BY {by}"
    return f"""WITH c AS (SELECT {by}, count(*) AS n, sum(CASE WHEN label = 1 AND flagged = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label = 0 AND flagged = 1 THEN 1 ELSE 0 END) AS fp,
      sum(CASE WHEN label = 1 AND flagged = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN label = 0 AND flagged = 0 THEN 1 ELSE 0 END) AS tn FROM {source} GROUP BY ALL),
    v AS (SELECT {by}, round(score, 9) AS s, count(*) AS n, sum(label) AS pos FROM {source} GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER ({part} ORDER BY s DESC) AS cn, sum(pos) OVER ({part} ORDER BY s DESC) AS cp2, sum(n) OVER ({part}) AS an, sum(pos) OVER ({part}) AS ap2 FROM v),
    q AS (SELECT {by}, sum(pos * ((an - ap2) - (cn - cp2) + (n - pos) / 2)) / nullif(max(ap2 * (an - ap2)), 0) AS roc, sum(pos * cp2 / cn) / nullif(max(ap2), 0) AS pr FROM r GROUP BY ALL)
    SELECT {by}, c.n, round((tp + tn) / c.n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + fn) / c.n, 6) AS base_rate, round(roc, 6) AS roc_auc, round(pr, 6) AS pr_auc FROM c JOIN q USING ({by})"""


CLASS_COLS = ["accuracy", "precision", "recall", "f1", "base_rate", "roc_auc", "pr_auc"]
CTES["cls"] = "SELECT fold, label, coalesce(persist, tmed) AS score, CASE WHEN coalesce(persist, tmed) > threshold THEN 1 ELSE 0 END AS flagged FROM labels_f"


@query("m19_classification_metrics", class_sql("cls", "fold"))
def classification_metrics(spark, sf):
    rows = labelled(spark, sf).withColumn("flagged", (F.col("score") > F.col("threshold")).cast("int"))
    return rounded(ev.classification_metrics(rows, ["fold"]), *CLASS_COLS)


CTES["rscore"] = """SELECT 'persistence' AS model, fold, label, score, flagged FROM cls
    UNION ALL SELECT 'regression: ' || b.model, b.fold, l.label, b.pred, CASE WHEN b.pred > l.threshold THEN 1 ELSE 0 END FROM bl b JOIN labels_f l ON l.fold = b.fold AND l.entity = b.entity WHERE b.model <> 'persistence'"""


@query("m20_regression_as_score", class_sql("rscore", "model, fold"))
def regression_as_score(spark, sf):
    rows = labelled(spark, sf).select("fold", "entity", "label", "threshold", "score")
    regression = baseline_rows(spark, sf).where(F.col("model") != "persistence")
    scored = regression.join(rows.drop("score"), ["fold", "entity"]).select(
        F.concat(F.lit("regression: "), F.col("model")).alias("model"), "fold", "label", "threshold", F.col("pred").alias("score")
    )
    both = rows.select(F.lit("persistence").alias("model"), "fold", "label", "threshold", "score").unionByName(scored)
    both = both.withColumn("flagged", (F.col("score") > F.col("threshold")).cast("int"))
    return rounded(ev.classification_metrics(both, ["model", "fold"]), *CLASS_COLS)


STRAT_COLS = ["overlap_rate", "overlap_count", "median_size", "mae", "weighted_mae", "r2", "r2_centred", "bias", "spearman", "capture"]
CTES["strat"] = f"""SELECT fold, strategy, round(count(CASE WHEN p <= {K} AND by_rate <= {K} THEN 1 END) / {K}, 6) AS overlap_rate, round(count(CASE WHEN p <= {K} AND by_count <= {K} THEN 1 END) / {K}, 6) AS overlap_count,
    round(quantile_cont(CASE WHEN p <= {K} THEN n_next1 END, 0.5), 6) AS median_size, count(CASE WHEN p <= {K} AND ever_special = 1 THEN 1 END) AS special,
    CASE WHEN strategy LIKE 'T%' THEN round(avg(abs(score - y1)), 6) END AS mae, CASE WHEN strategy LIKE 'T%' THEN round(sum(n_next1 * abs(score - y1)) / sum(n_next1), 6) END AS weighted_mae,
    CASE WHEN strategy LIKE 'T%' THEN round(1 - avg((score - y1) * (score - y1)) / var_pop(y1), 6) END AS r2, CASE WHEN strategy LIKE 'T%' THEN round(1 - var_pop(score - y1) / var_pop(y1), 6) END AS r2_centred,
    CASE WHEN strategy LIKE 'T%' THEN round(avg(score - y1), 6) END AS bias, CASE WHEN count(DISTINCT score) > 1 THEN round(corr(rs, ry), 6) END AS spearman,
    round(sum(CASE WHEN p <= {K} THEN b1 ELSE 0 END) / sum(b1), 6) AS capture
    FROM (SELECT s.*, by_rate, by_count, row_number() OVER (PARTITION BY fold, strategy ORDER BY score DESC, entity) AS p, {_rank("score", "fold, strategy")} AS rs, {_rank("y1", "fold, strategy")} AS ry FROM scorelist s JOIN truth USING (fold, entity)) GROUP BY 1, 2"""


def strategies(spark, sf):
    return ev.score_strategies(staged(score_long(spark, sf), "score-list"), K, SPEC)


@query("m25_score_strategies", "SELECT * FROM strat")
def score_strategies(spark, sf):
    return rounded(strategies(spark, sf), *STRAT_COLS)


CTES["h2"] = f"""SELECT a.year + 2 AS target_year, a.entity, a.y2, a.b2, s.strategy, round(CASE s.strategy WHEN 'persistence' THEN coalesce(a.ab, t.train_median) WHEN 'EB' THEN eb ELSE eb * n_use END, 9) AS score
    FROM (SELECT fp.*, 100 * (cum_count + m * p0) / (cum_size + m) AS eb FROM fp JOIN prior p ON p.fold = fp.year WHERE y2 IS NOT NULL) a JOIN train t ON t.fold = a.year + 1, (SELECT unnest(['persistence', 'EB', 'EB x size']) AS strategy) s"""


@query("m26_two_year_horizon", f"""SELECT CAST(target_year AS INT) AS target_year, strategy, CASE WHEN strategy <> 'EB x size' THEN round(avg(abs(score - y2)), 6) END AS mae, round(corr(rs, ry), 6) AS spearman, round(sum(CASE WHEN p <= {K} THEN b2 ELSE 0 END) / sum(b2), 6) AS capture
    FROM (SELECT *, row_number() OVER (PARTITION BY target_year, strategy ORDER BY score DESC, entity) AS p, {_rank("score", "target_year, strategy")} AS rs, {_rank("y2", "target_year, strategy")} AS ry, count(*) OVER (PARTITION BY target_year, strategy) AS n FROM h2) WHERE n > 40 GROUP BY 1, 2""")
def two_year_horizon(spark, sf):
    out = ev.two_year_horizon(ad.staged_forecast(spark, sf), "ab", FOLDS, FIRST, K, SPEC, min_rows=40)
    return rounded(out, "mae", "spearman", "capture")


@query("a36_group_error", """SELECT s.location, s.dependency, count(*) AS n, round(avg(abs(b.pred - b.y)), 8) AS mae, round(avg(b.y), 8) AS mean_real FROM bl b JOIN sp s ON s.entity = b.entity AND s.year = b.fold WHERE b.model = 'persistence' GROUP BY 1, 2""")
def group_error(spark, sf):
    pred = baseline_rows(spark, sf).where(F.col("model") == "persistence")
    attributes = ad.supplier_panel(spark, sf).select("entity", F.col("year").alias("fold"), "location", "dependency")
    return rounded(ev.group_error(pred.join(attributes, ["entity", "fold"]), ["location", "dependency"]), "mae", "mean_real", digits=8)


@query("j11_attach_attributes", """SELECT b.fold, b.entity, b.model, round(b.pred, 6) AS pred, s.location, s.dependency FROM bl b LEFT JOIN sp s ON s.entity = b.entity AND s.year = b.fold""")
def attach_attributes(spark, sf):
    from annalis.operators import reconcile

    attributes = ad.supplier_panel(spark, sf).withColumnRenamed("year", "fold")
    out = reconcile.attach_attributes(baseline_rows(spark, sf), attributes, ["entity", "fold"], ["location", "dependency"])
    return rounded(out.select("fold", "entity", "model", "pred", "location", "dependency"), "pred")


@query("a37_fold_summary", """SELECT model, round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_sd, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_sd, round(avg(r2), 6) AS r2_mean, round(stddev_samp(r2), 6) AS r2_sd FROM blm GROUP BY 1""")
def fold_summary(spark, sf):
    out = ev.fold_summary(baseline_metrics(spark, sf), ["model"], ["mae", "rmse", "r2"])
    return rounded(out, *[c for c in out.columns if c != "model"])


@query("a38_model_fold_matrix", "SELECT model, " + ", ".join(f"round(max(CASE WHEN fold = {f} THEN r2 END), 6) AS fold_{f}" for f in FOLDS) + " FROM blm GROUP BY 1")
def model_fold_matrix(spark, sf):
    out = ev.model_fold_matrix(baseline_metrics(spark, sf), "model", "r2", FOLDS)
    return rounded(out, *[f"fold_{f}" for f in FOLDS])


@query("a41_frontier_summary", "SELECT power, round(avg(capture), 6) AS capture, round(avg(special_capture), 6) AS special_capture, round(avg(special), 6) AS special, round(avg(capital), 6) AS capital, round(avg(median_size), 6) AS median_size FROM front GROUP BY 1")
def frontier_means(spark, sf):
    cols = ["capture", "special_capture", "special", "capital", "median_size"]
    return rounded(frontier(spark, sf).groupBy("power").agg(*[F.avg(c).alias(c) for c in cols]), *cols)


@query("m13_ols_two_features", "SELECT fold, entity, round(ols2, 6) AS pred FROM fs")
def ols(spark, sf):
    return scores(spark, sf).select("fold", "entity", F.round("ols2", 6).alias("pred"))


@query("m23_select_best_model", "SELECT strategy, round(avg(r2), 5) AS mean_r2 FROM strat WHERE strategy LIKE 'T%' AND strategy <> 'T0 training mean' GROUP BY 1 ORDER BY avg(r2) DESC LIMIT 1")
def best_model(spark, sf):
    metrics = strategies(spark, sf).where(F.col("strategy").startswith("T"))
    best = ev.select_best_model(metrics, ["T0 training mean"], "r2", "strategy")
    return best.select("strategy", F.round("mean_r2", 5).alias("mean_r2"))


@query("m27_gain_over_baseline", """SELECT m.fold, m.model, round(m.mae, 6) AS mae, round(b.mae, 6) AS baseline_mae, round((b.mae - m.mae) / b.mae, 6) AS gain, m.r2 < 0 AS negative_r2 FROM blm m JOIN blm b ON b.fold = m.fold AND b.model = 'persistence' WHERE m.model <> 'persistence'""")
def gain(spark, sf):
    return rounded(ev.gain_over_baseline(baseline_metrics(spark, sf), "persistence"), "mae", "baseline_mae", "gain")
