"""Walk-forward evaluation: folds, baselines, strategies, metrics, intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalis import fixed_values as fv
from annalis.functions.scalar import ratio
from annalis.operators import order, structure
from annalis.spec import PanelSpec

FOLD = "fold"
SCORE_DIGITS = 9  # scores are rounded before ranking, so that noise cannot reorder ties


def walk_forward_folds(
    df: DataFrame, spec: PanelSpec, min_train: int = fv.MIN_TRAIN_ROWS, min_test: int = fv.MIN_TEST_ROWS
) -> DataFrame:
    """Expanding window: train on the years before t, test on t. One row per usable fold."""
    years = df.groupBy(spec.year).agg(F.count(F.lit(1)).alias("n_test"))
    before = Window.orderBy(spec.year).rowsBetween(Window.unboundedPreceding, -1)  # one row per year
    sized = years.select(
        F.col(spec.year).alias(FOLD), F.coalesce(F.sum("n_test").over(before), F.lit(0)).alias("n_train"), "n_test"
    )
    return sized.where((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))


def later_folds(df: DataFrame, folds: list[int], spec: PanelSpec) -> DataFrame:
    """One copy of each row per fold that trains on it; every fold is after the row's year."""
    mine = F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f > F.col(spec.year))
    return df.withColumn(FOLD, F.explode(mine))


def train_quantiles(train: DataFrame, value: str, probs: dict[str, float], folds: list[int], spec: PanelSpec) -> DataFrame:
    """Quantiles of a column over the training years of each fold. Values are counted per
    year first; only the counts are copied to the folds."""
    counted = order.tally(train, [spec.year], value)
    spread = later_folds(counted, folds, spec).groupBy(FOLD, value).agg(F.sum("n").alias("n"))
    return order.quantiles_of_counts(spread, [FOLD], value, probs)


def train_means(train: DataFrame, value: str, folds: list[int], spec: PanelSpec, out: str) -> DataFrame:
    yearly = train.groupBy(spec.year).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return later_folds(yearly, folds, spec).groupBy(FOLD).agg(ratio(F.sum("_s"), F.sum("_n")).alias(out))


def per_fold(stats: DataFrame) -> DataFrame:
    """A table with one row per fold. The folds are a literal list, so it is safe to broadcast."""
    return F.broadcast(stats)


def test_rows(df: DataFrame, folds: list[int], spec: PanelSpec) -> DataFrame:
    return df.where(F.col(spec.year).isin(folds)).withColumn(FOLD, F.col(spec.year))


def stack_scores(df: DataFrame, keep: list[str], scores: dict[str, Column], name: str = "model", value: str = "pred") -> DataFrame:
    """Long form: one row per score."""
    cells = F.array(*[F.struct(F.lit(k).alias(name), c.cast("double").alias(value)) for k, c in scores.items()])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*")


def baselines(df: DataFrame, target: str, persist: str, folds: list[int], spec: PanelSpec) -> DataFrame:
    """Persistence, training mean and training median for every test row of every fold."""
    rows = df.where(F.col(target).isNotNull())
    stats = (
        train_means(rows, target, folds, spec, "_mean")
        .join(train_quantiles(rows, target, {"_median": 0.5}, folds, spec), FOLD)
        .join(train_quantiles(rows, persist, {"_fill": 0.5}, folds, spec), FOLD, "left")
    )
    test = test_rows(rows, folds, spec).join(per_fold(stats), FOLD)
    scores = {
        "persistence": F.coalesce(F.col(persist), F.col("_fill"), F.lit(0.0)),
        "mean": F.col("_mean"),
        "median": F.col("_median"),
    }
    return stack_scores(test.withColumn("y", F.col(target)), [FOLD, spec.entity, "y"], scores)


def regression_metrics(pred: DataFrame, by: list[str], y: str = "y", p: str = "pred") -> DataFrame:
    """MAE, RMSE, R2 and rank correlation (NULL for a constant prediction)."""
    e = F.col(p) - F.col(y)
    sums = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - ratio(F.avg(e * e), F.var_pop(y))).alias("r2"),
    )
    ranked = pred.withColumn("_p", F.round(p, SCORE_DIGITS))
    return sums.join(order.spearman(ranked, by, y, "_p").drop("rows"), by, "left")


def extended_metrics(pred: DataFrame, by: list[str], weight: str, y: str = "y", p: str = "pred") -> DataFrame:
    """Weighted MAE, centred R2 and bias."""
    e = F.col(p) - F.col(y)
    return pred.groupBy(*by).agg(
        ratio(F.sum(F.col(weight) * F.abs(e)), F.sum(weight)).alias("weighted_mae"),
        (1 - ratio(F.var_pop(e), F.var_pop(y))).alias("r2_centred"),
        F.avg(e).alias("bias"),
    )


def risk_threshold(train: DataFrame, target: str, folds: list[int], spec: PanelSpec, q: float = fv.RISK_QUANTILE) -> DataFrame:
    return train_quantiles(train.where(F.col(target).isNotNull()), target, {"threshold": q}, folds, spec)


def risk_label(df: DataFrame, target: str, folds: list[int], spec: PanelSpec, q: float = fv.RISK_QUANTILE) -> DataFrame:
    """Test rows with label 1 when the target is strictly above the training quantile."""
    limits = risk_threshold(df, target, folds, spec, q)
    test = test_rows(df.where(F.col(target).isNotNull()), folds, spec).join(per_fold(limits), FOLD)
    return test.withColumn("label", (F.col(target) > F.col("threshold")).cast("int"))


def classification_metrics(scored: DataFrame, by: list[str], score: str = "score", label: str = "label", flagged: str = "flagged") -> DataFrame:
    """Accuracy, precision, recall, F1 at the given cut; ROC-AUC and average precision of the score."""
    yes, hit = F.col(label) == 1, F.col(flagged) == 1
    tp, fp = F.sum((yes & hit).cast("bigint")), F.sum((~yes & hit).cast("bigint"))
    fn, tn = F.sum((yes & ~hit).cast("bigint")), F.sum((~yes & ~hit).cast("bigint"))
    cut = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(tp + tn, F.count(F.lit(1))).alias("accuracy"),
        F.coalesce(ratio(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.avg(F.col(label).cast("double")).alias("base_rate"),
    )
    rounded = scored.withColumn("_s", F.round(score, SCORE_DIGITS))
    counted = order.tally(rounded, by, "_s", {"pos": F.col(label)})
    runs = order.running_totals(counted, by, "_s", ["n", "pos"], descending=True)
    neg, all_neg = F.col("n") - F.col("pos"), F.col("all_n") - F.col("all_pos")
    above_neg = F.col("before_n") - F.col("before_pos")
    wins = F.col("pos") * (all_neg - above_neg - neg + neg / 2)
    step = F.col("pos") * (F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n"))
    curves = runs.groupBy(*by).agg(
        ratio(F.sum(wins), F.max(F.col("all_pos") * all_neg)).alias("roc_auc"),
        ratio(F.sum(step), F.max("all_pos")).alias("pr_auc"),
    )
    return cut.join(curves, by)


def with_mixed_bits(df: DataFrame, key: Column, replicate: Column, seed: int, out: str) -> DataFrame:
    """Add a 32-bit hash of (key, replicate) from whole-number arithmetic, the same in every
    run and engine. Each step is its own projection, so that no step is computed twice."""

    def whole(v: int) -> Column:
        return F.lit(v).cast("bigint")

    wide, mul, x = whole(4294967296), whole(1540483477), F.col(out)
    df = df.withColumn(out, (F.pmod(key, whole(2147483647)) * mul + replicate * whole(668265263) + whole(seed)) % wide)
    for shift in (15, 13, 16):
        df = df.withColumn(out, (x.bitwiseXOR(F.shiftrightunsigned(x, shift)) * mul) % wide)
    return df.withColumn(out, x.bitwiseXOR(F.shiftrightunsigned(x, 15)))


# Cumulative Poisson(1) probabilities times 2^32: draws of 0, 1, 2, ... of a bootstrap weight.
POISSON_STEPS = [1580030169, 3160060337, 3950075422, 4213413783, 4279248373, 4292415291, 4294609777, 4294923275, 4294962462, 4294966816]


def with_resample_weight(df: DataFrame, key: Column, replicate: Column, seed: int, out: str) -> DataFrame:
    """Add how often a row is drawn in a replicate: a Poisson(1) count, as in drawing n of n
    rows with replacement."""
    hashed = with_mixed_bits(df, key, replicate, seed, out)
    return hashed.withColumn(out, reduce(lambda a, b: a + b, [(F.col(out) >= s).cast("int") for s in POISSON_STEPS]))


def bootstrap_ci(
    pred: DataFrame, by: list[str], key: str, replicates: int = fv.BOOTSTRAP_REPLICATES, seed: int = 42, y: str = "y", p: str = "pred"
) -> DataFrame:
    """95 % intervals of MAE and R2 by resampling entities.

    Every row computes its own weights and adds to at most ``replicates`` sums per task,
    so rows are never shuffled. Replicates with a constant target are skipped.
    """
    whole = F.col(key) if not isinstance(pred.schema[key].dataType, T.StringType) else F.xxhash64(key)
    e = F.col(p) - F.col(y)
    drawn = pred.select(
        *by, e.alias("_e"), F.col(y).alias("_y"), whole.cast("bigint").alias("_k"),
        F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_r"),
    )
    drawn = with_resample_weight(drawn, F.col("_k"), F.col("_r"), seed, "_w")
    w, t, err = F.col("_w"), F.col("_y"), F.col("_e")
    sums = drawn.groupBy(*by, "_r").agg(
        F.sum(w).alias("w"), F.sum(w * F.abs(err)).alias("ae"), F.sum(w * err * err).alias("se"),
        F.sum(w * t).alias("sy"), F.sum(w * t * t).alias("syy"),
    )
    spread = F.col("syy") - ratio(F.col("sy") * F.col("sy"), F.col("w"))
    values = sums.where(spread > 1e-9).select(
        *by, (F.col("ae") / F.col("w")).alias("mae"), (1 - F.col("se") / spread).alias("r2")
    )
    # one value per replicate: a bounded group
    return values.groupBy(*by).agg(
        *[F.percentile(m, F.lit(q)).alias(f"{m}_{tag}") for m in ("mae", "r2") for q, tag in ((0.025, "low"), (0.975, "high"))]
    )


def ols_two_features(df: DataFrame, target: str, x1: str, x2: str, folds: list[int], spec: PanelSpec, first_year: int | None = None) -> DataFrame:
    """Least squares on two median-imputed features: coefficients per fold from one aggregate."""
    train = df.where(F.col(target).isNotNull())
    if first_year is not None:
        train = train.where(F.col(spec.year) > first_year)
    fills = train_quantiles(train, x1, {"fill_1": 0.5}, folds, spec).join(train_quantiles(train, x2, {"fill_2": 0.5}, folds, spec), FOLD, "full")
    rows = later_folds(train.select(spec.year, target, x1, x2), folds, spec).join(per_fold(fills), FOLD)
    a, b = F.coalesce(F.col(x1), F.col("fill_1"), F.lit(0.0)), F.coalesce(F.col(x2), F.col("fill_2"), F.lit(0.0))
    y = F.col(target)
    m = rows.groupBy(FOLD).agg(
        F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.avg(y).alias("my"),
        F.var_pop(a).alias("s11"), F.var_pop(b).alias("s22"), F.covar_pop(a, b).alias("s12"),
        F.covar_pop(a, y).alias("s1y"), F.covar_pop(b, y).alias("s2y"),
        F.max("fill_1").alias("fill_1"), F.max("fill_2").alias("fill_2"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    coefs = m.withColumns(
        {
            "beta_1": ratio(F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y"), det),
            "beta_2": ratio(F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y"), det),
        }
    )
    return coefs.select(
        FOLD, (F.col("my") - F.col("beta_1") * F.col("m1") - F.col("beta_2") * F.col("m2")).alias("intercept"), "beta_1", "beta_2", "fill_1", "fill_2"
    )


def ols_prediction(x1: str, x2: str) -> Column:
    return (
        F.col("intercept")
        + F.col("beta_1") * F.coalesce(F.col(x1), F.col("fill_1"), F.lit(0.0))
        + F.col("beta_2") * F.coalesce(F.col(x2), F.col("fill_2"), F.lit(0.0))
    )


def fold_scores(d: DataFrame, rate: str, covariate: str, folds: list[int], first_year: int, spec: PanelSpec) -> DataFrame:
    """Test rows of every fold with all model-free scores in columns.

    ``d`` has next-year values y1, b1, n_next1 and the history columns of a forecast panel.
    """
    train = d.where(F.col("y1").isNotNull() & (F.col(spec.year) > first_year))
    stats = (
        structure.eb_prior(d, folds, spec, out=FOLD)
        .join(train_means(train, "y1", folds, spec, "train_mean"), FOLD)
        .join(train_quantiles(train, rate, {"train_median": 0.5}, folds, spec), FOLD)
        .join(ols_two_features(d, "y1", "mexp", covariate, folds, spec, first_year), FOLD)
    )
    test = test_rows(d.where(F.col("y1").isNotNull()), folds, spec).join(per_fold(stats), FOLD)
    return test.withColumns({"eb": structure.eb_score(), "ols2": ols_prediction("mexp", covariate)})


def strategy_columns(rate: str, models: dict[str, str] | None = None) -> dict[str, Column]:
    """Score columns of the named strategies: T* rank by rate, C* by count."""
    c = F.col
    scores = {
        "T0 training mean": c("train_mean"),
        "T1 persistence: rate(t)": c(rate),
        "T2 three-year mean": c("m3"),
        "T3 cumulative rate": c("pooled"),
        "T4 shrunk cumulative rate (EB)": c("eb"),
        "T5 OLS: historical mean + covariate": c("ols2"),
        "C0 size only": c("n_use"),
        "C1 persistence: count(t)": c("dropouts"),
        "C3 cumulative rate x size": c("pooled") * c("n_use"),
        "C4 EB x size": c("eb") * c("n_use"),
        "C5 OLS x size": c("ols2") * c("n_use"),
    }
    for label, column in (models or {}).items():
        scores[label] = c(column)
    return scores


def score_list(test: DataFrame, scores: dict[str, Column], spec: PanelSpec) -> DataFrame:
    """Long score list; missing scores become the training median (T*) or zero (C*)."""
    keep = [FOLD, spec.entity, "y1", "b1", "n_next1", "ever_special", "train_median"]
    long = stack_scores(test, keep, scores, "strategy", "score")
    fill = F.when(F.col("strategy").startswith("T"), F.col("train_median")).otherwise(F.lit(0.0))
    finite = F.when(F.isnan("score") | (F.abs("score") == float("inf")), None).otherwise(F.col("score"))
    return long.withColumn("score", F.round(F.coalesce(finite, fill), SCORE_DIGITS)).drop("train_median")


def score_strategies(long: DataFrame, k: int, spec: PanelSpec) -> DataFrame:
    """Quality of every strategy in every fold: list overlaps, capture, rank and error metrics."""
    by = [FOLD, "strategy"]
    ties = [spec.entity]
    one = long.where(F.col("strategy") == "T0 training mean")  # the test rows, once each
    true_rate = order.top_k(one, [FOLD], "y1", k, ties).select(FOLD, spec.entity, F.lit(1).alias("_in_rate"))
    true_count = order.top_k(one, [FOLD], "b1", k, ties).select(FOLD, spec.entity, F.lit(1).alias("_in_count"))
    best = order.top_k(long, by, "score", k, ties)
    marked = best.join(true_rate, [FOLD, spec.entity], "left").join(true_count, [FOLD, spec.entity], "left")
    lists = marked.groupBy(*by).agg(
        (F.count("_in_rate") / k).alias("overlap_rate"),
        (F.count("_in_count") / k).alias("overlap_count"),
        F.sum("b1").alias("_captured"),
        F.median("n_next1").alias("median_size"),
        F.sum((F.coalesce(F.col("ever_special"), F.lit(0.0)) == 1).cast("bigint")).alias("special"),
    )
    is_rate = F.col("strategy").startswith("T")
    e = F.col("score") - F.col("y1")
    sums = long.groupBy(*by).agg(
        F.sum("b1").alias("_all"),
        F.when(F.first(is_rate), F.avg(F.abs(e))).alias("mae"),
        F.when(F.first(is_rate), ratio(F.sum(F.abs(e) * F.col("n_next1")), F.sum("n_next1"))).alias("weighted_mae"),
        F.when(F.first(is_rate), 1 - ratio(F.avg(e * e), F.var_pop("y1"))).alias("r2"),
        F.when(F.first(is_rate), 1 - ratio(F.var_pop(e), F.var_pop("y1"))).alias("r2_centred"),
        F.when(F.first(is_rate), F.avg(e)).alias("bias"),
    )
    rho = order.spearman(long, by, "score", "y1").drop("rows")
    return (
        lists.join(sums, by)
        .join(rho, by, "left")
        .withColumn("capture", ratio(F.col("_captured"), F.col("_all")))
        .drop("_captured", "_all")
    )


def two_year_horizon(d: DataFrame, rate: str, folds: list[int], first_year: int, k: int, spec: PanelSpec, min_rows: int = 50) -> DataFrame:
    """Scores from year t against year t+2: persistence, EB and EB x size.

    Fold f scores the rows of year f-1; the fill value is the training median of fold f.
    """
    train = d.where(F.col("y1").isNotNull() & (F.col(spec.year) > first_year))
    fills = train_quantiles(train, rate, {"fill": 0.5}, folds, spec).select((F.col(FOLD) - 1).alias(FOLD), "fill")
    earlier = [f - 1 for f in folds]
    prior = structure.eb_prior(d, earlier, spec, out=FOLD)
    rows = test_rows(d.where(F.col("y2").isNotNull()), earlier, spec)
    big = rows.groupBy(FOLD).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_rows)
    scored = rows.join(per_fold(big), FOLD).join(per_fold(prior), FOLD).join(per_fold(fills), FOLD)
    scored = scored.withColumn("eb", structure.eb_score())
    long = stack_scores(
        scored.withColumn("target_year", F.col(FOLD) + 2), ["target_year", spec.entity, "y2", "b2"],
        {"persistence": F.coalesce(F.col(rate), F.col("fill")), "EB": F.col("eb"), "EB x size": F.col("eb") * F.col("n_use")},
        "strategy", "score",
    ).withColumn("score", F.round("score", SCORE_DIGITS))
    by = ["target_year", "strategy"]
    totals = long.groupBy(*by).agg(
        F.sum("b2").alias("_all"),
        F.when(F.first("strategy") != "EB x size", F.avg(F.abs(F.col("score") - F.col("y2")))).alias("mae"),
    )
    lists = order.top_k(long, by, "score", k, [spec.entity]).groupBy(*by).agg(F.sum("b2").alias("_captured"))
    rho = order.spearman(long, by, "score", "y2").drop("rows")
    return (
        totals.join(lists, by).join(rho, by, "left").withColumn("capture", ratio(F.col("_captured"), F.col("_all"))).drop("_all", "_captured")
    )


def fold_summary(metrics: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Mean and sample deviation over the folds."""
    return metrics.groupBy(*by).agg(
        *[f(c).alias(f"{c}_{tag}") for c in cols for f, tag in ((F.avg, "mean"), (F.stddev_samp, "sd"))]
    )


def model_fold_matrix(metrics: DataFrame, model: str, metric: str, folds: list[int]) -> DataFrame:
    wide = metrics.groupBy(model).pivot(FOLD, folds).agg(F.first(metric, ignorenulls=True))
    return wide.select(model, *[F.col(str(f)).alias(f"fold_{f}") for f in folds])


def group_error(pred: DataFrame, by: list[str], y: str = "y", p: str = "pred") -> DataFrame:
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"), F.avg(y).alias("mean_real")
    )


def select_best_model(metrics: DataFrame, baselines_: list[str], metric: str = "r2", model: str = "model") -> DataFrame:
    """Model with the highest mean metric over the folds, baselines left out."""
    means = metrics.where(~F.col(model).isin(baselines_)).groupBy(model).agg(F.avg(metric).alias(f"mean_{metric}"))
    return means.orderBy(F.col(f"mean_{metric}").desc_nulls_last(), model).limit(1)


def gain_over_baseline(metrics: DataFrame, baseline: str, model: str = "model") -> DataFrame:
    """Relative MAE gain of every model over a baseline in the same fold."""
    base = metrics.where(F.col(model) == baseline).select(FOLD, F.col("mae").alias("baseline_mae"))
    return metrics.where(F.col(model) != baseline).join(base, FOLD).select(
        FOLD, model, "mae", "baseline_mae", ratio(F.col("baseline_mae") - F.col("mae"), F.col("baseline_mae")).alias("gain"),
        (F.col("r2") < 0).alias("negative_r2"),
    )


def temporal_split(df: DataFrame, cut: int, year: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(year) < cut), df.where(F.col(year) == cut)


def three_way_split(df: DataFrame, target_year: str, years: list[int]) -> DataFrame:
    """Part name per row: last target year test, the one before validation, the rest train."""
    *_, valid, test = sorted(years)
    part = F.when(F.col(target_year) == test, "test").when(F.col(target_year) == valid, "validation").otherwise("train")
    return df.where(F.col(target_year).isin(years)).withColumn("part", part)


def random_split(df: DataFrame, key: list[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """Deterministic random split by a hash of the key: the same rows on every run and retry."""
    whole = reduce(lambda a, b: a * F.lit(31) + b, [F.pmod(F.col(k).cast("bigint"), F.lit(1_000_003)) for k in key])
    hashed = with_mixed_bits(df, whole, F.lit(0), seed, "part")
    return hashed.withColumn("part", F.when(F.col("part") % 10_000 < int(share * 10_000), "test").otherwise("train"))
