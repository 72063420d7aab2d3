"""Model evaluation of one stage: walk-forward, final test, risk lists, errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalis import fixed_values as fv
from annalis.operators import evaluate as ev
from annalis.operators import models, ranking, select
from annalis.session import staged
from annalis.spec import PanelSpec

BASELINES = ["persistence", "mean", "median"]


def evaluate_stage(
    panel: DataFrame, target: str, persist: str, numeric: list[str], categories: list[str], folds: list[int], spec: PanelSpec, make=None, **sizes: int
) -> dict[str, DataFrame]:
    """Result tables of one stage; ``panel`` is the modelling universe with NULLs kept."""
    numeric = select.feature_list(panel, numeric)
    categories = select.feature_list(panel, categories)
    select.assert_no_leakage(numeric + categories)
    rows = staged(panel.where(F.col(target).isNotNull()), "universe")
    usable = [r["fold"] for r in ev.walk_forward_folds(rows, spec).select("fold").collect() if r["fold"] in folds]
    if not usable:
        raise ValueError("no fold has enough rows")
    last = max(usable)
    learned = models.walk_forward(rows, target, numeric, categories, usable, spec, make=make, **sizes)
    naive = ev.baselines(rows, target, persist, usable, spec)
    pred = staged(naive.select(*learned.columns).unionByName(learned), "predictions")
    metrics = staged(ev.regression_metrics(pred, ["fold", "model"]), "metrics")
    final = pred.where(F.col("fold") == last)
    labels = ev.risk_label(rows, target, [last], spec).select("fold", spec.entity, "label", "threshold")
    scored = staged(final.join(labels, ["fold", spec.entity]).withColumn("flagged", (F.col("pred") > F.col("threshold")).cast("int")), "scored")
    return {
        "folds": ev.walk_forward_folds(rows, spec),
        "metrics": metrics,
        "summary": ev.fold_summary(metrics, ["model"], ["mae", "rmse", "r2", "spearman"]),
        "best_model": ev.select_best_model(metrics, BASELINES),
        "final_test": metrics.where(F.col("fold") == last).join(ev.bootstrap_ci(final, ["fold", "model"], spec.entity), ["fold", "model"], "left"),
        "risk": ev.classification_metrics(scored, ["model"], score="pred"),
        "recall_at_k": ranking.recall_at_k(scored, ["model"], "pred", "label", [spec.entity], fv.LIST_SIZES),
        "error_concentration": ranking.error_concentration(final, ["model"], F.col("pred") - F.col("y"), [0.05, 0.10]),
        "gain": ev.gain_over_baseline(metrics, "persistence"),
    }
