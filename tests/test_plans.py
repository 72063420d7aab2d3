"""The diagnostics and evaluation flows on the supplier panel."""

import pytest
from pyspark.sql import functions as F

from annalis.catalog import adapters
from annalis.operators import models
from annalis.plans import diagnostics, evaluation
from annalis.session import staged

SF = "/root/testdata/sf0.01"


def test_diagnostics(spark):
    cols = diagnostics.StageColumns("all", "ab", "ap", "rp", "enrolment", "tdi", tuple(adapters.YEARS), tuple(adapters.FOLDS), list_size=10, recent_from=1998)
    panel = adapters.strata_panel(spark, SF).where(F.col("public") == 1)
    tables = diagnostics.diagnose(panel, cols, adapters.SPEC, "stratum", "ever_special")
    assert tables["strata_last_year"].count() == 4
    assert tables["series"].count() == 7
    strategies = {(r["fold"], r["strategy"]): r for r in tables["strategies"].collect()}
    assert len(strategies) == 4 * 11
    best = {(r["fold"], r["rule"]): r["capture"] for r in tables["best_and_random"].collect()}
    for (fold, _), r in strategies.items():
        assert 0 <= r["capture"] <= best[(fold, "oracle by count")] + 1e-12
    frontier = {(r["fold"], r["power"]): r["capture"] for r in tables["frontier"].collect()}
    assert frontier[(1999, 1.0)] == pytest.approx(strategies[(1999, "C4 EB x size")]["capture"])
    assert frontier[(1999, 0.0)] == pytest.approx(strategies[(1999, "T4 shrunk cumulative rate (EB)")]["capture"])
    for name in ("denominators", "pareto", "variance", "persistent_zeros", "regression_to_mean", "quotas"):
        assert tables[name].count() > 0, name


def test_evaluation(spark):
    panel = staged(adapters.longitudinal_panel(spark, SF), "panel")
    tables = evaluation.evaluate_stage(
        panel, "ab_f_T1", "ab_f", ["ab_f", "tdi", "not_there"], ["location"], [1998, 1999, 2000], adapters.SPEC, make=lambda n, sd: {"ridge": models.ridge(n, sd)}
    )
    assert tables["metrics"].count() == 3 * 4
    assert tables["best_model"].first()["model"] == "ridge"
    final = tables["final_test"].collect()
    assert {r["model"] for r in final} == {"persistence", "mean", "median", "ridge"}
    assert all(r["mae_low"] <= r["mae"] <= r["mae_high"] for r in final)
    assert tables["recall_at_k"].where("model = 'ridge'").count() == 4
    assert tables["gain"].where("fold = 2000").count() == 3
