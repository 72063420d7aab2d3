"""Preprocessing and MLlib models with the parameters of the evaluation protocol.

Everything is fitted on training rows only. Medians are exact quantiles, because the
MLlib imputer's are approximate; scaling uses the population deviation.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import gcd

from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalis import fixed_values as fv
from annalis.functions.scalar import ratio
from annalis.operators import order
from annalis.operators.evaluate import FOLD
from annalis.session import staged
from annalis.spec import PanelSpec

SEED = 42


def medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact medians: one small row per column. Columns without values are left out."""
    rows = order.column_quantiles(df, [], cols, {"median": 0.5}).collect()
    return {r["column"]: r["median"] for r in rows}


def impute(df: DataFrame, cols: list[str], fills: dict[str, float]) -> DataFrame:
    """Fill NULLs with the given medians; columns without a median are dropped."""
    kept = [c for c in cols if c in fills]
    out = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(fills[c]))) for c in kept}) if kept else df
    return out.drop(*[c for c in cols if c not in fills])


@dataclass
class Preprocessor:
    """Median imputation and scaling of numbers, one-hot coding of categories."""

    numeric: list[str]
    categories: list[str]
    fills: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]
    encoder: PipelineModel | None

    @classmethod
    def fit(cls, train: DataFrame, numeric: list[str], categories: list[str]) -> Preprocessor:
        fills = medians(train, numeric)
        kept = [c for c in numeric if c in fills]  # a column that is NULL in all training rows is dropped
        filled = impute(train.select(*numeric), numeric, fills)
        row = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in kept], *[F.stddev_pop(c).alias(f"s_{c}") for c in kept]).first()
        encoder = None
        if categories:
            index = [f"_i_{c}" for c in categories]
            stages = [
                StringIndexer(inputCols=[f"_t_{c}" for c in categories], outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
                OneHotEncoder(inputCols=index, outputCols=[f"_h_{c}" for c in categories], dropLast=True),  # unknown: all zeros
            ]
            encoder = Pipeline(stages=stages).fit(cls._texts(train, categories))
        return cls(kept, categories, fills, {c: row[f"m_{c}"] for c in kept}, {c: row[f"s_{c}"] or 1.0 for c in kept}, encoder)

    @staticmethod
    def _texts(df: DataFrame, categories: list[str]) -> DataFrame:
        return df.withColumns({f"_t_{c}": F.coalesce(F.col(c).cast("string"), F.lit("Missing")) for c in categories})

    def labels(self) -> list[list[str]]:
        return self.encoder.stages[0].labelsArray if self.encoder else []

    def feature_owners(self) -> list[str]:
        """Source column of every position of the feature vector."""
        return self.numeric + [c for c, names in zip(self.categories, self.labels()) for _ in names]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumns(
            {
                f"_z_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(float(self.fills[c]))) - self.means[c]) / self.deviations[c]
                for c in self.numeric
            }
        )
        if self.encoder:
            out = self.encoder.transform(self._texts(out, self.categories))
        inputs = [f"_z_{c}" for c in self.numeric] + [f"_h_{c}" for c in self.categories]
        out = VectorAssembler(inputCols=inputs, outputCol="features").transform(out)
        return out.drop(*[c for c in out.columns if c.startswith(("_t_", "_i_"))])


def ridge(rows: int, target_sd: float, alpha: float = 1.0) -> Estimator:
    """L2 regression: Spark divides by the rows and the label deviation, so alpha is rescaled."""
    return LinearRegression(
        elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * target_sd / rows, labelCol="label"
    )


def random_forest_regressor(trees: int = 300, depth: int = 10, leaf: int = 3) -> Estimator:
    return RandomForestRegressor(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="all", seed=SEED, labelCol="label"
    )


def gradient_boosting(rounds: int = 100) -> Estimator:
    return GBTRegressor(maxIter=rounds, stepSize=0.1, maxDepth=3, seed=SEED, labelCol="label")


def hist_gradient_boosting(rounds: int = 300) -> Estimator:
    return GBTRegressor(maxIter=rounds, stepSize=0.05, maxDepth=6, maxBins=255, minInstancesPerNode=20, seed=SEED, labelCol="label")


def logistic(rows: int, c: float = 1.0) -> Estimator:
    return LogisticRegression(regParam=1.0 / (c * rows), elasticNetParam=0.0, standardization=False, maxIter=2000, labelCol="label")


def random_forest_classifier(trees: int = 300, depth: int = 10, leaf: int = 3) -> Estimator:
    # The source study's forest tries the square root of the features at each split.
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=SEED, labelCol="label"
    )


def boosting_classifier(rounds: int = 300) -> Estimator:
    return GBTClassifier(maxIter=rounds, stepSize=0.05, maxDepth=6, maxBins=255, minInstancesPerNode=20, seed=SEED, labelCol="label")


def regressors(rows: int, target_sd: float, trees: int = 300, rounds: int = 100, fine_rounds: int = 300) -> dict[str, Estimator]:
    return {
        "ridge": ridge(rows, target_sd),
        "random forest": random_forest_regressor(trees),
        "gradient boosting": gradient_boosting(rounds),
        "hist gradient boosting": hist_gradient_boosting(fine_rounds),
    }


def classifiers(rows: int, trees: int = 300, fine_rounds: int = 300) -> dict[str, Estimator]:
    return {
        "logistic regression": logistic(rows),
        "random forest": random_forest_classifier(trees),
        "hist gradient boosting": boosting_classifier(fine_rounds),
    }


@dataclass
class FittedModel:
    pre: Preprocessor
    model: Model

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        scored = self.model.transform(self.pre.transform(df))
        value = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
        return scored.withColumn(out, value).select(*df.columns, out)


def label_stats(train: DataFrame, target: str) -> tuple[int, float]:
    row = train.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("s")).first()
    return row["n"], row["s"] or 0.0


def fit(train: DataFrame, target: str, estimators: dict[str, Estimator], numeric: list[str], categories: list[str]) -> dict[str, FittedModel]:
    """Fit several models on one preprocessed training table. It is written once, because
    every model passes over it many times."""
    pre = Preprocessor.fit(train, numeric, categories)
    ready = staged(pre.transform(train.withColumn("label", F.col(target).cast("double"))).select("features", "label"), "train")
    return {name: FittedModel(pre, e.fit(ready)) for name, e in estimators.items()}


def walk_forward(
    df: DataFrame, target: str, numeric: list[str], categories: list[str], folds: list[int], spec: PanelSpec,
    make: dict | None = None, exclude_years: list[int] | None = None, first_year: int | None = None, **sizes: int,
) -> DataFrame:
    """Predictions of every model for the test rows of every fold: (fold, entity, model, y, pred).

    ``make`` builds the estimators from (rows, target deviation, **sizes).
    """
    build = make or regressors
    rows = df.where(F.col(target).isNotNull())
    parts = []
    for f in folds:
        train = rows.where(F.col(spec.year) < f)
        if exclude_years:
            train = train.where(~F.col(spec.year).isin(exclude_years))
        if first_year is not None:
            train = train.where(F.col(spec.year) > first_year)
        n, sd = label_stats(train, target)
        if n == 0:
            continue
        test = rows.where(F.col(spec.year) == f).withColumn(FOLD, F.lit(f))
        for name, fitted in fit(train, target, build(n, sd, **sizes), numeric, categories).items():
            parts.append(
                fitted.predict(test).select(FOLD, spec.entity, F.lit(name).alias("model"), F.col(target).cast("double").alias("y"), "pred")
            )
    return reduce(lambda a, b: a.unionByName(b), parts)


def impurity_importance(fitted: FittedModel, spark) -> DataFrame:
    """Forest importances added up to the source columns, with their share in per cent."""
    values = fitted.model.featureImportances.toArray()
    owners = fitted.pre.feature_owners()
    rows = [(owners[i], float(v)) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "variable string, importance double")
    grouped = table.groupBy("variable").agg(F.sum("importance").alias("importance"))
    total = float(values.sum()) or 1.0
    return grouped.withColumn("share_pct", F.col("importance") / total * 100)


def permutation_importance(
    fitted: FittedModel, test: DataFrame, target: str, key: list[str], repeats: int = fv.PERMUTATION_REPEATS, seed: int = SEED
) -> DataFrame:
    """Mean and deviation of the loss of R2 when one column is shuffled over the test rows.

    Rows get a random position (the rank of a hash of the key). Repeat r takes the value at
    position (a_r x position + c_r) mod n with a_r coprime to n: a permutation that every task
    can compute. One join brings the shuffled values of all columns; the columns are then
    swapped in one at a time and only sums per (column, repeat) are shuffled.
    """
    cols = fitted.pre.numeric + fitted.pre.categories
    rows = test.select(*key, target, *cols).withColumns({"_h": F.xxhash64(F.lit(seed), *key), "n": F.lit(1)})
    placed = staged(order.running_totals(rows, [], "_h", ["n"]).withColumnRenamed("before_n", "_at").drop("n", "_h", "all_n"), "placed")
    n = placed.count()
    steps = []
    for r in range(repeats):
        a = (seed * 7919 + r * 104_729 + 1) % max(n, 1)
        while gcd(a, n) != 1:
            a += 1
        steps.append((r, a, (seed + r * 31_337) % max(n, 1)))
    moves = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(a).alias("a"), F.lit(c).alias("c")) for r, a, c in steps]))
    moved = placed.withColumn("_m", moves).withColumn("_from", (F.col("_at").cast("bigint") * F.col("_m.a") + F.col("_m.c")) % n)
    source = placed.select(F.col("_at").cast("bigint").alias("_from"), *[F.col(c).alias(f"_s_{c}") for c in cols])
    both = moved.join(source, "_from").withColumn("_r", F.col("_m.r"))
    each = both.withColumn("column", F.explode(F.array(*[F.lit(c) for c in cols])))
    swapped = each.withColumns({c: F.when(F.col("column") == c, F.col(f"_s_{c}")).otherwise(F.col(c)) for c in cols})
    keep = swapped.select("column", "_r", F.col(target).cast("double").alias("_y"), *cols)

    def r2(df: DataFrame, by: list[str]) -> DataFrame:
        e = F.col("pred") - F.col("_y")
        return df.groupBy(*by).agg((1 - ratio(F.avg(e * e), F.var_pop("_y"))).alias("r2"))

    base = r2(fitted.predict(placed.select(F.col(target).cast("double").alias("_y"), *cols)).withColumn("scope", F.lit(1)), ["scope"]).first()["r2"]
    drops = r2(fitted.predict(keep), ["column", "_r"]).withColumn("drop", F.lit(base) - F.col("r2"))
    return drops.groupBy("column").agg(F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("sd_drop"))
