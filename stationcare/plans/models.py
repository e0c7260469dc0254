"""Estimators for the fault classes and the remaining useful life.

All tree models look at the same candidate splits (``operators.binning``) and are grown in ``plans.forest`` and
``plans.boosting``; linear models are those of Spark ML.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcare import settings as S
from stationcare.operators.quantiles import quantile_values
from stationcare.plans.boosting import Boosted, fit_boosted
from stationcare.plans.forest import Forest, fit_forest

LABEL, FEATURES, VALIDATION = "_label", "_features", "_validation"

CLASSIFIERS = ["random_forest", "boosted_trees"]
REGRESSORS = ["linear_regression", "random_forest", "boosted_trees"]


#: option names of the settings, and those of ``fit_boosted`` and ``fit_forest``
_BOOSTED = {"maxIter": "rounds", "maxDepth": "depth", "stepSize": "rate", "subsamplingRate": "row_share",
            "featureSubsetStrategy": "column_share", "minInstancesPerNode": "least_hessian", "minInfoGain": "least_gain",
            "patience": "patience"}
_FOREST = {"numTrees": "trees", "maxDepth": "depth", "minInstancesPerNode": "least_rows", "minSplit": "least_split",
           "featureSubsetStrategy": "feature_share", "bootstrap": "bootstrap"}
LINEAR = {"logistic_regression": LogisticRegression, "linear_regression": LinearRegression}
Model = PipelineModel | Boosted | Forest


def fit_model(name: str, task: str, rows: DataFrame, columns: list[str], classes: int = 0, validate: bool = False,
              cuts: dict[str, list[float]] | None = None, class_weights: list[float] | None = None, seed: int = S.SEED,
              **over) -> Model:
    """A fitted model of any kind, from rows with ``LABEL``; ``over`` replaces options of the settings.

    Boosted trees stop early only with validation rows (``validate``: where ``VALIDATION`` is true); ``class_weights``
    are for forests.
    """
    classes = classes if task == "classification" else 0
    if name == "boosted_trees":
        given = {_BOOSTED[k]: v for k, v in ((S.BOOSTED_CLASSIFIER if classes else S.BOOSTED_REGRESSOR) | over).items()}
        given["column_share"] = float(given["column_share"])
        return fit_boosted(rows, columns, LABEL, classes, validation=VALIDATION if validate else None, seed=seed, cuts=cuts, **given)
    if name in ("random_forest", "decision_tree"):
        known = (S.DECISION_TREE if name == "decision_tree" else S.FOREST_CLASSIFIER if classes else S.FOREST_REGRESSOR)
        given = {_FOREST[k]: v for k, v in (known | over).items()}
        return fit_forest(rows, columns, LABEL, classes, class_weights=class_weights, seed=seed, cuts=cuts, **given)
    return pipeline(linear(name, **over), columns, scale=True).fit(rows)


def linear(name: str, **over) -> Estimator:
    if name not in LINEAR:
        raise ValueError(f"unknown model {name}")
    return LINEAR[name](labelCol=LABEL, featuresCol=FEATURES, **((S.LOGISTIC if name == "logistic_regression" else {}) | over))


def pipeline(estimator: Estimator, columns: list[str], scale: bool = False) -> Pipeline:
    if not scale:
        return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol=FEATURES), estimator])
    return Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol=FEATURES, withMean=True, withStd=True), estimator])


def encoded(label: Column, classes: list[str]) -> Column:
    """Position in the sorted class list, as the estimators want it."""
    spot = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    return F.when(spot > 0, (spot - 1).cast("double"))


def decoded(position: Column, classes: list[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), position.cast("int"))


def class_weights(classes: list[str]) -> list[float]:
    return [S.CLASS_WEIGHTS.get(c, 1.0) for c in classes]


def class_probabilities(scored: DataFrame) -> Column:
    """Probability array."""
    if isinstance(scored.schema["probability"].dataType, T.ArrayType):
        return F.col("probability")
    return vector_to_array("probability")


def robust_scaled(df: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95,
                  rows: int | None = None) -> DataFrame:
    """Centre by the median and scale by the 5-95 % range, from exact quantiles."""
    found = quantile_values(df, columns, [low, 0.5, high], rows=rows)
    out = {}
    for c, (bottom, middle, top) in found.items():
        width = (top - bottom) if top is not None and top > bottom else 1.0
        out[f"{c}_escalado"] = (F.col(c).cast("double") - F.lit(middle).cast("double")) / F.lit(width)
    return df.withColumns(out)


def quantile_bins(df: DataFrame, columns: list[str], bins: int = 10, rows: int | None = None) -> DataFrame:
    """Ordinal bins between exact quantiles; equal edges merge, values at an edge go up."""
    found = quantile_values(df, columns, [i / bins for i in range(1, bins)], rows=rows)
    out = {}
    for c, edges in found.items():
        cuts = sorted({e for e in edges if e is not None})
        spot = F.lit(0)
        for i, edge in enumerate(cuts, 1):
            spot = F.when(F.col(c) >= F.lit(edge), i).otherwise(spot)
        out[f"{c}_bin"] = F.when(F.col(c).isNotNull(), spot)
    return df.withColumns(out)
