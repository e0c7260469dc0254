"""Cross-validated training of the classifiers and the RUL regressors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from itertools import chain
from multiprocessing.pool import ThreadPool
from threading import Condition
from typing import TypeVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from stationcare import settings as S
from stationcare.functions.hashing import stable_hash
from stationcare.operators import class_metrics, rul_metrics
from stationcare.operators.balance import balance
from stationcare.operators.binning import fit_cuts
from stationcare.operators.clean import classifier_inputs, floor_zero, rul_inputs, valid_rul
from stationcare.operators.ordered import previous, with_index
from stationcare.operators.select import Selection, fit_selection, medians
from stationcare.operators.split import group_folds, stratified_group_folds
from stationcare.plans import models as M
from stationcare.plans.report import mean_over_folds
from stationcare.session import staged, unstage

T = TypeVar("T")

#: fits that run side by side: a fit on a small table is mostly scheduling
PARALLEL_FITS = 4


class _Turns:
    """Fits of lives under way in this session, of all trainings started side by side.

    A fit holds a core for a minute where its rows are in one task. Half of the cores are left to the classifier, whose
    tables take longest to prepare: its jobs would wait behind the fits, and its own fits begin last.
    """

    def __init__(self) -> None:
        self.free, self.running = Condition(), 0

    def take(self, work: Callable[[], T]) -> T:
        most = max(PARALLEL_FITS, SparkSession.active().sparkContext.defaultParallelism // 2)
        with self.free:
            self.free.wait_for(lambda: self.running < most)
            self.running += 1
        try:
            return work()
        finally:
            with self.free:
                self.running -= 1
                self.free.notify()


_turns = _Turns()


@dataclass(frozen=True)
class Trained:
    """A fitted model with all that scoring needs."""

    name: str
    task: str
    component: str
    model: M.Model
    selection: Selection
    classes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Outcome:
    """Models by name, out-of-fold predictions and mean metrics."""

    models: dict[str, Trained]
    predictions: DataFrame
    metrics: DataFrame

    def summary(self) -> DataFrame:
        return mean_over_folds(self.metrics, ["task", "component", "model"])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def side_by_side(works: list[Callable[[], T]]) -> list[T]:
    """Results of independent fits that several threads of the driver start; the tasks are Spark's as ever."""
    if not works:
        return []
    with ThreadPool(min(PARALLEL_FITS, len(works))) as pool:
        return pool.map(lambda work: work(), [inheritable_thread_target(SparkSession.active())(work) for work in works])


def _outcome(kept: dict[str, Trained], parts: list[DataFrame], task: str, component: str,
             order_by: list[str] | None, classes: list[str] | None = None) -> Outcome:
    """Predictions are written once; every metric of every fold and model reads that table."""
    predictions = staged(_union(parts), f"predictions-{task}")
    by = ["model", "fold"]
    if task == "classification":
        metrics = class_metrics.classification_metrics(
            predictions, probabilities="proba", classes=classes, order_by=order_by, by=by)
    else:
        metrics = rul_metrics.rul_metrics(predictions, order_by=order_by, by=by)
    return Outcome(kept, predictions, metrics.withColumns(
        {"task": F.lit(task), "component": F.lit(component)}))


def train_classifiers(df: DataFrame, columns: list[str], target: str = S.GROUPED_STATE,
                      group: str = S.MACHINE_ID, key: str = "id", k: int = S.FOLDS,
                      names: list[str] | None = None, k_best: int = S.K_BEST, balanced: bool = True,
                      order_by: list[str] | None = None,
                      options: dict[str, dict] | None = None,
                      prepared: Callable[[], None] | None = None) -> Outcome:
    """Per fold: select features, fill medians, balance, fit, predict; last fold's models are kept.

    ``prepared`` is called when the folds are written, for work that may go on beside the training.
    """
    columns = classifier_inputs(columns)
    order_by = list(order_by or [])
    keep = list(dict.fromkeys([key, group, target, *order_by, *columns]))
    folded = stratified_group_folds(df.select(*keep).where(F.col(target).isNotNull()), group, target, k)
    folded = staged(folded, "folds")
    sizes = {r["fold"]: r["n"] for r in folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(r[0] for r in folded.select(target).distinct().collect())
    if prepared:
        prepared()
    scratch = [folded]

    def prepare(fold: int) -> tuple[int, Selection, dict[str, list[float]], DataFrame]:
        train = folded.where(F.col("fold") != fold)
        chosen = fit_selection(train, columns, target, "classification", k=k_best,
                               rows=sum(sizes.values()) - sizes.get(fold, 0))
        filled = chosen.transform(train)

        def written() -> DataFrame:
            rows = (balance(filled, target, key, chosen.columns) if balanced
                    else filled.select(target, *chosen.columns))
            ready = staged(rows.withColumn(M.LABEL, M.encoded(F.col(target), classes)), "training")
            scratch.append(ready)
            return ready

        ready, cuts = side_by_side([written, partial(fit_cuts, filled, chosen.columns, rows=sum(sizes.values()) - sizes.get(fold, 0))])
        return fold, chosen, cuts, ready

    def fit(name: str, fold: int, chosen: Selection, cuts: dict[str, list[float]], ready: DataFrame) -> tuple[int, Trained]:
        fitted = M.fit_model(name, "classification", ready, chosen.columns, len(classes), cuts=cuts,
                             class_weights=M.class_weights(classes), **(options or {}).get(name, {}))
        return fold, Trained(name, "classification", "-", fitted, chosen, tuple(classes))

    try:
        kept, parts = {}, []
        tables = side_by_side([partial(prepare, fold) for fold in range(k)])
        for fold, trained in side_by_side([partial(fit, name, *made) for made in tables for name in names or M.CLASSIFIERS]):
            scored = trained.model.transform(trained.selection.transform(folded.where(F.col("fold") == fold)))
            parts.append(scored.select(
                F.col(key).alias("id"), *[F.col(c) for c in order_by if c != key],
                F.col(target).alias("y_true"), M.decoded(F.col("prediction"), classes).alias("y_pred"),
                M.class_probabilities(scored).alias("proba"), F.lit(fold).alias("fold"), F.lit(trained.name).alias("model")))
            kept[trained.name] = trained
        return _outcome(kept, parts, "classification", "-", order_by, classes)
    finally:
        unstage(*scratch)


def train_rul(df: DataFrame, columns: list[str], target: str, component: str, group: str = S.MACHINE_ID,
              key: str = "id", k: int = S.FOLDS, names: list[str] | None = None, k_best: int = S.K_BEST,
              order_by: list[str] | None = None, options: dict[str, dict] | None = None,
              rul_targets: list[str] | None = None) -> Outcome | None:
    """Valid rows up to the ceiling, selection once, then grouped folds; None without valid rows."""
    columns = rul_inputs(columns, rul_targets)
    order_by = list(order_by or [])
    usable = valid_rul(df.select(*dict.fromkeys([key, group, target, *order_by, *columns])), target)
    # several passes follow: the inputs are worked out once
    folded = staged(group_folds(usable, group, k), "folds")
    rows = folded.count()
    chosen = fit_selection(folded, columns, target, "regression", k=k_best, rows=rows) if rows else Selection([], {})
    if not chosen.columns:
        unstage(folded)
        return None
    # early stopping looks at a tenth of the training machines, never at the test fold
    held = F.pmod(stable_hash(F.col(group), seed="validation"), F.lit(10)) == 0
    scratch = [folded]
    trees = any(name not in M.LINEAR for name in names or M.REGRESSORS)

    def folds_models(fold: int) -> list[tuple[int, Trained]]:
        train = folded.where(F.col("fold") != fold)
        found = medians(train, chosen.columns, rows=rows)
        filling = Selection([c for c in chosen.columns if c in found], found)
        ready = staged(filling.transform(train).withColumns({M.LABEL: F.col(target), M.VALIDATION: held}), "training")
        scratch.append(ready)
        seen = ready.agg(F.count_if(M.VALIDATION).alias("v"), F.count(F.lit(1)).alias("n")).first()
        validate = 0 < seen["v"] < seen["n"]
        cuts = fit_cuts(ready, filling.columns, rows=seen["n"]) if trees else None

        def fit(name: str) -> tuple[int, Trained]:
            fitted = _turns.take(lambda: M.fit_model(
                name, "rul", ready, filling.columns, validate=validate, cuts=cuts, **(options or {}).get(name, {})))
            return fold, Trained(name, "rul", component, fitted, filling)

        # the longest fit, that of the last kind, goes first
        return side_by_side([partial(fit, name) for name in reversed(names or M.REGRESSORS)])[::-1]

    try:
        kept, parts = {}, []
        # fits of a fold start while another fold is still being written
        for fold, trained in chain(*side_by_side([partial(folds_models, fold) for fold in range(k)])):
            parts.append(trained.model.transform(trained.selection.transform(folded.where(F.col("fold") == fold))).select(
                F.col(key).alias("id"), *[F.col(c) for c in order_by if c != key],
                F.col(target).alias("y_true"), floor_zero(F.col("prediction")).alias("y_pred"),
                F.lit(fold).alias("fold"), F.lit(trained.name).alias("model"), F.lit(component).alias("component")))
            kept[trained.name] = trained
        return _outcome(kept, parts, "rul", component, order_by)
    finally:
        unstage(*scratch)


def importances(trained: Trained, top: int | None = None) -> DataFrame:
    """Importance of each input of a tree model, absolute weight for a linear one; the ``top`` largest only if given."""
    names = trained.selection.columns
    if hasattr(trained.model, "importances"):
        values = trained.model.importances()
    else:
        values = np.abs(trained.model.stages[-1].coefficientMatrix.toArray()).mean(axis=0) if hasattr(
            trained.model.stages[-1], "coefficientMatrix") else np.abs(trained.model.stages[-1].coefficients.toArray())
    spark = SparkSession.active()
    found = spark.createDataFrame(list(zip(names, map(float, values), strict=True)), "feature string, importance double")
    ordered = found.orderBy(F.desc("importance"), "feature")
    return ordered if top is None else ordered.limit(top)


def permutation_importance(trained: Trained, df: DataFrame, target: str, key: str = "id",
                           rows: int | None = None) -> DataFrame:
    """Loss of accuracy, or rise of MAE, when one input is shuffled between rows.

    Rows line up in hash order and each takes the value of the row before it, so one ordered pass shuffles every
    input. Each row is then scored once as it is and once per input, all in one pass.
    """
    rows = df.count() if rows is None else rows
    names = trained.selection.columns
    filled = trained.selection.transform(df.where(F.col(target).isNotNull())).select(key, target, *names)
    hashed = filled.withColumn("_h", stable_hash(F.col(key), seed="shuffle"))
    numbered = with_index(hashed, ["_h", key], rows=rows)
    mixed = staged(previous(numbered, {f"_s_{c}": c for c in names}, rows), "shuffled")
    turns = mixed.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
    swapped = turns.withColumns({c: F.when(F.col("_turn") == i, F.coalesce(f"_s_{c}", c)).otherwise(F.col(c))
                                 for i, c in enumerate(names, 1)})
    scored = trained.model.transform(swapped)
    if trained.task == "rul":
        miss = F.abs(F.col(target) - floor_zero(F.col("prediction")))
    else:
        miss = (M.decoded(F.col("prediction"), list(trained.classes)) != F.col(target)).cast("double")
    losses = scored.groupBy("_turn").agg(F.avg(miss).alias("loss")).collect()  # one row per input
    unstage(mixed)
    found = {r["_turn"]: r["loss"] for r in losses}
    lines = [(c, found[i] - found[0]) for i, c in enumerate(names, 1)] if found else []
    return df.sparkSession.createDataFrame(lines, "feature string, importance double")


def linear_attribution(trained: Trained, df: DataFrame, key: str = "id") -> DataFrame:
    """Exact contribution of each input to a linear prediction: weight times distance from the mean."""
    scaler, last = trained.model.stages[-2], trained.model.stages[-1]
    filled = trained.selection.transform(df)
    parts = {f"phi_{c}": F.lit(float(last.coefficients[i] / scaler.std[i]) if scaler.std[i] else 0.0)
             * (F.col(c) - F.lit(float(scaler.mean[i]))) for i, c in enumerate(trained.selection.columns)}
    return filled.select(key, *[p.alias(n) for n, p in parts.items()])
