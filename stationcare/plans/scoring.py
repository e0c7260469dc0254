"""Saving models, loading them, scoring a fleet and checking against held-out truth."""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.functions.states import critical_override
from stationcare.operators import class_metrics, rul_metrics
from stationcare.operators.clean import floor_zero, rul_ceiling
from stationcare.operators.select import Selection
from stationcare.plans import models as M
from stationcare.plans.boosting import Boosted
from stationcare.plans.forest import Forest
from stationcare.plans.features import FeatureState
from stationcare.plans.maintenance import action_plan
from stationcare.plans.train import Trained
from stationcare.sources.sinks import path_exists
from stationcare.sources.tables import require_columns

BUNDLE = ("version long, session string, task string, component string, model string, columns string, medians string, "
          "classes string, folder string, digest string")
TREES = "part long, state string"
#: a deep tree takes about two megabytes
TREES_A_FILE = 32


def model_path(root: str, session: str, trained_task: str, component: str, name: str) -> str:
    return f"{root}/session={session}/task={trained_task}/component={component}/model={name}"


def _content(spark: SparkSession, folder: str) -> str:
    """Digest of the files of a fitted model, by name and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.replace("path", F.lit(folder), F.lit("")).alias("p"), F.sha2("content", 256).alias("h"))
    return named.agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("p", "h")))), 256)).first()[0]


def save_model(trained: Trained, root: str, session: str) -> str:
    """Publish a model: its files go to a folder of their own, then one row is appended that names the folder.

    A run that breaks off leaves the published model in force, for only the row makes a new one known. The row holds
    a digest of the files, which loading checks.
    """
    spark = SparkSession.active()
    path = model_path(root, session, trained.task, trained.component, trained.name)
    folder = f"{path}/fitted/{uuid.uuid4().hex}"
    if hasattr(trained.model, "to_rows"):
        rows = list(enumerate(trained.model.to_rows()))
        spark.createDataFrame(rows, TREES).coalesce(math.ceil(len(rows) / TREES_A_FILE)).write.parquet(folder)
    else:
        trained.model.write().save(folder)
    row = [(time.time_ns(), session, trained.task, trained.component, trained.name, json.dumps(trained.selection.columns),
            json.dumps(trained.selection.medians), json.dumps(list(trained.classes)), folder, _content(spark, folder))]
    spark.createDataFrame(row, BUNDLE).coalesce(1).write.mode("append").json(f"{path}/bundle")
    return path


def load_model(spark: SparkSession, root: str, session: str, task: str, component: str,
               name: str) -> Trained | None:
    """The model published last, or None if this session has none of that name."""
    path = model_path(root, session, task, component, name)
    if not path_exists(spark, f"{path}/bundle"):
        return None
    row = spark.read.schema(BUNDLE).json(f"{path}/bundle").orderBy(F.desc("version")).first()
    if row is None:
        return None
    if _content(spark, row["folder"]) != row["digest"]:
        raise ValueError(f"the files in {row['folder']} are not those that were published")
    selection = Selection(json.loads(row["columns"]), json.loads(row["medians"]))
    kind = {"boosted_trees": Boosted, "random_forest": Forest, "decision_tree": Forest}.get(name)
    if kind:
        model = kind.from_rows([r["state"] for r in spark.read.schema(TREES).parquet(row["folder"]).orderBy("part").collect()])
    else:
        model = PipelineModel.load(row["folder"])
    return Trained(name, task, component, model, selection, tuple(json.loads(row["classes"])))


def save_features(state: FeatureState, root: str, session: str) -> None:
    spark = SparkSession.active()
    spark.createDataFrame([(session, state.to_json())], "session string, state string").coalesce(1).write.mode(
        "overwrite").json(f"{root}/session={session}/features")


def load_features(spark: SparkSession, root: str, session: str) -> FeatureState:
    path = f"{root}/session={session}/features"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"session {session} has no fitted features")
    return FeatureState.from_json(spark.read.schema("session string, state string").json(path).first()["state"])


def model_choice(best: DataFrame | None, available: dict[str, list[str]]) -> dict[str, str | None]:
    """Name per task: the saved choice, else the fallback, else None when that model is missing."""
    chosen = {r["task"]: r["model"] for r in best.collect()} if best is not None else {}
    out: dict[str, str | None] = {}
    for task, fallback in S.FALLBACK_MODELS.items():
        name = chosen.get(task) or fallback
        out[task] = name if name in available.get(task, []) else None
    return out


def score(df: DataFrame, classifier: Trained | None, regressors: dict[str, Trained | None],
          threshold: float = S.CRITICAL_PROBABILITY) -> DataFrame:
    """Add predicted state and RULs. A missing model gives 'N/A' or NULL, so the schema never changes."""
    out = df
    if classifier is None:
        out = out.withColumn("predicted_estado", F.lit("N/A"))
    else:
        classes = list(classifier.classes)
        scored = _apply(classifier, out)
        said = M.decoded(F.col("prediction"), classes)
        if S.CRITICAL in classes:
            chance = F.get(M.class_probabilities(scored), F.lit(classes.index(S.CRITICAL)))
            said = critical_override(said, chance, threshold=threshold)
        out = _clean(scored.withColumn("predicted_estado", said), df.columns + ["predicted_estado"], df)
    for component, trained in regressors.items():
        name = f"predicted_rul_{component}"
        if trained is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
            continue
        scored = _apply(trained, out).withColumn(name, floor_zero(F.col("prediction")))
        out = _clean(scored, out.columns + [name], out)
    return out


def _apply(trained: Trained, df: DataFrame) -> DataFrame:
    """Inputs go under private names: NULLs filled, the original columns untouched; a missing input is an error."""
    columns, medians = trained.selection.columns, trained.selection.medians
    require_columns(df, columns)
    saved = df.withColumns({f"_own_{c}": F.col(c) for c in columns})
    ready = saved.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in columns})
    return trained.model.transform(ready)


def _clean(scored: DataFrame, columns: list[str], before: DataFrame) -> DataFrame:
    return scored.select(*[F.col(f"_own_{c}").alias(c) if f"_own_{c}" in scored.columns and c in before.columns
                           else F.col(c) for c in columns])


def score_fleet(df: DataFrame, classifier: Trained | None, regressors: dict[str, Trained | None]) -> DataFrame:
    return action_plan(score(df, classifier, regressors))


def holdout_metrics(df: DataFrame, classifier: Trained | None, regressors: dict[str, Trained | None],
                    target: str = S.GROUPED_STATE, rul_targets: dict[str, str] | None = None,
                    order_by: list[str] | None = None) -> DataFrame:
    """Metrics of saved models on a separate table with known truth."""
    scored = score(df, classifier, regressors)
    parts = []
    if classifier is not None:
        known = scored.where(F.col(target).isNotNull()).withColumnsRenamed({target: "y_true", "predicted_estado": "y_pred"})
        parts.append(class_metrics.classification_metrics(known, order_by=order_by).withColumns(
            {"task": F.lit("classification"), "component": F.lit("-"), "model": F.lit(classifier.name)}))
    for component, trained in regressors.items():
        truth = (rul_targets or S.RUL_TARGETS)[component]
        if trained is None:
            continue
        pairs = scored.where(F.col(truth).isNotNull()).select(
            *(order_by or []), rul_ceiling(F.col(truth)).alias("y_true"),
            F.col(f"predicted_rul_{component}").alias("y_pred"))
        parts.append(rul_metrics.rul_metrics(pairs, order_by=order_by).withColumns(
            {"task": F.lit("rul"), "component": F.lit(component), "model": F.lit(trained.name)}))
    if not parts:
        raise ValueError("no model to evaluate")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
