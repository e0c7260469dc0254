"""The two whole jobs: train a session, and score a file with a saved session."""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.plans.features import engineer
from stationcare.plans.preprocess import clean_readings, preprocess
from stationcare.plans.report import best_models
from stationcare.plans.scoring import (holdout_metrics, load_features, load_model, model_choice, save_features,
                                       save_model, score_fleet)
from stationcare.plans.train import side_by_side, train_classifiers, train_rul
from stationcare.roles import Roles
from stationcare.sources.sinks import (METRICS, STAGES, Checkpoints, metrics_table, path_exists, save_predictions,
                                       write_scores)


def train_session(df: DataFrame, root: str, session: str, sampling_hz: float = S.SAMPLING_HZ,
                  test: DataFrame | None = None, profile: str = "full", force: str | None = None,
                  roles: Roles | None = None, classifiers: list[str] | None = None,
                  regressors: list[str] | None = None, options: dict[str, dict] | None = None,
                  k_best: int = S.K_BEST) -> DataFrame:
    """Clean, engineer, train, choose and save; returns the best model per task.

    Stage outputs are tables under ``root``; a finished stage is reused unless ``force`` names it (``features``,
    ``classification``, ``rul``) or is ``all``. New features retrain everything. What a stage needs later is
    written before its own table, so a run that broke off is not taken for a finished one; a stage made with
    another profile, rate or number of rows is refused. Metrics are those of the last training only.
    """
    if force not in (None, "all", *STAGES):
        raise ValueError(f"force is one of {['all', *STAGES]}")
    spark = df.sparkSession
    checkpoints = Checkpoints(spark, f"{root}/checkpoints", session)
    cleaned, roles = clean_readings(df, roles)
    made = {"profile": profile, "sampling_hz": float(sampling_hz), "rows": df.count()}
    fresh = force in ("all", "features") or not checkpoints.has("features")
    if fresh:
        prepared = preprocess(df, profile, sampling_hz, roles)
        save_features(prepared.state, f"{root}/models", session)
        spark.createDataFrame([(json.dumps(made, sort_keys=True),)], "made string").coalesce(1).write.mode(
            "overwrite").json(checkpoints.path("features-made"))
        checkpoints.save("features", prepared.df)
    else:
        before = json.loads(spark.read.schema("made string").json(checkpoints.path("features-made")).first()["made"])
        if before != made:
            raise ValueError(f"session {session} has features made with {before}, not {made}; force them anew")
    table = checkpoints.load("features")
    inputs = [c for c, t in table.dtypes if t not in ("string", "timestamp", "boolean")
              and c not in (roles.timestamp, roles.target)]
    inputs = [c for c in inputs if c not in roles.rul_targets.values()]
    order = list(roles.order_key)

    def stale(task: str, component: str = "-") -> bool:
        return fresh or force in ("all", task) or not path_exists(spark, _metrics_path(root, session, task, component))

    works = []
    if stale("classification"):
        works.append(partial(
            train_classifiers, table, inputs, roles.target, roles.machine_id, names=classifiers, order_by=order,
            options=(options or {}).get("classification"), k_best=k_best))
    for component, target in roles.rul_targets.items():
        if stale("rul", component):
            works.append(partial(
                train_rul, table, inputs, target, component, roles.machine_id, names=regressors, order_by=order,
                options=(options or {}).get("rul"), k_best=k_best, rul_targets=list(roles.rul_targets.values())))
    outcomes = [done for done in side_by_side(works) if done is not None]
    for outcome in outcomes:
        for trained in outcome.models.values():
            save_model(trained, f"{root}/models", session)
            save_predictions(outcome.predictions.where(F.col("model") == trained.name).drop("model"),
                             f"{root}/predictions", f"{trained.task}-{trained.component}", trained.name, session)
        first = next(iter(outcome.models.values()))
        # the last write of a stage: with it the stage is finished
        _replace_metrics(metrics_table(outcome.metrics, session, first.task, first.component), root, session,
                         first.task, first.component)
    everything = spark.read.schema(METRICS).parquet(f"{root}/metrics").where(F.col("session") == session)
    best = best_models(everything)
    best.coalesce(1).write.mode("overwrite").parquet(f"{root}/models/session={session}/best")
    if test is not None:
        metrics_table(_evaluate(test, root, session, roles, profile), session, "holdout").drop("session").write.mode(
            "overwrite").parquet(f"{root}/holdout/session={session}")
    return spark.read.parquet(f"{root}/models/session={session}/best")


def _metrics_path(root: str, session: str, task: str, component: str) -> str:
    return f"{root}/metrics/session={session}/task={task}/component={component}"


def _replace_metrics(metrics: DataFrame, root: str, session: str, task: str, component: str) -> None:
    metrics.drop("session", "task", "component").write.mode("overwrite").parquet(
        _metrics_path(root, session, task, component))


def _load(spark, root: str, session: str, roles: Roles):
    models = f"{root}/models"
    saved = f"{models}/session={session}/best"
    best = spark.read.parquet(saved) if path_exists(spark, saved) else None
    parts = {"classification": ["-"], "rul": list(roles.rul_targets)}
    offered = {r["task"]: [r["model"]] for r in best.collect()} if best is not None else {}
    offered = {task: [*offered.get(task, []), S.FALLBACK_MODELS[task]] for task in parts}
    names = model_choice(best, offered)

    def found(task: str, component: str):
        return load_model(spark, models, session, task, component, names[task])

    return found("classification", "-"), {c: found("rul", c) for c in parts["rul"]}


def _features(df: DataFrame, root: str, session: str, roles: Roles | None, profile: str, refit: bool):
    cleaned, roles = clean_readings(df, roles)
    state = None if refit else load_features(df.sparkSession, f"{root}/models", session)
    hz = state.sampling_hz if state else S.SAMPLING_HZ
    rich, _ = engineer(cleaned, roles, profile, state, hz)
    return rich, roles


def _evaluate(test: DataFrame, root: str, session: str, roles: Roles, profile: str) -> DataFrame:
    rich, roles = _features(test, root, session, roles, profile, refit=False)
    classifier, regressors = _load(test.sparkSession, root, session, roles)
    return holdout_metrics(rich, classifier, regressors, roles.target, roles.rul_targets, list(roles.order_key))


def score_session(df: DataFrame, root: str, session: str, roles: Roles | None = None, profile: str = "full",
                  refit: bool = False, save: bool = True) -> DataFrame:
    """Score readings with a saved session and add the maintenance plan.

    ``refit`` learns baselines from these readings instead of the saved ones.
    """
    rich, roles = _features(df, root, session, roles, profile, refit)
    classifier, regressors = _load(df.sparkSession, root, session, roles)
    plan = score_fleet(rich, classifier, regressors)
    if not save:
        return plan
    write_scores(plan, f"{root}/scores", session)
    return df.sparkSession.read.parquet(f"{root}/scores/session={session}")
