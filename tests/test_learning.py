"""The learning queries train what settings.py says."""

import inspect
import time
from functools import partial
from threading import Barrier, Lock

import pytest

import __spark_entry__ as entry
from stationcare import settings as S
from stationcare.plans import train
from workload import learning

CASES = {"train_classifiers": "classification", "feature_importances": "classification",
         "holdout_metrics": "classification", "scored_fleet": "classification", "train_rul": "rul",
         "permutation_importance": "rul", "linear_attribution": "rul"}


class Stopped(Exception):
    pass


@pytest.mark.parametrize("name", sorted(CASES))
def test_learning_queries_train_with_the_defaults(spark, monkeypatch, name):
    seen = []

    def spied(real, task):
        def run(*args, **kwargs):
            given = inspect.signature(real).bind(*args, **kwargs)
            given.apply_defaults()
            seen.append((task, given.arguments))
            raise Stopped
        return run

    monkeypatch.setattr(train, "train_classifiers", spied(train.train_classifiers, "classification"))
    monkeypatch.setattr(train, "train_rul", spied(train.train_rul, "rul"))
    with pytest.raises(Stopped):
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    [(task, given)] = seen
    assert task == CASES[name] and given["options"] is None
    assert given["k_best"] == S.K_BEST and given.get("balanced", True)
    assert given["names"] == (["linear_regression"] if name == "linear_attribution" else None)


def test_the_best_of_all_models_is_used(spark):
    def outcome(task, component, values):
        metric = "f1_macro" if task == "classification" else "MAE"
        models = {m: train.Trained(m, task, component, None, None) for m in values}
        return train.Outcome(models, None, spark.createDataFrame(
            [(task, component, m, metric, v) for m, v in values.items()],
            "task string, component string, model string, metric string, value double"))

    got = learning._best(outcome("classification", "-", {"random_forest": .5, "boosted_trees": .6}))
    assert {c: t.name for c, t in got.items()} == {"-": "boosted_trees"}
    got = learning._best(outcome("rul", "aceite", {"linear_regression": 1.0, "random_forest": 2.0}),
                         outcome("rul", "frenos", {"linear_regression": 4.0, "random_forest": 2.0}))
    assert {c: t.name for c, t in got.items()} == {"aceite": "random_forest", "frenos": "random_forest"}


def readings(spark):
    return spark.range(240).selectExpr("id", "id % 12 AS vehiculo_id", "cast(id % 7 AS double) AS x", "cast(id % 5 + 1 AS double) AS life",
                                       "if(id % 3 = 0, 'Normal', 'Critico') AS estado_agrupado")


@pytest.mark.parametrize("task", ["classification", "rul"])
def test_folds_are_prepared_side_by_side(spark, monkeypatch, task):
    both = Barrier(2, timeout=60)

    def met(*args, **kwargs):
        both.wait()
        raise Stopped

    monkeypatch.setattr(train, "fit_selection" if task == "classification" else "medians", met)
    with pytest.raises(Stopped):
        if task == "classification":
            train.train_classifiers(readings(spark), ["x"], k=2)
        else:
            train.train_rul(readings(spark), ["x"], "life", "c", k=2)


def test_lives_are_trained_while_the_classifier_is_fitted(spark, monkeypatch):
    all_ = Barrier(3, timeout=60)

    def classifiers(df, columns, prepared):
        prepared()
        all_.wait()
        return "-"

    def lives(df, columns, target, component, rul_targets):
        all_.wait()
        return component

    published = []
    monkeypatch.setattr(train, "train_classifiers", classifiers)
    monkeypatch.setattr(train, "train_rul", lives)
    monkeypatch.setattr(learning, "_publish", lambda outcome, root, session: published.append(outcome))
    learning._published(readings(spark).where("id < 200"), ["aceite", "frenos", "-"])
    assert sorted(published) == ["-", "aceite", "frenos"]


def test_fits_of_lives_leave_cores_to_the_classifier(spark, monkeypatch):
    most, lock, running, seen = max(4, spark.sparkContext.defaultParallelism // 2), Lock(), [0], []

    def fit(name, task, *args, **kwargs):
        with lock:
            running[0] += 1
            seen.append((task, running[0]))
        time.sleep(.2)
        with lock:
            running[0] -= 1
        raise Stopped

    monkeypatch.setattr(train.M, "fit_model", fit)
    df = readings(spark)
    for c in ("life", "x"):
        lives = [partial(train.train_rul, df, ["x"] if c == "life" else ["life"], c, c, k=4) for _ in range(2)]
        with pytest.raises(Stopped):
            train.side_by_side(lives)
    assert len(seen) == 48 and {t for t, _ in seen} == {"rul"} and max(n for _, n in seen) <= most
