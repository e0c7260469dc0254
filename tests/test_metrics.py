import math

import pytest

from stationcare.operators import class_metrics as cm
from stationcare.operators import rul_metrics as rm
from stationcare.plans import report


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def labelled(spark, truth, said):
    short = {"C": "Critico", "N": "Normal"}
    return spark.createDataFrame([(i, short[a], short[b]) for i, (a, b) in enumerate(zip(truth, said))],
                                 "i long, y_true string, y_pred string")


def test_detection(spark):
    got = values(cm.time_to_detection(labelled(spark, "NCCNC", "NNCNN"), ["i"]))
    assert got == {"avg_time_to_detection": 1, "median_time_to_detection": 1, "detection_rate": .5}
    none = values(cm.time_to_detection(labelled(spark, "NNN", "NCN"), ["i"]))
    assert none == {"avg_time_to_detection": 0, "median_time_to_detection": 0, "detection_rate": 1.0}
    never = values(cm.time_to_detection(labelled(spark, "CC", "NN"), ["i"]))
    assert math.isinf(never["avg_time_to_detection"]) and never["detection_rate"] == 0


def test_costs(spark):
    got = values(cm.cost_metrics(labelled(spark, "CNC", "NCC")))
    assert got == {"total_operational_cost": 1050, "cost_per_prediction": 350, "total_fp_cost": 50, "total_fn_cost": 1000}


def test_macro_counts_every_label_seen(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "a")], "y_true string, y_pred string")
    got = values(cm.basic_metrics(df))
    assert got["accuracy"] == pytest.approx(2 / 3) and got["f1_macro"] == pytest.approx(.4)
    assert cm.critical_class_metrics(df).count() == 0
    assert cm.confusion(df).count() == 4


def test_confusion_adds_up(spark):
    df = labelled(spark, "NCCNCNNC", "NNCNNCCC")
    assert sum(r["n"] for r in cm.confusion(df).collect()) == 8


def test_precision_at_k(spark):
    df = spark.createDataFrame([("Critico", [.2, .5, .3]), ("Critico", [.6, .3, .1]), ("Normal", [1.0, .0, .0])],
                               "y_true string, proba array<double>")
    got = values(cm.precision_at_k(df, ["Advertencia", "Critico", "Normal"], ks=[1, 2, 5]))
    assert list(got.values()) == [.5, 1.0, 1.0]
    quiet = values(cm.precision_at_k(df.where("y_true = 'Normal'"), ["Advertencia", "Critico", "Normal"], ks=[1]))
    assert quiet == {"precision_at_1_critical": 0.0}


def test_rul(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 4.0, 4.0), (3, 12.0, 9.0)], "i long, y_true double, y_pred double")
    got = values(rm.rul_metrics(df, order_by=["i"]))
    assert got["MAE"] == pytest.approx(4 / 3)
    assert got["accuracy_band_1d"] == pytest.approx(2 / 3) and got["accuracy_band_3d"] == 1
    assert got["prognostic_horizon"] == 1 and got["prognostic_horizon_samples"] == 1
    assert (got["MAE_0-2d"], got["MAE_2-5d"], got["MAE_>10d"]) == (1, 0, 3) and "MAE_5-10d" not in got
    assert got["directional_accuracy"] == 1


def test_constant_truth(spark):
    same = spark.createDataFrame([(1, 2.0, 2.0), (2, 2.0, 2.0)], "i long, y_true double, y_pred double")
    assert values(rm.error_metrics(same))["R2"] == 1.0
    off = spark.createDataFrame([(1, 2.0, 3.0)], "i long, y_true double, y_pred double")
    assert values(rm.error_metrics(off))["R2"] == 0.0
    assert values(rm.directional_accuracy(off, ["i"])) == {"directional_accuracy": 0.0}


def test_by_fold_equals_separate(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 7), float(i % 5)) for i in range(60)],
                               "i long, fold int, y_true double, y_pred double")
    both = rm.rul_metrics(df, order_by=["i"], by=["fold"])
    for fold in (0, 1):
        assert values(both.where(f"fold = {fold}")) == pytest.approx(
            values(rm.rul_metrics(df.where(f"fold = {fold}"), order_by=["i"])))


def test_drift(spark):
    rows = [(1, "A"), (1, "B"), (2, "A"), (2, "B"), (3, "C")]
    df = spark.createDataFrame(rows, "w int, c string")
    got = {r["w"]: r["similarity"] for r in cm.distribution_drift(df, "w", "c").collect()}
    assert got[2] == pytest.approx(1.0) and got[3] == pytest.approx(1 - math.sqrt(math.log(2)))


def test_business_case(spark):
    got = report.business_report(labelled(spark, "CNC", "NCC")).first()
    assert (got["total_annual_benefits"], got["net_annual_benefit"]) == (31500, 23500)
    assert got["payback_period_years"] == pytest.approx(1.9149, abs=1e-4)
    assert got["total_cost"] == 1200 and len(got["recommendations"]) == 3


def test_best_model_with_fallback(spark):
    m = spark.createDataFrame([("classification", "f1_macro", "a", .5), ("classification", "f1_macro", "b", .7)],
                              "task string, metric string, model string, value double")
    got = {r["task"]: r["model"] for r in report.best_models(m).collect()}
    assert got == {"classification": "b", "rul": "boosted_trees"}


def test_calendar_weeks_cross_the_year(spark):
    df = spark.createDataFrame([("2023-12-27",), ("2024-01-03",)], "t string").selectExpr("cast(t as timestamp) t")
    got = [r["semana_relativa"] for r in report.relative_week(df, "t", calendar=True).orderBy("t").collect()]
    assert got == [1, 2]


def test_empty_predictions(spark):
    empty = spark.createDataFrame([], "i long, y_true double, y_pred double")
    assert values(rm.error_metrics(empty))["MAE"] is None
    none = spark.createDataFrame([], "i long, y_true string, y_pred string")
    assert values(cm.time_to_detection(none, ["i"]))["detection_rate"] == 1.0


def test_detection_without_critical_runs_on_both_paths(spark, monkeypatch):
    """The way of large tables answers like the way of small ones where there is nothing to rank."""
    from stationcare.operators import class_metrics, quantiles

    df = spark.createDataFrame([(i, "Normal", "Normal") for i in range(20)], "id long, y_true string, y_pred string")
    want = {"avg_time_to_detection": 0.0, "median_time_to_detection": 0.0, "detection_rate": 1.0}
    for limit in (200_000, 0):
        monkeypatch.setattr(quantiles.quantiles, "__defaults__", (None, None, limit, 200_000))
        got = {r["metric"]: r["value"] for r in class_metrics.time_to_detection(df, ["id"]).collect()}
        assert got == want


def test_quantiles_of_nothing_and_of_groups(spark):
    from stationcare.operators.quantiles import quantiles

    none = spark.createDataFrame([(None, "a")] * 9, "x double, g string")
    assert quantiles(none, ["x"], [0.5], exact_limit=0).collect() == []
    assert quantiles(none.limit(0), ["x"], [0.5], by=["g"], exact_limit=0).collect() == []
    rows = [(float(i % 37), "a" if i < 300 else "b" if i < 330 else None) for i in range(360)]
    df = spark.createDataFrame(rows, "x double, g string")
    small = {r["g"]: (r["n"], r["q"]) for r in quantiles(df, ["x"], [0.1, 0.5], by=["g"]).collect()}
    mixed = {r["g"]: (r["n"], r["q"]) for r in quantiles(df, ["x"], [0.1, 0.5], by=["g"], exact_limit=100).collect()}
    assert small == mixed and len(small) == 3
