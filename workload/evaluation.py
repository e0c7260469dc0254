"""Metrics, costs, splits and model choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.functions.states import critical_override
from stationcare.operators import class_metrics as cm
from stationcare.operators import clean, rul_metrics as rm, split
from stationcare.plans import report
from workload import views
from workload.registry import CLASSES, RULS, STATES, hash_sql, plain, query

ORDER = ["timestamp", "id"]
BY_TIME = "ORDER BY timestamp, id"

PER_CLASS = """counts AS (SELECT y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL),
labels AS (SELECT DISTINCT label FROM (SELECT y_true AS label FROM preds UNION ALL SELECT y_pred FROM preds)),
cls AS (SELECT label, coalesce(sum(n) FILTER (y_true = label), 0) AS support,
    coalesce(sum(n) FILTER (y_pred = label), 0) AS predicted,
    coalesce(sum(n) FILTER (y_true = label AND y_pred = label), 0) AS hits FROM counts, labels GROUP BY label),
prf AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS p,
    CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r,
    CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f FROM cls)"""


def _rows(**metrics: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, round({e}, 6) AS value" for n, e in metrics.items())


@query("threshold_override", f"""WITH {CLASSES}
SELECT id, CASE WHEN p1 > 0.35 THEN 'Critico' ELSE y_pred END AS y_pred FROM preds""")
def threshold_override(spark, d):
    p = views.class_predictions(spark, d)
    return p.select("id", critical_override(F.col("y_pred"), F.col("proba")[1]).alias("y_pred"))


@query("confusion", f"""WITH {CLASSES}, labels AS (
  SELECT DISTINCT label FROM (SELECT y_true AS label FROM preds UNION ALL SELECT y_pred FROM preds))
SELECT a.label AS y_true, b.label AS y_pred, count(id) AS n FROM labels a CROSS JOIN labels b
LEFT JOIN preds ON y_true = a.label AND y_pred = b.label GROUP BY ALL""")
def confusion(spark, d):
    return cm.confusion(views.class_predictions(spark, d))


@query("class_metrics", f"WITH {CLASSES}, {PER_CLASS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, round({e}, 6) AS value FROM prf" for n, e in {
        "accuracy": "sum(hits) / sum(support)", "f1_macro": "avg(f)",
        "f1_weighted": "sum(f * support) / sum(support)", "precision_macro": "avg(p)",
        "recall_macro": "avg(r)"}.items())
    + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{n}_Critico', round({e}, 6) FROM prf WHERE label = 'Critico' AND support > 0"
    for n, e in {"precision": "p", "recall": "r", "f1": "f"}.items()))
def class_metrics(spark, d):
    p = views.class_predictions(spark, d)
    return plain(cm.basic_metrics(p).unionByName(cm.critical_class_metrics(p)))


@query("precision_at_k", f"""WITH {CLASSES}, long AS (
  SELECT id, y_true, 'Advertencia' AS c, p0 AS p, 0 AS i FROM preds UNION ALL SELECT id, y_true, 'Critico', p1, 1 FROM preds
  UNION ALL SELECT id, y_true, 'Normal', p2, 2 FROM preds), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, i DESC) AS k FROM long)
SELECT 'precision_at_' || ks.k || '_critical' AS metric, round(avg(CASE WHEN ranked.k <= ks.k THEN 1.0 ELSE 0.0 END), 6) AS value
FROM ranked, (SELECT unnest([1, 2, 5]) AS k) ks WHERE y_true = 'Critico' AND c = y_true GROUP BY ks.k""")
def precision_at_k(spark, d):
    return plain(cm.precision_at_k(views.class_predictions(spark, d), views.CLASSES, ks=[1, 2, 5]))


COST = f"""WITH {CLASSES}, c AS (SELECT
  1000.0 * count(*) FILTER (y_true = 'Critico' AND y_pred <> 'Critico') AS fn,
  50.0 * count(*) FILTER (y_true <> 'Critico' AND y_pred = 'Critico') AS fp, count(*) AS n FROM preds) """


@query("op_cost", COST + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, round({e}, 6) AS value FROM c" for n, e in {
        "total_operational_cost": "fn + fp", "cost_per_prediction": "(fn + fp) / n", "total_fp_cost": "fp",
        "total_fn_cost": "fn"}.items()))
def op_cost(spark, d):
    return plain(cm.cost_metrics(views.class_predictions(spark, d)))


@query("biz_cost", COST + """, r AS (SELECT fp AS false_positive_cost, fn AS false_negative_cost, 150.0 AS monitoring_cost,
  fp + fn + 150.0 AS total_cost, 31500.0 AS total_annual_benefits, 23500.0 AS net_annual_benefit,
  round(45000.0 / 23500.0, 6) AS payback_period_years FROM c)
SELECT *, CASE WHEN false_negative_cost > 5 * false_positive_cost THEN 'raise recall on critical classes'
  ELSE 'balance precision and recall' END AS advice FROM r""")
def biz_cost(spark, d):
    out = report.business_report(views.class_predictions(spark, d))
    return plain(out.withColumn("advice", F.col("recommendations")[0]).drop("recommendations"))


@query("recommendations", COST + """
SELECT 0 AS position, CASE WHEN fn > 5 * fp THEN 'raise recall on critical classes'
  ELSE 'balance precision and recall' END AS recommendation FROM c
UNION ALL SELECT 1, 'roll out the RUL system' UNION ALL SELECT 2, 'validate on production data'""")
def recommendations(spark, d):
    return plain(report.recommendations(report.business_report(views.class_predictions(spark, d))))


RUN_SQL = f"""t AS (SELECT row_number() OVER ({BY_TIME}) AS i, y_true = 'Critico' AS t, y_pred = 'Critico' AS p FROM preds),
f AS (SELECT *, CASE WHEN t = lag(t) OVER (ORDER BY i) THEN 0 ELSE 1 END AS c FROM t),
r AS (SELECT *, sum(c) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f),
runs AS (SELECT min(i) AS first_index, count(*) AS run_rows, min(CASE WHEN p THEN i END) - min(i) AS delay
  FROM r WHERE t GROUP BY run)"""


@query("time_to_detection", f"WITH {CLASSES}, {RUN_SQL} " + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, round({e}, 6) AS value FROM runs" for n, e in {
        "avg_time_to_detection": "avg(delay)", "median_time_to_detection": "quantile_cont(CAST(delay AS DOUBLE), 0.5)",
        "detection_rate": "count(delay) / count(*)"}.items()))
def time_to_detection(spark, d):
    return plain(cm.time_to_detection(views.class_predictions(spark, d), ORDER))


@query("detection_runs", f"WITH {CLASSES}, {RUN_SQL} SELECT first_index, run_rows, delay FROM runs")
def detection_runs(spark, d):
    return cm.detection_runs(views.class_predictions(spark, d), ORDER).drop("run_id")


_E = "abs(y_true - y_pred)"
RUL_ROWS = {
    "MAE": f"avg({_E})", "RMSE": f"sqrt(avg({_E} * {_E}))",
    "R2": f"1 - sum({_E} * {_E}) / (var_pop(y_true) * count(*))",
    **{f"accuracy_band_{b}d": f"avg(CASE WHEN {_E} <= {b} THEN 1.0 ELSE 0.0 END)" for b in (1, 3, 7)},
    "prognostic_horizon": f"coalesce(avg(CASE WHEN {_E} <= 10 THEN 1.0 ELSE 0.0 END) FILTER (y_true > 10), 0)",
    "prognostic_horizon_samples": "count(*) FILTER (y_true > 10)",
    "alpha_accuracy": f"avg(CASE WHEN {_E} / greatest(y_true, 0.1) <= 0.5 THEN 1.0 ELSE 0.0 END)",
    "lambda_accuracy": f"avg(CASE WHEN {_E} <= 5 THEN 1.0 ELSE 0.0 END)",
    "alpha_parameter": "0.5", "lambda_parameter": "5.0"}


@query("rul_metrics", f"WITH {RULS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, fold, round({e}, 6) AS value FROM ruls GROUP BY fold" for n, e in RUL_ROWS.items()))
def rul_metrics(spark, d):
    return plain(rm.error_metrics(views.rul_predictions(spark, d), by=["fold"]))


@query("rul_band_mae", f"""WITH {RULS}
SELECT CASE WHEN y_true < 2 THEN 'MAE_0-2d' WHEN y_true < 5 THEN 'MAE_2-5d' WHEN y_true < 10 THEN 'MAE_5-10d'
  ELSE 'MAE_>10d' END AS metric, round(avg({_E}), 6) AS value FROM ruls GROUP BY 1""")
def rul_band_mae(spark, d):
    return plain(rm.band_mae(views.rul_predictions(spark, d)))


@query("error_histogram", f"""WITH {RULS}, e AS (SELECT y_pred - y_true AS e FROM ruls),
f AS (SELECT min(e) AS lo, max(e) AS hi, avg(e) AS m FROM e)
SELECT CAST(least(floor((e - lo) * 30 / (hi - lo)) + 1, 30) AS BIGINT) AS bin, count(*) AS n,
  round(lo + (least(floor((e - lo) * 30 / (hi - lo)) + 1, 30) - 1) * (hi - lo) / 30, 6) + 0.0 AS bin_start,
  round(any_value(m), 6) AS mean_error FROM e, f GROUP BY 1, 3""")
def error_histogram(spark, d):
    return plain(rm.error_histogram(views.rul_predictions(spark, d)))


@query("drift_js", f"""WITH {STATES}, w AS (
  SELECT week(timestamp) - (SELECT min(week(timestamp)) FROM states) + 1 AS semana, estado_agrupado AS c FROM states),
k AS (SELECT semana, c, count(*) AS n FROM w GROUP BY semana, c),
s AS (SELECT semana, c, n / sum(n) OVER (PARTITION BY semana) AS p FROM k),
g AS (SELECT semana, c FROM (SELECT DISTINCT semana FROM s WHERE semana <> 1), (SELECT DISTINCT c FROM s)),
j AS (SELECT g.semana, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM g
  LEFT JOIN s a ON a.semana = 1 AND a.c = g.c LEFT JOIN s b ON b.semana = g.semana AND b.c = g.c)
SELECT semana, round(1 - sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
  + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2)), 6) AS similarity FROM j GROUP BY semana""")
def drift_js(spark, d):
    r = report.relative_week(clean.group_states(views.readings(spark, d)), "timestamp", "semana")
    return plain(cm.distribution_drift(r, "semana", "estado_agrupado"))


@query("pred_summary", f"""WITH {CLASSES}
SELECT y_pred, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM preds), 2) AS pct FROM preds GROUP BY 1""")
def pred_summary(spark, d):
    return report.prediction_summary(views.class_predictions(spark, d), "y_pred")


@query("pred_examples", f"""WITH {CLASSES}
SELECT id, y_pred, 'first' AS "end" FROM (SELECT * FROM preds {BY_TIME} LIMIT 3)
UNION ALL SELECT id, y_pred, 'last' FROM (SELECT * FROM preds ORDER BY timestamp DESC, id DESC LIMIT 3)""")
def pred_examples(spark, d):
    p = views.class_predictions(spark, d).select("id", "timestamp", "y_pred")
    return report.prediction_examples(p, ORDER).select("id", "y_pred", "end")


_MODELS = "SELECT 'm' || (id % 3) AS model, y_true, y_pred FROM "
MODEL_METRICS = f"""WITH {CLASSES}, {RULS.split(", ruls AS", 1)[1].join(["ruls AS", ""])}, m AS ({_MODELS} preds),
counts AS (SELECT model, y_true, y_pred, count(*) AS n FROM m GROUP BY ALL),
labels AS (SELECT DISTINCT model, label FROM (SELECT model, y_true AS label FROM m UNION ALL SELECT model, y_pred FROM m)),
cls AS (SELECT labels.model, label, coalesce(sum(n) FILTER (y_true = label), 0) AS support,
  coalesce(sum(n) FILTER (y_pred = label), 0) AS predicted,
  coalesce(sum(n) FILTER (y_true = label AND y_pred = label), 0) AS hits
  FROM counts JOIN labels USING (model) GROUP BY ALL),
f1 AS (SELECT model, avg(2 * hits / (support + predicted)) AS v FROM cls GROUP BY model),
mae AS (SELECT model, avg(abs(y_true - y_pred)) AS v FROM ({_MODELS} ruls) GROUP BY model) """


def model_metrics(spark, d):
    name = F.concat(F.lit("m"), F.col("id") % 3)
    c = cm.basic_metrics(views.class_predictions(spark, d).withColumn("model", name), by=["model"])
    r = rm.error_metrics(views.rul_predictions(spark, d).withColumn("model", name), by=["model"])
    return c.withColumn("task", F.lit("classification")).unionByName(r.withColumn("task", F.lit("rul")))


@query("best_model", MODEL_METRICS + """
SELECT 'classification' AS task, model, round(v, 6) AS value FROM (SELECT * FROM f1 ORDER BY v DESC, model LIMIT 1)
UNION ALL SELECT 'rul', model, round(v, 6) FROM (SELECT * FROM mae ORDER BY v, model LIMIT 1)""")
def best_model(spark, d):
    return plain(report.best_models(model_metrics(spark, d)))


@query("model_comparison", MODEL_METRICS + """
SELECT model, round(v, 6) AS value, CASE WHEN v > 0.7 THEN 'good' WHEN v > 0.5 THEN 'fair' ELSE 'poor' END AS band,
  v >= 0.7 AS meets_target FROM f1""")
def model_comparison(spark, d):
    return plain(report.model_comparison(model_metrics(spark, d)))


@query("metrics_over_folds", f"""WITH {RULS}, f AS (SELECT fold, avg({_E}) AS mae, sqrt(avg({_E} * {_E})) AS rmse FROM ruls GROUP BY fold)
SELECT 'MAE' AS metric, round(avg(mae), 6) AS value FROM f UNION ALL SELECT 'RMSE', round(avg(rmse), 6) FROM f""")
def metrics_over_folds(spark, d):
    folds = rm.error_metrics(views.rul_predictions(spark, d), by=["fold"]).where(F.col("metric").isin("MAE", "RMSE"))
    return plain(report.mean_over_folds(folds, []))


@query("stratified_split", f"""WITH {STATES}, r AS (
  SELECT id, estado_agrupado, row_number() OVER (PARTITION BY estado_agrupado ORDER BY {hash_sql('id')}, id) AS k,
    count(*) OVER (PARTITION BY estado_agrupado) AS n FROM states)
SELECT id, estado_agrupado, CASE WHEN k <= floor(n * 0.3 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, d):
    r = clean.group_states(views.readings(spark, d))
    return split.stratified_split(r, "estado_agrupado", "id").select("id", "estado_agrupado", "split")


@query("undersample", f"""WITH {STATES}, r AS (
  SELECT id, estado_agrupado, row_number() OVER (PARTITION BY estado_agrupado ORDER BY {hash_sql('id')}, id) AS k FROM states)
SELECT id, estado_agrupado FROM r WHERE k <= 2500""")
def undersample(spark, d):
    r = clean.group_states(views.readings(spark, d))
    return split.cap_per_class(r, "estado_agrupado", "id", 2500).select("id", "estado_agrupado")


@query("capped_sample", f"""WITH {STATES}, r AS (
  SELECT id, estado_agrupado, row_number() OVER (PARTITION BY estado_agrupado ORDER BY {hash_sql('id')}, id) AS k FROM states)
SELECT id, estado_agrupado FROM r WHERE k <= 5000 // (SELECT count(DISTINCT estado_agrupado) FROM states)""")
def capped_sample(spark, d):
    r = clean.group_states(views.readings(spark, d))
    return split.cap_per_class(r, "estado_agrupado", "id", total=5000).select("id", "estado_agrupado")


@query("group_folds", f"""WITH RECURSIVE {STATES}, g AS (
  SELECT vehiculo_id AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, vehiculo_id) AS k FROM states GROUP BY 1),
place AS (SELECT k, v, 0 AS fold, n AS l0, CAST(0 AS BIGINT) AS l1 FROM g WHERE k = 1 UNION ALL
  SELECT g.k, g.v, CASE WHEN l0 <= l1 THEN 0 ELSE 1 END, CASE WHEN l0 <= l1 THEN l0 + g.n ELSE l0 END,
    CASE WHEN l0 <= l1 THEN l1 ELSE l1 + g.n END FROM place JOIN g ON g.k = place.k + 1)
SELECT id, vehiculo_id, CAST(fold AS BIGINT) AS fold FROM states JOIN place ON vehiculo_id = v""")
def group_folds(spark, d):
    return plain(split.group_folds(views.readings(spark, d), "vehiculo_id").select("id", "vehiculo_id", "fold"))


@query("stratified_group_folds", f"""WITH RECURSIVE {STATES}, c AS (
  SELECT vehiculo_id AS v, estado_agrupado AS c, count(*) AS m FROM states GROUP BY ALL),
t AS (SELECT c AS tc, sum(m) AS t FROM c WHERE c IS NOT NULL GROUP BY 1),
s AS (SELECT v, CAST(sum(m) AS BIGINT) AS n,
    coalesce('0' || first(c ORDER BY CAST(m AS DOUBLE) / t DESC, c) FILTER (c IS NOT NULL), '1') AS s
  FROM c LEFT JOIN t ON c = tc GROUP BY v),
g AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, v) AS k FROM s),
place AS (SELECT s, k, v, 0 AS fold, n AS l0, CAST(0 AS BIGINT) AS l1 FROM g WHERE k = 1 UNION ALL
  SELECT g.s, g.k, g.v, CASE WHEN l0 <= l1 THEN 0 ELSE 1 END, CASE WHEN l0 <= l1 THEN l0 + g.n ELSE l0 END,
    CASE WHEN l0 <= l1 THEN l1 ELSE l1 + g.n END FROM place JOIN g ON g.s = place.s AND g.k = place.k + 1)
SELECT id, vehiculo_id, estado_agrupado, CAST(fold AS BIGINT) AS fold FROM states JOIN place ON vehiculo_id = v""")
def stratified_group_folds(spark, d):
    r = clean.group_states(views.readings(spark, d))
    return plain(split.stratified_group_folds(r, "vehiculo_id", S.GROUPED_STATE).select(
        "id", "vehiculo_id", "estado_agrupado", "fold"))
