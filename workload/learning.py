"""Balancing, training, scoring. Models are trained with the defaults of settings.py."""

from __future__ import annotations

from functools import partial
from threading import Event

from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.functions.rows import sensor_features
from stationcare.functions.clock import calendar_features
from stationcare.operators import balance as B
from stationcare.operators import clean
from stationcare.operators.ordered import with_index
from stationcare.operators.select import Selection
from stationcare.plans import attribution, boosting, maintenance, models, report, scoring, train
from stationcare.session import shared_dir
from stationcare.sources.sinks import path_exists
from workload import views
from workload.registry import STATES, hash_sql, plain, query

SENSORS = ["sensor_1", "sensor_2", "sensor_3"]
RULS = ["rul_aceite", "rul_frenos", "rul_refrigerante"]


def table(spark, d):
    """Readings with states and the row-wise features."""
    r = clean.group_states(views.readings(spark, d))
    first = r.agg(F.min(F.weekofyear("timestamp"))).first()[0]
    return r.withColumns(sensor_features([F.col(c) for c in SENSORS])
                         | calendar_features(F.col("timestamp"), F.lit(first)))


def inputs(df):
    return [c for c, t in df.dtypes if t in ("double", "int", "bigint") and c not in RULS + ["horas"]]


NEAR = f"""p AS (SELECT estado_agrupado AS c, id, sensor_1 AS x1, sensor_2 AS x2, sensor_3 AS x3,
    row_number() OVER (PARTITION BY estado_agrupado ORDER BY id) AS pos,
    count(*) OVER (PARTITION BY estado_agrupado) AS n FROM states),
k AS (SELECT p.c, p.pos, q.pos AS nb, row_number() OVER (PARTITION BY p.c, p.pos ORDER BY
    (p.x1 - q.x1) * (p.x1 - q.x1) + (p.x2 - q.x2) * (p.x2 - q.x2) + (p.x3 - q.x3) * (p.x3 - q.x3), q.pos) AS rank
  FROM p JOIN p q ON p.c = q.c AND p.pos <> q.pos WHERE p.n < (SELECT max(n) FROM p)
  QUALIFY row_number() OVER (PARTITION BY p.c, p.pos ORDER BY
    (p.x1 - q.x1) * (p.x1 - q.x1) + (p.x2 - q.x2) * (p.x2 - q.x2) + (p.x3 - q.x3) * (p.x3 - q.x3), q.pos) <= 5)"""


@query("smote_neighbours", f"""WITH {STATES}, {NEAR}
SELECT c AS estado_agrupado, pos AS position, rank, nb AS neighbour FROM k""")
def smote_neighbours(spark, d):
    r = clean.group_states(views.readings(spark, d))
    sizes = r.groupBy(F.col("estado_agrupado").alias("c")).agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.agg(F.max("size")).first()[0]
    small = sizes.where(F.col("size") < largest)
    rows = with_index(r.join(F.broadcast(small), F.col("estado_agrupado") == F.col("c")), ["id"],
                      by=["estado_agrupado"], index="position").withColumn("x", F.array(*SENSORS))
    return plain(B.neighbours(rows, "estado_agrupado", "id").drop("squared_distance"))


@query("smote", f"""WITH {STATES}, {NEAR}, m AS (SELECT max(n) AS top FROM p),
lack AS (SELECT p.*, top - n AS lack FROM p, m WHERE n < top),
copies AS (SELECT *, unnest(range(1, CAST(lack // n + CASE WHEN pos <= lack % n THEN 1 ELSE 0 END AS BIGINT) + 1)) AS copy
  FROM lack),
drawn AS (SELECT *, {hash_sql("c", "id", "copy")} % 5 + 1 AS rank,
  CAST({hash_sql("c", "id", "copy", "'gap'")} AS DOUBLE) / 1152921504606846976.0 AS u FROM copies)
SELECT drawn.c AS estado_agrupado, round(drawn.x1 + u * (q.x1 - drawn.x1), 4) AS sensor_1,
  round(drawn.x2 + u * (q.x2 - drawn.x2), 4) AS sensor_2, round(drawn.x3 + u * (q.x3 - drawn.x3), 4) AS sensor_3,
  true AS synthetic
FROM drawn JOIN k ON k.c = drawn.c AND k.pos = drawn.pos AND k.rank = drawn.rank JOIN p q ON q.c = k.c AND q.pos = k.nb
UNION ALL SELECT estado_agrupado, round(sensor_1, 4), round(sensor_2, 4), round(sensor_3, 4), false FROM states""")
def smote(spark, d):
    r = clean.group_states(views.readings(spark, d))
    return plain(B.smote(r, "estado_agrupado", "id", SENSORS), 4)


@query("balanced_classes", f"""WITH {STATES}, n AS (SELECT estado_agrupado AS c, least(count(*), 3000) AS n FROM states GROUP BY 1)
SELECT c AS estado_agrupado, (SELECT max(n) FROM n) AS rows, n AS original FROM n""")
def balanced_classes(spark, d):
    r = clean.group_states(views.readings(spark, d))
    return plain(B.balance(r, "estado_agrupado", "id", SENSORS, cap=3000).groupBy("estado_agrupado").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("synthetic")).alias("original")))


@query("linear_rul_weights", """WITH r AS (
  SELECT CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS x, (event_id % 251) / 10 AS y FROM events)
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM r""")
def linear_rul_weights(spark, d):
    r = views.readings(spark, d).withColumn(models.LABEL, F.col("rul_refrigerante"))
    fitted = models.pipeline(models.linear("linear_regression"), ["sensor_2"], scale=True).fit(r)
    scaler, line = fitted.stages[1], fitted.stages[2]
    slope = float(line.coefficients[0]) / float(scaler.std[0])
    # one row of weights, learnt from every reading
    return plain(r.agg(F.lit(slope).alias("slope"),
                       F.lit(float(line.intercept) - slope * float(scaler.mean[0])).alias("intercept")))


def _kept_back():
    """One reading in five is never seen in training."""
    return F.col("id") % 5 == 0


@query("linear_holdout", """WITH r AS (
  SELECT event_id AS id, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS x, (event_id % 251) / 10 AS y FROM events),
w AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM r WHERE id % 5 <> 0)
SELECT count(*) AS n, round(avg(abs(a * x + b - y)), 6) AS mae, round(avg(a * x + b), 6) AS mean_prediction
FROM r, w WHERE id % 5 = 0""")
def linear_holdout(spark, d):
    """A model of one input, trained on four readings in five and judged on the others."""
    r = views.readings(spark, d).withColumn(models.LABEL, F.col("rul_refrigerante"))
    fitted = models.pipeline(models.linear("linear_regression"), ["sensor_2"], scale=True).fit(r.where(~_kept_back()))
    seen = fitted.transform(r.where(_kept_back()))
    return plain(seen.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("prediction") - F.col(models.LABEL))).alias("mae"),
                          F.avg("prediction").alias("mean_prediction")))


@query("tree_truth", """
SELECT event_id AS id, CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) >= 50 THEN 1 ELSE 0 END AS said
FROM events WHERE event_id % 5 = 0""")
def tree_truth(spark, d):
    """Where the class follows from one sensor, a decision tree must find it on readings it has not seen."""
    r = views.readings(spark, d).withColumn(models.LABEL, (F.col("sensor_2") >= 50).cast("double"))
    fitted = models.fit_model("decision_tree", "classification", r.where(~_kept_back()), ["sensor_1", "sensor_2"], classes=2)
    return plain(fitted.transform(r.where(_kept_back())).select("id", F.col("prediction").cast("long").alias("said")))


@query("train_classifiers")
def train_classifiers(spark, d):
    df = table(spark, d)
    out = train.train_classifiers(df, inputs(df), order_by=["timestamp", "id"])
    return out.summary()


@query("train_rul")
def train_rul(spark, d):
    df = table(spark, d)
    out = train.train_rul(df, inputs(df), "rul_aceite", "aceite", order_by=["timestamp", "id"], rul_targets=RULS)
    return out.summary()


def _best(*outcomes):
    metrics = outcomes[0].metrics
    for outcome in outcomes[1:]:
        metrics = metrics.unionByName(outcome.metrics)
    chosen = {r["task"]: r["model"] for r in report.best_models(metrics).collect()}
    kept = [next(t for t in o.models.values() if t.name == chosen[t.task]) for o in outcomes]
    return {t.component: t for t in kept}


def _store(df):
    """Root and session of the published models of a training table: named by what the table holds."""
    held = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{shared_dir(df.sparkSession)}/models", f"{held['n']}-{held['h']}"


def _publish(outcome, root, session):
    """All kinds of one component and their out-of-fold predictions; the metrics come last and say that all is there."""
    where = f"{root}/session={session}/task={_task(outcome)}/component={next(iter(outcome.models.values())).component}"
    train.side_by_side([partial(scoring.save_model, t, root, session) for t in outcome.models.values()]
                       + [partial(outcome.predictions.write.mode("overwrite").parquet, f"{where}/predictions")])
    outcome.metrics.write.mode("overwrite").parquet(f"{where}/metrics")


def _published(df, components):
    """Where the models of the components are; those that no query over this table has needed yet are trained."""
    spark, (root, session) = df.sparkSession, _store(df)
    where = {c: f"{root}/session={session}/task={'classification' if c == '-' else 'rul'}/component={c}" for c in components}
    missing = [c for c in components if not path_exists(spark, f"{where[c]}/metrics")]
    prepared, broken = Event(), []

    def states():
        try:
            return train.train_classifiers(df, inputs(df), prepared=prepared.set)
        except BaseException:
            broken.append("-")
            raise
        finally:
            prepared.set()

    def lives(c):
        # the classifier takes the longest chain of jobs: its first ones do not queue behind those of the lives
        if "-" in missing:
            prepared.wait()
        return None if broken else train.train_rul(df, inputs(df), f"rul_{c}", c, rul_targets=RULS)

    def publish(work):
        outcome = work()
        if not broken:
            _publish(outcome, root, session)

    # the classifier goes first: it is what the others wait for
    train.side_by_side([partial(publish, states if c == "-" else partial(lives, c)) for c in sorted(missing)])
    return root, session, where


def _trained(df, components):
    """The models a session would keep, by component (``-`` is the classifier): all kinds are trained, the best are
    read back from the model store in the shared folder."""
    spark, (root, session, where) = df.sparkSession, _published(df, components)

    def judged(c):
        metrics, task = spark.read.parquet(f"{where[c]}/metrics"), "classification" if c == "-" else "rul"
        names = [r[0] for r in metrics.select("model").distinct().collect()]
        return train.Outcome({n: train.Trained(n, task, c, None, None) for n in names}, None, metrics)

    outcomes = train.side_by_side([partial(judged, c) for c in components])
    by_task = [[o for o in outcomes if _task(o) == task] for task in ("classification", "rul")]
    best = {c: t for same in by_task if same for c, t in _best(*same).items()}
    loaded = train.side_by_side([partial(scoring.load_model, spark, root, session, t.task, c, t.name) for c, t in best.items()])
    return dict(zip(best, loaded, strict=True))


def _task(outcome):
    return next(iter(outcome.models.values())).task


EVERYTHING = ["aceite", "frenos", "refrigerante", "-"]


@query("scored_fleet")
def scored_fleet(spark, d):
    df = table(spark, d)
    models_ = _trained(df, EVERYTHING)
    plan = scoring.score_fleet(df, models_["-"], {c: models_[c] for c in EVERYTHING[:3]})
    return maintenance.latest_per_machine(plan.select(
        "id", "timestamp", "vehiculo_id", "predicted_estado", "predicted_rul_aceite", "predicted_rul_frenos",
        "predicted_rul_refrigerante", "prioridad", "accion_recomendada"), "vehiculo_id", ["timestamp", "id"]).drop("timestamp")


@query("holdout_metrics")
def holdout_metrics(spark, d):
    """Trained on four readings in five, judged on the others, which no model has seen."""
    df = table(spark, d)
    found = _trained(df.where(~_kept_back()), ["aceite", "-"])
    return scoring.holdout_metrics(df.where(_kept_back()), found["-"], {"aceite": found["aceite"]},
                                   rul_targets={"aceite": "rul_aceite"}, order_by=["timestamp", "id"])


@query("fleet_rules", f"""WITH {STATES}
SELECT vehiculo_id, arg_max(id, (timestamp, id)) AS id, true AS ruls_floored, true AS priority_follows, true AS action_follows
FROM states GROUP BY vehiculo_id""")
def fleet_rules(spark, d):
    """Priority and action of the scored fleet, recomputed from the predicted state and lives."""
    s = scored_fleet(spark, d)
    lives = [F.col(f"predicted_rul_{c}") for c in EVERYTHING[:3]]
    lowest = F.array_min(F.array(*lives))
    urgent = F.upper(F.element_at(F.array(*[F.lit(c) for c in EVERYTHING[:3]]), F.array_position(F.array(*lives), lowest).cast("int")))
    first = (F.col("predicted_estado") == "Critico") | (lowest < 3)
    priority = F.when(first, "ALTA").when((F.col("predicted_estado") == "Advertencia") | (lowest < 7), "MEDIA").otherwise("BAJA")
    action = F.when(first, F.concat(F.lit("INSPECCIONAR "), urgent, F.lit(" URGENTE"))).otherwise("Seguimiento estándar")
    return s.select("vehiculo_id", "id", (lowest >= 0).alias("ruls_floored"), (F.col("prioridad") == priority).alias("priority_follows"),
                    (F.col("accion_recomendada") == action).alias("action_follows"))


@query("fold_predictions", f"""WITH {STATES}, m AS (SELECT unnest(['boosted_trees', 'random_forest']) AS model)
SELECT model, id, estado_agrupado AS y_true, 1.0 AS total, true AS likeliest FROM states, m WHERE estado_agrupado IS NOT NULL""")
def fold_predictions(spark, d):
    """One out-of-fold prediction per reading and kind of classifier, of the likeliest class."""
    _, _, where = _published(table(spark, d), ["-"])
    p = spark.read.parquet(f"{where['-']}/predictions")
    own = F.get("proba", F.array_position(F.array(*[F.lit(c) for c in views.CLASSES]), F.col("y_pred")).cast("int") - 1)
    return plain(p.select("model", "id", "y_true", F.aggregate("proba", F.lit(0.0), lambda a, x: a + x).alias("total"),
                          (own == F.array_max("proba")).alias("likeliest")))


@query("fold_predictions_rul", f"""WITH {STATES}, m AS (SELECT unnest(['boosted_trees', 'linear_regression', 'random_forest']) AS model)
SELECT model, id, round(least(rul_aceite, {S.RUL_CEILING}), 6) AS y_true, true AS floored FROM states, m WHERE rul_aceite > 0""")
def fold_predictions_rul(spark, d):
    """One out-of-fold prediction per valid reading and kind of regressor, never below zero."""
    _, _, where = _published(table(spark, d), ["aceite"])
    p = spark.read.parquet(f"{where['aceite']}/predictions")
    return plain(p.select("model", "id", "y_true", (F.col("y_pred") >= 0).alias("floored")))


@query("importance_total", "SELECT 1.0 AS total, 0 AS negative FROM events LIMIT 1")
def importance_total(spark, d):
    """Importances of the classifier's inputs are shares."""
    return plain(feature_importances(spark, d).agg(F.sum("importance").alias("total"), F.count_if(F.col("importance") < 0)
                                                   .alias("negative")))


@query("feature_importances")
def feature_importances(spark, d):
    return train.importances(_trained(table(spark, d), ["-"])["-"])


@query("permutation_importance")
def permutation_importance(spark, d):
    df = table(spark, d)
    return train.permutation_importance(_trained(df, ["aceite"])["aceite"], df, "rul_aceite")


@query("linear_attribution")
def linear_attribution(spark, d):
    """Exact for linear models only, whose fit does not depend on the other kinds trained beside it."""
    df = table(spark, d)
    out = train.train_rul(df, inputs(df), "rul_aceite", "aceite", names=["linear_regression"], rul_targets=RULS)
    return train.linear_attribution(out.models["linear_regression"], df)


@query("attribution_adds_up", f"""WITH {STATES} SELECT id, 0.0 AS gap FROM states""")
def attribution_adds_up(spark, d):
    """Contributions of all inputs to the life a kept tree model predicts, less the prediction."""
    df = table(spark, d)
    root, session, _ = _published(df, ["aceite"])
    kept = scoring.load_model(spark, root, session, "rul", "aceite", "boosted_trees")
    phi = attribution.tree_attribution(kept, df)
    total = phi.select("id", sum((F.col(c) for c in phi.columns if c.startswith("phi_")), F.col("base")).alias("t"))
    said = kept.model.transform(kept.selection.transform(df)).select("id", "prediction")
    return plain(said.join(total, "id").select("id", (F.col("t") - F.col("prediction")).alias("gap")))


@query("stump_attribution", """WITH r AS (
  SELECT event_id AS id, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) >= 50 AS high, (event_id % 7) / 10
    + CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) >= 50 THEN 40 ELSE 0 END AS y FROM events)
SELECT id, round(avg(y) OVER (), 6) AS base, round(avg(y) OVER (PARTITION BY high) - avg(y) OVER (), 6) AS phi_sensor_2,
  0.0 AS phi_sensor_3 FROM r""")
def stump_attribution(spark, d):
    """One tree with one cut: a reading's side of the cut explains how far its mean is from the mean of all."""
    r = views.readings(spark, d).withColumn(models.LABEL, (F.col("id") % 7) / 10 + F.when(F.col("sensor_2") >= 50, 40).otherwise(0))
    stump = boosting.fit_boosted(r, ["sensor_2", "sensor_3"], models.LABEL, 0, rounds=1, depth=1, rate=1.0, penalty=0.0)
    kept = train.Trained("boosted_trees", "rul", "-", stump, Selection(["sensor_2", "sensor_3"], {}))
    return plain(attribution.tree_attribution(kept, r))


@query("robust_scaling", f"WITH {STATES}, q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.95) AS hi_{c}"
    for c in SENSORS) + " FROM states) SELECT id, " + ", ".join(
    f"round(({c} - m_{c}) / (hi_{c} - lo_{c}), 6) + 0.0 AS {c}_escalado" for c in SENSORS) + " FROM states, q")
def robust_scaling(spark, d):
    out = models.robust_scaled(views.readings(spark, d), SENSORS)
    return plain(out.select("id", *[f"{c}_escalado" for c in SENSORS]))


@query("quantile_binning", f"""WITH {STATES}, q AS (
  SELECT quantile_cont(sensor_1, [{", ".join(str(i / 10) for i in range(1, 10))}]) AS edges FROM states)
SELECT id, CAST(len(list_filter(edges, lambda e: e <= sensor_1)) AS BIGINT) AS sensor_1_bin FROM states, q""")
def quantile_binning(spark, d):
    return plain(models.quantile_bins(views.readings(spark, d), ["sensor_1"]).select("id", "sensor_1_bin"))
