"""What is written is read back: manifests, checkpoints, splits, predictions, metrics, column roles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stationcare import roles
from stationcare import settings as S
from stationcare.operators import clean
from stationcare.operators.ordered import with_index
from stationcare.plans import models, split_job
from stationcare.session import shared_dir
from stationcare.sources import sinks, tables
from workload import evaluation, views  # noqa: F401
from workload.registry import CLASSES, ORACLES, READINGS, STATES, plain, query


def _folder(spark, name):
    return f"{shared_dir(spark)}/written/{name}-{uuid.uuid4().hex}"


@query("manifest_runs", f"""WITH {READINGS}, runs AS (
  SELECT CAST(timestamp AS DATE) AS day, count(*) AS n, max(sensor_1) AS top, min(rul_aceite) AS low FROM readings GROUP BY 1)
SELECT row_number() OVER (ORDER BY day) AS id, n AS total_muestras, round(top, 6) AS sensor_max, round(low, 6) AS rul_min,
  CASE WHEN day = (SELECT max(day) FROM runs) THEN true END AS es_enriquecido,
  CASE WHEN day = (SELECT max(day) FROM runs) THEN 0.25 END AS ruido FROM runs""")
def manifest_runs(spark, d):
    """A run per day with nested settings; then two columns more, and the last run enriched; then settings looked up."""
    r = views.readings(spark, d)
    days = r.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("sensor_1").alias("top"), F.min("rul_aceite").alias("low"))
    ids = with_index(days, ["day"], index="id")
    config = F.to_json(F.struct(F.struct(F.col("top").alias("max")).alias("sensor"),
                                F.struct(F.array(F.struct(F.col("low").alias("min"))).alias("aceite")).alias("rul")))
    runs = ids.select("id", F.col("day").cast("string").alias("fecha_generacion"), F.lit("1").alias("version"),
                      F.col("n").alias("total_muestras"), config.alias("configuracion_json"), F.lit("{}").alias("metricas_json"))
    path = _folder(spark, "manifest")
    sinks.publish_manifest(runs, path)
    changed = sinks.enriched_latest(sinks.read_manifest(spark, path), F.struct(F.struct(F.lit(0.25).alias("factor")).alias("ruido")))
    sinks.publish_manifest(changed, path)
    m = sinks.read_manifest(spark, path)
    return plain(m.select(
        "id", "total_muestras", sinks.nested_setting(F.col("configuracion_json"), "$.sensor.max", "double").alias("sensor_max"),
        sinks.nested_setting(F.col("configuracion_json"), "$.rul.aceite[0].min", "double").alias("rul_min"), "es_enriquecido",
        sinks.nested_setting(F.col("config_enriquecimiento_json"), "$.ruido.factor", "double").alias("ruido")))


@query("stage_checkpoints", f"""WITH {STATES}
SELECT 'built' AS step, count(*) AS n FROM states WHERE estado_agrupado IS NOT NULL
UNION ALL SELECT 'reused', count(*) FROM states WHERE estado_agrupado IS NOT NULL
UNION ALL SELECT 'forced', count(*) FROM states WHERE estado_agrupado = 'Critico'
UNION ALL SELECT 'built again', count(*) FROM states WHERE estado_agrupado = 'Normal'""")
def stage_checkpoints(spark, d):
    """A stage is built once, reused, forced, cleared and built again."""
    r = clean.group_states(views.readings(spark, d))
    store = sinks.Checkpoints(spark, _folder(spark, "checkpoints"), "s1")
    state = F.col(S.GROUPED_STATE)
    steps = []
    for step, force, build in (("built", None, lambda: clean.drop_missing_target(r, S.GROUPED_STATE)),
                               ("reused", "rul", lambda: r.limit(0)), ("forced", "features", lambda: r.where(state == "Critico"))):
        steps.append((step, store.stage("features", build, force).count()))
    store.clear("features")
    steps.append(("built again", store.stage("features", lambda: r.where(state == "Normal")).count()))
    return spark.createDataFrame(steps, "step string, n long")


@query("split_tables", f"SELECT split, count(*) AS n FROM ({ORACLES['stratified_split']}) GROUP BY split")
def split_tables(spark, d):
    """Rows of the two sides of a split, read back from the folders they were written to."""
    kept, _ = split_job.split_readings(views.readings(spark, d), path=_folder(spark, "split"))
    return kept.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("csv_and_parquet", f"""WITH {READINGS}, x AS (SELECT count(*) AS n, sum(sensor_2) AS total, count(DISTINCT vehiculo_id) AS machines,
  CAST(max(epoch_us(timestamp)) AS BIGINT) AS last_us FROM readings)
SELECT kind, n * times AS n, round(total * times, 6) AS total, machines, last_us
FROM x, (VALUES ('csv', 1), ('parquet', 2), ('scores', 1)) AS k(kind, times)""")
def csv_and_parquet(spark, d):
    """The same readings through CSV with a header, an export with an appended batch, and the scores of a session."""
    r = views.readings(spark, d).select("id", "timestamp", "vehiculo_id", "sensor_2")
    root = _folder(spark, "tables")
    r.write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(f"{root}/readings.csv")
    sinks.export_parquet(r, f"{root}/readings.parquet")
    sinks.append_rows(r, f"{root}/readings.parquet")
    sinks.write_scores(r, f"{root}/scores", "s1")
    out = None
    for kind, df in (("csv", tables.read_table(spark, f"{root}/readings.csv", schema=r.schema)),
                     ("parquet", tables.read_table(spark, f"{root}/readings.parquet")),
                     ("scores", tables.read_table(spark, f"{root}/scores/session=s1", fmt="parquet"))):
        tables.require_columns(df, r.columns)
        facts = df.agg(F.count(F.lit(1)).alias("n"), F.sum("sensor_2").alias("total"), F.count_distinct("vehiculo_id").alias("machines"),
                       F.max(F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("last_us")).withColumn("kind", F.lit(kind))
        out = facts if out is None else out.unionByName(facts)
    return plain(out)


@query("stored_predictions", f"""WITH {CLASSES}
SELECT fold, y_pred, count(*) AS n, count_if(y_true = y_pred) AS hits FROM preds GROUP BY ALL""")
def stored_predictions(spark, d):
    """Predictions of a session, saved by task and model beside those of another session, and loaded."""
    p, path = views.class_predictions(spark, d), _folder(spark, "predictions")
    sinks.save_predictions(p, path, "classification", "m", "s1")
    sinks.save_predictions(p.limit(0), path, "classification", "m", "s2")
    back = sinks.load_predictions(spark, path, "classification", "m", "s1")
    return plain(back.groupBy("fold", "y_pred").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("hits")))


@query("metric_store", f"""WITH {CLASSES}, f AS (SELECT fold, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0 END) AS a, count(*) AS n
  FROM preds GROUP BY fold), s AS (SELECT unnest(['s1', 's2', 's10']) AS session)
SELECT session, round(avg(a), 6) AS accuracy, round(avg(n), 6) AS rows, ['s2', 's10', 's1'] AS sessions, 's2' AS latest
FROM f, s GROUP BY session""")
def metric_store(spark, d):
    """Metrics of three sessions, appended line by line, seen as one row per session; sessions, newest name first."""
    p, path = views.class_predictions(spark, d), _folder(spark, "metrics")
    facts = p.groupBy("fold").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
                                  F.count(F.lit(1)).cast("double").alias("rows"))
    lines = facts.unpivot(["fold"], ["accuracy", "rows"], "metric", "value")
    for session in ("s1", "s2", "s10"):
        sinks.append_rows(sinks.metrics_table(lines, session, "classification", model="m"), path)
    stored = spark.read.schema(sinks.METRICS).parquet(path)
    wide = sinks.metrics_view(stored, ["accuracy", "rows"]).drop("component", "model")
    return plain(wide.join(sinks.sessions(stored), "task").drop("task"))


@query("column_roles", """WITH r AS (SELECT CAST(ts AS VARCHAR) AS cuando, event_type AS situacion, value AS presion_1, user_id FROM events)
SELECT CASE WHEN count(cuando) > 0 AND count(try_cast(cuando AS TIMESTAMP)) = count(cuando) THEN 'cuando' END AS timestamp,
  CASE WHEN count(DISTINCT situacion) BETWEEN 2 AND 50 THEN 'situacion' END AS target, 'presion_1' AS sensors,
  'id,presion_1,vehiculo_id' AS numeric, count(*) AS rows FROM r""")
def column_roles(spark, d):
    """Roles of columns whose names say nothing, told by what is in them."""
    r = views.readings(spark, d)
    own = r.select("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("cuando"), F.col("estado_sistema").alias("situacion"),
                   F.col("sensor_1").alias("presion_1"), "vehiculo_id")
    when = roles.detect_timestamp(own)
    target = roles.detect_target(own, when)
    numeric = sorted(roles.feature_columns(own, [when, target]))
    return own.agg(F.lit(when).alias("timestamp"), F.lit(target).alias("target"), F.lit(",".join(roles.detect_sensors(own))).alias("sensors"),
                   F.lit(",".join(numeric)).alias("numeric"), F.count(F.lit(1)).alias("rows"))


@query("leak_free_inputs", f"""WITH {STATES}
SELECT count(*) AS rows, count(estado_agrupado) AS known, 'horas,sensor_1,sensor_2,sensor_3,tipo_vehiculo' AS inputs,
  'rul_aceite,rul_frenos,rul_refrigerante' AS dropped, count(DISTINCT timestamp) AS times FROM states""")
def leak_free_inputs(spark, d):
    """Inputs, target and times of a classifier, without columns that tell the future or name the row."""
    r = clean.group_states(views.readings(spark, d))
    kept, dropped, _ = clean.drop_leaky_names(r)
    x, y, times = clean.split_inputs(kept, S.GROUPED_STATE)
    names = clean.rul_inputs(clean.classifier_inputs(x.columns))
    both = kept.select(S.GROUPED_STATE, "timestamp", *names)
    assert y.columns == [S.GROUPED_STATE] and times.columns == ["timestamp"]
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count(S.GROUPED_STATE).alias("known"), F.lit(",".join(sorted(names))).alias("inputs"),
                    F.lit(",".join(sorted(dropped))).alias("dropped"), F.count_distinct("timestamp").alias("times"))


@query("label_codes", f"""WITH {STATES}
SELECT estado_agrupado, CAST(dense_rank() OVER (ORDER BY estado_agrupado) - 1 AS DOUBLE) AS code, n, true AS back
FROM (SELECT estado_agrupado, count(*) AS n FROM states WHERE estado_agrupado IS NOT NULL GROUP BY 1)""")
def label_codes(spark, d):
    """Classes as places in the sorted list of classes, and back."""
    r = clean.drop_missing_target(clean.group_states(views.readings(spark, d)), S.GROUPED_STATE)
    code = models.encoded(F.col(S.GROUPED_STATE), views.CLASSES)
    back = models.decoded(code, views.CLASSES) == F.col(S.GROUPED_STATE)
    return plain(r.groupBy(S.GROUPED_STATE).agg(F.min(code).alias("code"), F.count(F.lit(1)).alias("n"), F.bool_and(back).alias("back")))


@query("numeric_targets", """SELECT column_name, bool_and(try_cast(value AS DOUBLE) IS NOT NULL) AS numeric FROM (
  SELECT unnest(['digits', 'event_type']) AS column_name, unnest([regexp_extract(props, '[0-9]+'), event_type]) AS value FROM events)
WHERE value IS NOT NULL GROUP BY 1""")
def numeric_targets(spark, d):
    """Whether all known values of a text column read as numbers."""
    e = views.load(spark, d, "events").select(F.regexp_extract("props", "[0-9]+", 0).alias("digits"), "event_type")
    return spark.createDataFrame([(c, tables.numeric_text(e, c)) for c in e.columns], "column_name string, numeric boolean")


@query("floored_lives", f"WITH {READINGS} SELECT id, round(greatest(0, rul_aceite - 10), 6) AS life FROM readings")
def floored_lives(spark, d):
    r = views.readings(spark, d)
    return plain(r.select("id", clean.floor_zero(F.col("rul_aceite") - 10).alias("life")))
