"""Scans, filters, profiles and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.functions import clock, physics, rows, states
from stationcare.operators import clean, profile, select, skew, split
from stationcare.plans import report
from stationcare.session import shared_dir
from stationcare.sources import tables
from workload import views
from workload.registry import GROUPED, READINGS, RULS, STATES, hash_sql, plain, query

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SENSORS = ["sensor_1", "sensor_2", "sensor_3"]


@query("load_profile", "UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, count({c}) AS known FROM lineitem "
    for c, k in [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
                 ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
                 ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "categorical"),
                 ("l_linestatus", "categorical"), ("l_shipdate", "datetime")]))
def load_profile(spark, d):
    df = views.load(spark, d, "lineitem")
    missing = profile.missing_report(df)
    rows_ = df.count()
    return plain(profile.schema_report(df).join(missing, "column").select(
        "column", "kind", (F.lit(rows_) - F.col("missing")).alias("known")))


@query("sensor_projection", f"""WITH {READINGS}
SELECT CAST(floor(epoch_us(timestamp) / 1000000) AS BIGINT) AS timestamp_unix, sensor_1, sensor_2, sensor_3
FROM readings ORDER BY 1""")
def sensor_projection(spark, d):
    r = views.readings(spark, d).withColumn("timestamp_unix", F.unix_timestamp("timestamp"))
    return tables.sensor_data(r, SENSORS).drop("timestamp")


@query("state_rul_filter", f"""WITH {READINGS}
SELECT id, estado_sistema, rul_aceite FROM readings
WHERE estado_sistema = 'Fuga_Menor' AND rul_aceite BETWEEN 2 AND 8""")
def state_rul_filter(spark, d):
    return tables.state_data(views.readings(spark, d), "Fuga_Menor", (2.0, 8.0),
                             order_by=("timestamp", "id"), rul_column="rul_aceite").select(
        "id", "estado_sistema", "rul_aceite")


@query("state_value_scan", """
SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' AND value BETWEEN 20 AND 80""")
def state_value_scan(spark, d):
    """The same filters on raw columns, so that they reach the Parquet scan."""
    where = tables.in_state("purchase", (20.0, 80.0), state_column="event_type", rul_column="value")
    return views.load(spark, d, "events", where).select("event_id", "event_type", "value")


@query("class_share_top", """
WITH c AS (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS k
  FROM events WHERE event_type IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS t FROM c)
SELECT CASE WHEN k <= 2 THEN event_type ELSE '(rest)' END AS event_type, CAST(sum(n) AS BIGINT) AS n,
  round(100.0 * sum(n) / any_value(t), 6) AS share_pct FROM c, t GROUP BY 1""")
def class_share_top(spark, d):
    return plain(profile.class_share(views.load(spark, d, "events"), "event_type", top=2))


@query("date_range", f"""WITH {READINGS}
SELECT id, vehiculo_id, sensor_1 FROM readings
WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 00:00:00'""")
def date_range(spark, d):
    return tables.date_range(views.readings(spark, d), "2024-01-10 00:00:00", "2024-01-20 00:00:00").select(
        "id", "vehiculo_id", "sensor_1")


@query("table_info", f"""WITH {READINGS}
SELECT estado_sistema, count(*) AS state_rows, (SELECT count(*) FROM readings) AS total_rows,
  (SELECT epoch_us(min(timestamp)) FROM readings) AS first_us,
  (SELECT epoch_us(max(timestamp)) FROM readings) AS last_us
FROM readings GROUP BY estado_sistema""")
def table_info(spark, d):
    return tables.table_info(views.readings(spark, d))


@query("ad_hoc_sql", f"""WITH {READINGS}
SELECT vehiculo_id, count(*) AS n, round(avg(sensor_1), 6) AS mean_1 FROM readings
WHERE sensor_2 > 50 GROUP BY vehiculo_id""")
def ad_hoc_sql(spark, d):
    return plain(tables.run_query(
        views.readings(spark, d), "SELECT vehiculo_id, count(*) AS n, avg(sensor_1) AS mean_1 "
        "FROM datos_estacion WHERE sensor_2 > :low GROUP BY vehiculo_id", {"low": 50.0}))


@query("group_states", f"""WITH {STATES}
SELECT estado_sistema, estado_agrupado, count(*) AS n FROM states GROUP BY ALL""")
def group_states(spark, d):
    return clean.group_states(views.readings(spark, d)).groupBy("estado_sistema", "estado_agrupado").agg(
        F.count(F.lit(1)).alias("n"))


@query("parse_timestamps", """
SELECT event_id AS id, epoch_us(CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE ts END) AS us
FROM events WHERE event_id % 50 <> 7""")
def parse_timestamps(spark, d):
    e = views.load(spark, d, "events")
    text = (F.when(F.col("event_id") % 50 == 7, "junk")
            .when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    parsed = clean.parse_timestamps(e.select(F.col("event_id").alias("id"), text.alias("timestamp")))
    return parsed.select("id", F.unix_micros("timestamp").alias("us"))


@query("id_sample", f"""WITH {READINGS}, ids AS (SELECT DISTINCT vehiculo_id AS v FROM readings),
ranked AS (SELECT v, row_number() OVER (ORDER BY {hash_sql('v')}, v) AS r FROM ids)
SELECT id, vehiculo_id FROM readings WHERE vehiculo_id IN (
  SELECT v FROM ranked WHERE r <= greatest(1, CAST(floor((SELECT count(*) FROM ids) * 0.2) AS BIGINT)))""")
def id_sample(spark, d):
    return clean.sample_machines(views.readings(spark, d), share=0.2).select("id", "vehiculo_id")


@query("valid_rul_ceiling", f"""WITH {READINGS}
SELECT id, least(rul_aceite, 15) AS rul_aceite FROM readings WHERE rul_aceite > 0""")
def valid_rul_ceiling(spark, d):
    return clean.valid_rul(views.readings(spark, d), "rul_aceite").select("id", "rul_aceite")


@query("align_columns", f"""WITH {READINGS}
SELECT sensor_3, sensor_1, CAST(NULL AS DOUBLE) AS no_such_column, id FROM readings""")
def align_columns(spark, d):
    return clean.align_columns(views.readings(spark, d), ["sensor_3", "sensor_1", "no_such_column", "id"])


@query("downcast_types", f"""WITH {READINGS}
SELECT sum(vehiculo_id) AS v, sum(CAST(sensor_2 AS BIGINT)) AS s2, count(*) AS n FROM readings""")
def downcast_types(spark, d):
    small = clean.downcast(views.readings(spark, d).select("id", "vehiculo_id", "sensor_2"))
    return small.agg(F.sum("vehiculo_id").alias("v"), F.sum(F.col("sensor_2").cast("long")).alias("s2"),
                     F.count(F.lit(1)).alias("n"))


@query("class_share", f"""WITH {STATES}
SELECT estado_agrupado, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM states), 6) AS share_pct
FROM states GROUP BY estado_agrupado""")
def class_share(spark, d):
    return plain(profile.class_share(clean.group_states(views.readings(spark, d)), "estado_agrupado"))


@query("describe_sensors", "UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c}) AS min_value, max({c}) AS max_value, "
    f"round(avg({c}), 6) AS mean_value, round(stddev_samp({c}), 6) AS std_value FROM lineitem "
    for c in LINE))
def describe_sensors(spark, d):
    return plain(profile.describe(views.load(spark, d, "lineitem"), LINE))


@query("missing_report", f"""WITH {READINGS}, m AS (
  SELECT id, CASE WHEN id % 11 <> 0 THEN sensor_1 END AS sensor_1,
    CASE WHEN id % 40 <> 0 THEN sensor_2 END AS sensor_2 FROM readings),
c AS (SELECT 'id' AS "column", count(*) - count(id) AS missing FROM m
  UNION ALL SELECT 'sensor_1', count(*) - count(sensor_1) FROM m
  UNION ALL SELECT 'sensor_2', count(*) - count(sensor_2) FROM m)
SELECT "column", missing, round(100.0 * missing / (SELECT count(*) FROM m), 2) AS missing_pct,
  round(100.0 * missing / (SELECT count(*) FROM m), 2) > 5 AS flagged FROM c""")
def missing_report(spark, d):
    r = views.readings(spark, d)
    return profile.missing_report(r.select(
        "id", F.when(F.col("id") % 11 != 0, F.col("sensor_1")).alias("sensor_1"),
        F.when(F.col("id") % 40 != 0, F.col("sensor_2")).alias("sensor_2")))


@query("duplicate_rows", """
SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates""")
def duplicate_rows(spark, d):
    return profile.duplicate_rows(views.load(spark, d, "lineitem"))


@query("duplicate_projections", """
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (
  SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_shipdate)""")
def duplicate_projections(spark, d):
    return profile.duplicate_rows(views.load(spark, d, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate"))


@query("iqr_report", f"WITH {READINGS} " + "UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers,
  round(100.0 * count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) / count(*), 6) AS outlier_pct,
  count(DISTINCT x) AS distinct_values,
  100.0 * count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) / count(*) < 5
    AND count(DISTINCT x) > 10 AS ok
FROM (SELECT {c} AS x FROM readings), (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3
  FROM readings) """ for c in SENSORS))
def iqr_report(spark, d):
    return plain(profile.iqr_report(views.readings(spark, d), SENSORS))


@query("outlier_flags", f"""WITH {READINGS}, q AS (
  SELECT quantile_cont(sensor_1, 0.25) AS q1, quantile_cont(sensor_1, 0.75) AS q3 FROM readings)
SELECT id, CAST(coalesce(sensor_1 < q1 - 1.5 * (q3 - q1) OR sensor_1 > q3 + 1.5 * (q3 - q1), false) AS BIGINT)
  AS sensor_1_is_outlier FROM readings, q""")
def outlier_flags(spark, d):
    from stationcare.plans.features import outlier_flag
    r = views.readings(spark, d)
    b = profile.iqr_bounds(r, ["sensor_1"]).first()
    return plain(r.select("id", outlier_flag(F.col("sensor_1"), b["low"], b["high"]).alias("sensor_1_is_outlier")))


@query("hourly_target", f"""WITH {STATES}
SELECT CAST(hour(timestamp) AS BIGINT) AS hora, estado_agrupado, count(*) AS n FROM states GROUP BY ALL""")
def hourly_target(spark, d):
    return plain(profile.hourly_target(clean.group_states(views.readings(spark, d)), "timestamp", "estado_agrupado"))


def _corr(a: str, b: str, where: str = "lineitem") -> str:
    return (f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, "
            f"round(abs(corr({a}, {b})), 6) AS abs_r FROM {where} ")


_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1:]]


@query("corr_pairs", "UNION ALL ".join(_corr(a, b) for a, b in _PAIRS))
def corr_pairs(spark, d):
    return plain(profile.top_correlations(views.load(spark, d, "lineitem"), LINE))


_TWINS = "(SELECT sensor_1, sensor_2, sensor_1 * 2 + sensor_2 / 100 AS twin, sensor_3 FROM readings)"


@query("corr_drop", f"""WITH {READINGS}, t AS {_TWINS}
SELECT 'twin' AS feature FROM (SELECT corr(sensor_1, twin) AS r, corr(sensor_2, twin) AS q FROM t)
WHERE abs(r) > 0.95 OR abs(q) > 0.95""")
def corr_drop(spark, d):
    r = views.readings(spark, d).withColumn("twin", F.col("sensor_1") * 2 + F.col("sensor_2") / 100)
    return select.correlated_columns(r, ["sensor_1", "sensor_2", "twin", "sensor_3"], 0.95)


@query("corr_matrix_wide", f"WITH {READINGS}, w AS (SELECT " + ", ".join(
    f"sensor_{1 + i % 3} * {i + 1} + (id % {i + 2}) AS c{i:02d}" for i in range(14)) + " FROM readings) "
    + "UNION ALL ".join(f"SELECT 'c{i:02d}' AS a, 'c{j:02d}' AS b, round(corr(c{i:02d}, c{j:02d}), 6) AS r FROM w "
                        for i in range(14) for j in range(i + 1, 14)))
def corr_matrix_wide(spark, d):
    r = views.readings(spark, d)
    wide = r.select(*[(F.col(f"sensor_{1 + i % 3}") * (i + 1) + F.col("id") % (i + 2)).alias(f"c{i:02d}")
                      for i in range(14)])
    return plain(profile.correlations(wide, wide.columns).select("a", "b", "r"))


@query("variance_filter", f"WITH {READINGS} " + "UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_pop({e}), 6) AS variance, var_pop({e}) > 0 AS kept FROM readings "
    for c, e in [("sensor_1", "sensor_1"), ("sensor_2", "sensor_2"), ("flat", "CAST(1 AS DOUBLE)")]))
def variance_filter(spark, d):
    r = views.readings(spark, d).withColumn("flat", F.lit(1.0))
    return plain(select.keep_varying(r, ["sensor_1", "sensor_2", "flat"]))


def _anova(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round(((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1))
  / (sum(n * v) / (sum(n) - count(*))), 6) AS f_score FROM (
  SELECT CAST(count({c}) AS DOUBLE) AS n, avg({c}) AS m, var_pop({c}) AS v FROM states GROUP BY estado_agrupado) """


@query("anova_f", f"WITH {STATES} " + "UNION ALL ".join(_anova(c) for c in SENSORS))
def anova_f(spark, d):
    return plain(select.anova_f(clean.group_states(views.readings(spark, d)), SENSORS, "estado_agrupado"))


@query("regression_f", f"WITH {READINGS} " + "UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(r * r / (1 - r * r) * (n - 2), 6) AS f_score FROM "
    f"(SELECT corr({c}, rul_refrigerante) AS r, count(*) AS n FROM readings) " for c in SENSORS))
def regression_f(spark, d):
    return plain(select.regression_f(views.readings(spark, d), SENSORS, "rul_refrigerante"))


@query("median_impute", f"""WITH {READINGS}, m AS (
  SELECT id, CASE WHEN id % 11 <> 0 THEN sensor_1 END AS sensor_1 FROM readings)
SELECT id, coalesce(sensor_1, (SELECT quantile_cont(sensor_1, 0.5) FROM m)) AS sensor_1 FROM m""")
def median_impute(spark, d):
    r = views.readings(spark, d).select("id", F.when(F.col("id") % 11 != 0, F.col("sensor_1")).alias("sensor_1"))
    return select.fill_medians(r, select.medians(r, ["sensor_1"]))


@query("feature_selection", f"""WITH {STATES}, f AS ({"UNION ALL ".join(_anova(c) for c in
    ["sensor_1", "sensor_2", "sensor_3", "horas", "rul_frenos"])})
SELECT feature, f_score FROM f ORDER BY f_score DESC, feature LIMIT 3""")
def feature_selection(spark, d):
    r = clean.group_states(views.readings(spark, d)).withColumn("flat", F.lit(2.0))
    fitted = select.fit_selection(r, ["sensor_1", "sensor_2", "sensor_3", "horas", "rul_frenos", "flat"],
                                  "estado_agrupado", k=3)
    scores = select.anova_f(fitted.transform(r), fitted.columns, "estado_agrupado")
    return plain(scores)


@query("stats_join_back", """
SELECT o_orderkey, n, round(spend, 2) AS spend FROM orders LEFT JOIN (
  SELECT o_custkey AS k, count(*) AS n, sum(o_totalprice) AS spend FROM orders GROUP BY 1) ON o_custkey = k""")
def stats_join_back(spark, d):
    o = views.load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    both = skew.with_group_stats(o, ["o_custkey"], {"n": F.count(F.lit(1)), "spend": F.sum("o_totalprice")})
    return plain(both.select("o_orderkey", "n", "spend"), 2)


@query("rows_with_ids", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def rows_with_ids(spark, d):
    urgent = views.load(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(
        F.col("o_orderkey").alias("l_orderkey"))
    return plain(clean.rows_with_ids(views.load(spark, d, "lineitem"), urgent, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_quantity"))


@query("union_folds", f"""WITH {RULS}
SELECT fold, count(*) AS n, round(avg(y_true), 6) AS mean_true FROM (
  SELECT * FROM ruls WHERE fold = 0 UNION ALL SELECT * FROM ruls WHERE fold = 1) GROUP BY fold""")
def union_folds(spark, d):
    p = views.rul_predictions(spark, d)
    both = skew.stacked({"first": p.where("fold = 0"), "second": p.where("fold = 1")}, "part")
    return plain(both.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y_true").alias("mean_true")))


@query("leak_check", f"""WITH {RULS}
SELECT vehiculo_id, min(fold) AS first_fold, max(fold) AS last_fold FROM ruls
GROUP BY vehiculo_id HAVING count(DISTINCT fold) > 1""")
def leak_check(spark, d):
    return plain(split.leaking_groups(views.rul_predictions(spark, d), "vehiculo_id"))


@query("shared_groups", f"""WITH {RULS}
SELECT vehiculo_id FROM ruls WHERE fold = 0 INTERSECT SELECT vehiculo_id FROM ruls WHERE fold = 1""")
def shared_groups(spark, d):
    p = views.rul_predictions(spark, d)
    return split.shared_groups(p.where("fold = 0"), p.where("fold = 1"), "vehiculo_id")


@query("downsample", f"""WITH {READINGS}, s AS (
  SELECT id, sensor_1, {hash_sql('id')} AS h FROM readings ORDER BY h, id LIMIT 5000)
SELECT id, sensor_1 FROM s""")
def downsample(spark, d):
    return clean.sample_rows(views.readings(spark, d), "id", 5000, order_by=["timestamp", "id"]).select("id", "sensor_1")


@query("time_features", f"""WITH {READINGS}, f AS (
  SELECT id, timestamp, hour(timestamp) AS h, isodow(timestamp) - 1 AS w FROM readings)
SELECT id, h AS hora_dia, w AS dia_semana, month(timestamp) AS mes, CAST(w >= 5 AS BIGINT) AS es_fin_semana,
  CAST(h >= 22 OR h <= 6 AS BIGINT) AS es_horario_nocturno,
  week(timestamp) - (SELECT min(week(timestamp)) FROM readings) + 1 AS semana_operacion,
  round(sin(2 * pi() * h / 24), 6) + 0.0 AS hora_sin, round(cos(2 * pi() * h / 24), 6) + 0.0 AS hora_cos,
  round(sin(2 * pi() * w / 7), 6) + 0.0 AS dia_sin, round(cos(2 * pi() * w / 7), 6) + 0.0 AS dia_cos,
  CAST(h BETWEEN 8 AND 17 AS BIGINT) AS es_horario_laboral, minute(timestamp) AS minuto_hora,
  second(timestamp) AS segundo_minuto, dayname(timestamp) AS nombre_dia
FROM f""")
def time_features(spark, d):
    r = views.readings(spark, d)
    ts = F.col("timestamp")
    week = r.agg(F.min(F.weekofyear(ts))).scalar()
    cols = clock.calendar_features(ts, week) | clock.basic_calendar_features(ts, week)
    cols["nombre_dia"] = clock.day_name(ts)
    return plain(r.select("id", *[c.alias(n) for n, c in cols.items()]))


@query("shift_calendar", f"""WITH {READINGS}, f AS (
  SELECT id, timestamp, hour(timestamp) AS h, isodow(timestamp) - 1 AS w FROM readings), p AS (
  SELECT *, CASE WHEN w = 6 THEN false WHEN h >= 6 AND h < 22 THEN true WHEN w = 5 THEN false
    ELSE w % 2 = 0 END AS productivo FROM f)
SELECT id, productivo, CAST(CASE WHEN productivo THEN h % 3 + 1 ELSE 0 END AS BIGINT) AS bloque_productivo,
  CAST(floor(epoch_us(timestamp) / 1000000) AS BIGINT) AS timestamp_unix,
  CAST((day(timestamp) - 1) // 7 + 1 AS BIGINT) AS semana_del_mes FROM p""")
def shift_calendar(spark, d):
    ts = F.col("timestamp")
    return plain(views.readings(spark, d).select(
        "id", clock.productive_shift(ts).alias("productivo"), clock.production_block(ts).alias("bloque_productivo"),
        F.unix_timestamp(ts).alias("timestamp_unix"), clock.week_of_month(ts).alias("semana_del_mes")))


_N = "(sensor_1 + sensor_2 + sensor_3) / 3"
_M2 = f"((sensor_1 - {_N}) ** 2 + (sensor_2 - {_N}) ** 2 + (sensor_3 - {_N}) ** 2) / 3"
_M3 = f"((sensor_1 - {_N}) ** 3 + (sensor_2 - {_N}) ** 3 + (sensor_3 - {_N}) ** 3) / 3"
ROW_STATS = f"""round({_N}, 6) AS sensor_mean, round(sqrt({_M2}), 6) AS sensor_std,
  greatest(sensor_1, sensor_2, sensor_3) AS sensor_max, least(sensor_1, sensor_2, sensor_3) AS sensor_min,
  round(greatest(sensor_1, sensor_2, sensor_3) - least(sensor_1, sensor_2, sensor_3), 6) AS sensor_range,
  list_sort([sensor_1, sensor_2, sensor_3])[2] AS sensor_median,
  round(CASE WHEN sensor_1 = sensor_2 AND sensor_2 = sensor_3 THEN 0
    ELSE sqrt(6.0) * {_M3} / (({_M2}) ** 1.5) END, 6) + 0.0 AS sensor_skew"""
RATIOS = """sensor_1 / (sensor_2 + 1e-8) AS r01, sensor_1 / (sensor_3 + 1e-8) AS r02,
  sensor_2 / (sensor_3 + 1e-8) AS r12"""


@query("sensor_row_stats", f"WITH {READINGS} SELECT id, {ROW_STATS} FROM readings")
def sensor_row_stats(spark, d):
    stats = rows.sensor_features([F.col(c) for c in SENSORS])
    return plain(views.readings(spark, d).select(
        "id", *[c.alias(n) for n, c in stats.items() if "ratio" not in n]))


@query("sensor_ratios", f"""WITH {READINGS}, r AS (SELECT id, {RATIOS} FROM readings),
b AS (SELECT avg(sensor_1) AS base FROM readings)
SELECT r.id, round(r01, 2) AS sensor_ratio_01, round(r02, 2) AS sensor_ratio_02, round(r12, 2) AS sensor_ratio_12,
  round(sensor_1 / base, 6) AS deg_ratio,
  round(horas / CASE WHEN sensor_3 = 0 THEN 1 ELSE sensor_3 END, 6) AS ratio_utilizacion
FROM r JOIN readings USING (id), b""")
def sensor_ratios(spark, d):
    r = views.readings(spark, d)
    base = r.agg(F.avg("sensor_1")).scalar()
    found = rows.ratios([F.col(c) for c in SENSORS])
    small = plain(r.select("id", *[c.alias(n) for n, c in found.items()]), 2)
    rest = plain(r.select("id", F.try_divide(F.col("sensor_1"), base).alias("deg_ratio"),
                          (F.col("horas") / rows.one_for_zero(F.col("sensor_3"))).alias("ratio_utilizacion")))
    return small.join(rest, "id")


@query("processing_report", f"""WITH {READINGS}, r AS (SELECT {RATIOS} FROM readings),
x AS (SELECT 'rows' AS kind, '' AS name, count(*) AS value FROM readings UNION ALL SELECT 'columns', '', 16
  UNION ALL SELECT 'columns_added', '', 4 UNION ALL SELECT 'timed and sized', '', 3
  UNION ALL SELECT 'nulls', 'sensor_ratio_01', count_if(r01 IS NULL) FROM r
  UNION ALL SELECT 'nulls', 'sensor_ratio_02', count_if(r02 IS NULL) FROM r
  UNION ALL SELECT 'nulls', 'sensor_ratio_12', count_if(r12 IS NULL) FROM r
  UNION ALL SELECT 'nulls', 'horas_por_sensor', count_if(sensor_3 = 0) FROM readings)
SELECT kind, name, CAST(value AS DOUBLE) AS value FROM x""")
def processing_report(spark, d):
    """What the write of a table with four new columns says of itself, read back from the run manifest."""
    r = views.readings(spark, d)
    after = r.withColumns(rows.ratios([F.col(c) for c in SENSORS]) | {"horas_por_sensor": F.try_divide("horas", "sensor_3")})
    root = f"{shared_dir(spark)}/reports/{uuid.uuid4().hex}"
    report.write_reported(r, after, f"{root}/table", f"{root}/manifest")
    lines = spark.read.parquet(f"{root}/manifest")
    measured = F.col("kind").isin("seconds", "bytes", "rows_per_second")
    counted = lines.where(~measured).select("kind", "name", "value")
    return counted.unionByName(lines.where(measured & (F.col("value") > 0)).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("timed and sized").alias("kind"), F.lit("").alias("name"), "value"))


_TEMP = "(15 + sensor_1 % 20)"
_HEALTH = "(0.3 + (id % 71) / 100)"


@query("expected_rul", f"""WITH {READINGS}, x AS (
  SELECT id, (id % 1900) * CAST(1 AS DOUBLE) AS h, CAST(15 + sensor_1 % 20 AS DOUBLE) AS t,
    CASE WHEN id % 3 = 0 THEN CAST(0.2 AS DOUBLE) ELSE 1.0 END AS load, CAST({_HEALTH} AS DOUBLE) AS health FROM readings),
y AS (""" + " UNION ALL ".join(
    f"""SELECT id, '{c}' AS component, h, h / {life} AS used, greatest(0, {life} * health /
      ({sens} * (CAST(0.35 AS DOUBLE) * greatest(0.4, least(2.5, (t - 15) / 15)) + CAST(0.35 AS DOUBLE) * 1.0
       + CAST(0.3 AS DOUBLE) * greatest(0.7, least(1.6, load)))) - CAST(1.1 AS DOUBLE) * h) / 24 AS days FROM x"""
    for c, (life, sens) in S.COMPONENT_LIFE.items()) + """)
SELECT id, component, round(greatest(0.5, least(25, days *
  CASE WHEN used > 0.7 THEN greatest(0.1, 1 - 2 * (used - 0.7)) ELSE 1 END)), 6) AS expected_days FROM y""")
def expected_rul(spark, d):
    r = views.readings(spark, d).select(
        "id", (F.col("id") % 1900).cast("double").alias("h"), (F.lit(15) + F.col("sensor_1") % 20).alias("t"),
        F.when(F.col("id") % 3 == 0, 0.2).otherwise(1.0).alias("load"),
        (F.lit(0.3) + (F.col("id") % 71) / 100).alias("health"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), physics.expected_rul(
        F.col("h"), F.col("t"), F.col("load"), F.col("health"), c).alias("expected_days"))
        for c in S.COMPONENT_LIFE]))
    return plain(r.select("id", each.alias("_e")).select("id", "_e.*"))


@query("expected_sensor", f"""WITH {READINGS}, x AS (
  SELECT id, sensor_1, CAST(id % 1900 AS DOUBLE) AS t, CAST({_HEALTH} AS DOUBLE) AS health,
    22 + 8 * sin(2 * pi() * (hour(timestamp) / 24 - 0.25)) AS temp FROM readings), y AS (
  SELECT *, (temp - 22) / 18 AS f FROM x)
SELECT id, round(temp, 6) AS ambient, round(greatest(0.1, 2.75 + 2.75 * (0.002 * t / 100 + 0.001 * sin(t / 24))
  + 0.2 * 2.75 * (1 - greatest(0.2, health)) + 2.75 * (0.04 * f + 0.01 * f * f)), 6) AS expected FROM y""")
def expected_sensor(spark, d):
    r = views.readings(spark, d)
    ambient = physics.expected_ambient(F.hour("timestamp"))
    health = F.lit(0.3) + (F.col("id") % 71) / 100
    return plain(r.select("id", ambient.alias("ambient"), physics.expected_sensor(
        S.SENSOR_BASE["aceite"], (F.col("id") % 1900).cast("double"), health, ambient).alias("expected")))


@query("rule_state", f"""WITH {READINGS}, x AS (
  SELECT id, least(rul_aceite, rul_frenos, rul_refrigerante) AS m, (0.3 + (id % 71) / 100) AS health,
    CASE WHEN rul_aceite <= rul_frenos AND rul_aceite <= rul_refrigerante THEN 'Bomba_Aceite'
      WHEN rul_frenos <= rul_refrigerante THEN 'Filtro_Frenos' ELSE 'Valvula_Refrigerante' END AS c FROM readings)
SELECT id, CASE WHEN id % 17 = 0 THEN 'INACTIVO' WHEN m <= 1 THEN 'Fallo_Inminente_' || c
  WHEN m <= 3 THEN 'RUL_Critico' WHEN m <= 7 THEN 'Degradacion_Avanzada' WHEN m <= 12 THEN 'Degradacion_Moderada'
  WHEN health < 0.5 THEN 'Degradacion_Severa' WHEN health < 0.7 THEN 'Degradacion_Gradual'
  ELSE 'Normal_Operacion' END AS estado FROM x""")
def rule_state(spark, d):
    r = views.readings(spark, d)
    ruls = {"bomba_aceite": F.col("rul_aceite"), "filtro_frenos": F.col("rul_frenos"),
            "valvula_refrigerante": F.col("rul_refrigerante")}
    return r.select("id", physics.rule_state(ruls, [F.lit(0.3) + (F.col("id") % 71) / 100],
                                             F.col("id") % 17 != 0).alias("estado"))


@query("volume_deviation", """
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity * 100 - 4500) / 4500, 6) AS deviation FROM lineitem""")
def volume_deviation(spark, d):
    li = views.load(spark, d, "lineitem")
    return plain(li.select("l_orderkey", "l_linenumber", "l_partkey", physics.volume_deviation(
        F.col("l_quantity") * 100, F.lit(S.VOLUME_TARGETS["aceite"])).alias("deviation")))


@query("rul_extremes", f"""WITH {READINGS}
SELECT min(least(rul_aceite, rul_frenos, rul_refrigerante)) AS rul_min,
  max(greatest(rul_aceite, rul_frenos, rul_refrigerante)) AS rul_max FROM readings""")
def rul_extremes(spark, d):
    return report.rul_extremes(views.readings(spark, d), ["rul_aceite", "rul_frenos", "rul_refrigerante"])


@query("rul_alert_mask", f"""WITH {READINGS}
SELECT CASE WHEN rul_aceite < 5 THEN 'critical' WHEN rul_aceite < 10 THEN 'warning' ELSE 'ok' END AS alert,
  count(*) AS n FROM readings GROUP BY 1""")
def rul_alert_mask(spark, d):
    return views.readings(spark, d).groupBy(states.rul_alert(F.col("rul_aceite")).alias("alert")).agg(
        F.count(F.lit(1)).alias("n"))


@query("weekly_trend", f"""WITH {STATES}, w AS (
  SELECT week(timestamp) - (SELECT min(week(timestamp)) FROM readings) + 1 AS semana_relativa,
    100.0 * avg(CASE WHEN estado_agrupado = 'Normal' THEN 1.0 ELSE 0.0 END) AS normal_pct FROM states GROUP BY 1)
SELECT semana_relativa, round(normal_pct, 6) AS normal_pct,
  round((SELECT regr_slope(normal_pct, semana_relativa) FROM w), 6) AS slope,
  round((SELECT regr_intercept(normal_pct, semana_relativa) FROM w), 6) AS intercept FROM w""")
def weekly_trend(spark, d):
    r = report.relative_week(clean.group_states(views.readings(spark, d)), "timestamp")
    return plain(report.weekly_normal(r, "semana_relativa", "estado_agrupado"))


@query("state_hour_xtab", f"""WITH {READINGS}, top AS (
  SELECT estado_sistema FROM readings GROUP BY 1 ORDER BY count(*) DESC, estado_sistema LIMIT 3), c AS (
  SELECT CAST(hour(timestamp) AS BIGINT) AS hora, estado_sistema, count(*) AS n FROM readings
  WHERE estado_sistema IN (SELECT * FROM top) GROUP BY ALL)
SELECT estado_sistema, hora, n, round(100.0 * n / sum(n) OVER (PARTITION BY hora), 6) AS share_pct FROM c""")
def state_hour_xtab(spark, d):
    return plain(report.state_by_hour(views.readings(spark, d), "timestamp", "estado_sistema", top=3))


@query("box_stats", f"""WITH {READINGS}, f AS (
  SELECT regexp_matches(estado_sistema, 'Fuga|Obstruccion|Sobrepresion|Degradacion') AS es_critico,
    sensor_1 AS x FROM readings), q AS (
  SELECT es_critico, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
  FROM f GROUP BY 1)
SELECT es_critico, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) AS n
FROM f JOIN q USING (es_critico) GROUP BY es_critico, q1, median, q3""")
def box_stats(spark, d):
    return plain(report.box_stats(views.readings(spark, d), "sensor_1", "estado_sistema"))


@query("rul_weekly", f"""WITH {READINGS}, w AS (
  SELECT week(timestamp) - (SELECT min(week(timestamp)) FROM readings) + 1 AS semana_relativa, rul_frenos FROM readings)
SELECT semana_relativa, count(*) AS n, round(quantile_cont(rul_frenos, 0.25), 6) AS q1,
  round(quantile_cont(rul_frenos, 0.5), 6) AS median, round(quantile_cont(rul_frenos, 0.75), 6) AS q3 FROM w GROUP BY 1""")
def rul_weekly(spark, d):
    r = report.relative_week(views.readings(spark, d), "timestamp")
    return plain(report.rul_by_week(r, "semana_relativa", "rul_frenos"))


@query("relative_week", f"""WITH {READINGS}
SELECT id, week(timestamp) - (SELECT min(week(timestamp)) FROM readings) + 1 AS semana_relativa FROM readings""")
def relative_week(spark, d):
    return plain(report.relative_week(views.readings(spark, d), "timestamp").select("id", "semana_relativa"))


@query("label_union", """
SELECT DISTINCT label FROM (SELECT o_orderstatus AS label FROM orders UNION ALL SELECT o_orderpriority FROM orders)
WHERE label IS NOT NULL""")
def label_union(spark, d):
    return split.label_union(views.load(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
