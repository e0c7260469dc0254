"""Everything that needs row order: gaps, windows, runs, interpolation, engineered features."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.operators import clean, profile
from stationcare.operators import ordered as o
from stationcare.plans import features, maintenance
from workload import views
from workload.registry import FLEET, READINGS, RULS, STATES, nudged, plain, query
from workload.tabular import RATIOS, ROW_STATS, SENSORS

ORDER = ["timestamp", "id"]
BY_TIME = "ORDER BY timestamp, id"


def numbered(spark, d, *columns: str):
    r = views.readings(spark, d)
    rows = r.count()
    return o.with_index(r.select(*ORDER, *columns), ORDER, rows=rows), rows


def roll(column: str, width: int, low: int) -> str:
    frame = f"OVER ({BY_TIME} ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) {frame} >= {low} THEN avg({column}) {frame} END"


@query("row_position", f"""WITH {READINGS}
SELECT id, row_number() OVER ({BY_TIME}) AS row_index FROM readings""")
def row_position(spark, d):
    return numbered(spark, d)[0].select("id", "row_index")


@query("row_position_by_machine", f"""WITH {READINGS}
SELECT id, row_number() OVER (PARTITION BY vehiculo_id {BY_TIME}) AS row_index FROM readings""")
def row_position_by_machine(spark, d):
    return o.with_index(views.readings(spark, d), ORDER, by=["vehiculo_id"]).select("id", "row_index")


@query("time_diffs", f"""WITH {READINGS}
SELECT id, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER ({BY_TIME})) / 1e6 AS gap_seconds FROM readings""")
def time_diffs(spark, d):
    return profile.time_gaps(views.readings(spark, d), "timestamp", ORDER).select("id", "gap_seconds")


@query("time_profile", f"""WITH {READINGS}, g AS (
  SELECT (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER ({BY_TIME})) / 1e6 AS gap FROM readings),
m AS (SELECT gap AS mode FROM g WHERE gap IS NOT NULL GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1),
q AS (SELECT quantile_cont(gap, 0.5) AS median FROM g)
SELECT epoch_us(min(timestamp)) AS first_us, epoch_us(max(timestamp)) AS last_us,
  round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6, 6) AS span_seconds,
  round(any_value(median), 6) AS median_seconds, round(1 / any_value(median), 6) AS frequency_hz,
  round(any_value(mode), 6) AS mode_seconds,
  (SELECT count(*) FROM g, m WHERE gap > 2 * mode) AS large_gaps,
  (SELECT round(max(gap), 6) FROM g, m WHERE gap > 2 * mode) AS max_gap_seconds FROM readings, q, m""")
def time_profile(spark, d):
    return plain(profile.time_profile(views.readings(spark, d), "timestamp", ORDER))


WINDOWS = {1: (13, 3), 6: (83, 20), 24: (333, 100)}


@query("rolling_mean", f"WITH {READINGS} SELECT id, " + ", ".join(
    f"round({roll(c, w, low)} + 1e-9, 6) AS {c}_ma_{h}h" for c in SENSORS for h, (w, low) in WINDOWS.items())
    + " FROM readings")
def rolling_mean(spark, d):
    df, rows = numbered(spark, d, *SENSORS)
    specs = [o.Rolling(f"{c}_ma_{h}h", c, w, low) for c in SENSORS for h, (w, low) in WINDOWS.items()]
    out = o.rolling(df, specs, rows).drop("timestamp", "row_index", *SENSORS)
    return plain(nudged(out, [s.name for s in specs]))


@query("rolling_mean_by_machine", f"""WITH {READINGS}, w AS (
  SELECT id, CASE WHEN id % 11 <> 0 THEN sensor_1 END AS x, vehiculo_id, timestamp FROM readings)
SELECT id, CASE WHEN count(x) OVER f >= 3 THEN round(avg(x) OVER f + 1e-9, 6) END AS mean_12 FROM w
WINDOW f AS (PARTITION BY vehiculo_id {BY_TIME} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def rolling_mean_by_machine(spark, d):
    r = views.readings(spark, d).select(*ORDER, "vehiculo_id",
                                        F.when(F.col("id") % 11 != 0, F.col("sensor_1")).alias("x"))
    rows = r.count()
    df = o.with_index(r, ORDER, by=["vehiculo_id"], rows=rows)
    out = o.rolling(df, [o.Rolling("mean_12", "x", 12, 3)], rows, by=["vehiculo_id"]).select("id", "mean_12")
    return plain(nudged(out, ["mean_12"]))


SPIKED = "CASE WHEN id % 700 = 3 THEN 1e15 WHEN id % 700 = 400 THEN CAST('Infinity' AS DOUBLE) ELSE sensor_1 END"


@query("rolling_after_spikes", f"""WITH {READINGS}, w AS (
  SELECT id, timestamp, CASE WHEN id % 700 <> 400 THEN {SPIKED} END AS x FROM readings), m AS (
  SELECT id, count(x) OVER f AS n, max(x) OVER f AS top, avg(x) OVER f AS mean, var_samp(x) OVER f AS spread FROM w
  WINDOW f AS ({BY_TIME} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))
SELECT id, CASE WHEN n >= 2 AND top < 1e9 THEN round(mean + 1e-9, 6) END AS mean_13,
  CASE WHEN n >= 2 AND top < 1e9 THEN round(spread + 1e-9, 6) END AS variance_13 FROM m""")
def rolling_after_spikes(spark, d):
    """Windows without a spike are as if no spike had ever been; an infinity is a missing value."""
    r = views.readings(spark, d).select(*ORDER, F.when(F.col("id") % 700 == 3, 1e15).when(
        F.col("id") % 700 == 400, float("inf")).otherwise(F.col("sensor_1")).alias("x"))
    rows = r.count()
    specs = [o.Rolling("mean_13", "x", 13, 2), o.Rolling("variance_13", "x", 13, 2, "variance")]
    blocks = o.rolling_blocks(o.with_index(r, ORDER, rows=rows), specs, rows)
    last = blocks.window.rowsBetween(-12, 0)
    quiet = blocks.with_columns({"_top": F.max(F.when(F.col("x") < float("inf"), F.col("x"))).over(last)})
    out = quiet.result().select("id", *[F.when(F.col("_top") < 1e9, F.col(s.name)).alias(s.name) for s in specs])
    return plain(nudged(out, [s.name for s in specs]))


@query("frozen_features", f"""WITH {READINGS}, w AS (
  SELECT id, row_number() OVER ({BY_TIME}) AS i, {roll("sensor_1", 13, 3)} AS a, {roll("sensor_1", 83, 20)} AS b
  FROM readings)
SELECT id, round(a + 1e-9, 6) AS sensor_1_ma_1h, round(b + 1e-9, 6) AS sensor_1_ma_6h FROM w
WHERE i > (SELECT count(*) // 2 + 83 FROM readings)""")
def frozen_features(spark, d):
    """The later half of the readings with the windows learnt from all of them."""
    r = views.readings(spark, d)
    rows = r.count()
    numbers = o.with_index(r.select(*ORDER), ORDER, rows=rows, index="_i")
    half = numbers.where(F.col("_i") > rows // 2).select("id", "_i")
    _, state = features.engineer(r, views.ROLES, "balanced", None, views.EVENTS_HZ)
    late, _ = features.engineer(r.join(half, "id"), views.ROLES, "balanced", state)
    out = late.where(F.col("_i") > rows // 2 + 83).select("id", "sensor_1_ma_1h", "sensor_1_ma_6h")
    return plain(nudged(out, ["sensor_1_ma_1h", "sensor_1_ma_6h"]))


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount",
              "l_tax"]


@query("rolling_mean_long", f"""WITH w AS (
  SELECT date_trunc('month', l_shipdate) AS m, avg(l_quantity) OVER (ORDER BY {", ".join(LINE_ORDER)}
    ROWS BETWEEN 71999 PRECEDING AND CURRENT ROW) AS ma FROM lineitem)
SELECT year(m) AS anio, month(m) AS mes, count(*) AS n, round(sum(ma), 3) AS total_ma FROM w GROUP BY m""")
def rolling_mean_long(spark, d):
    li = views.load(spark, d, "lineitem").select(*LINE_ORDER, "l_quantity")
    rows = li.count()
    df = o.rolling(o.with_index(li, LINE_ORDER, rows=rows), [o.Rolling("ma", "l_quantity", 72_000, 1)], rows)
    return plain(df.groupBy(F.year("l_shipdate").alias("anio"), F.month("l_shipdate").alias("mes")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ma").alias("total_ma")), 3)


@query("rolling_mean_position_join", f"""WITH {READINGS}
SELECT id, round({roll("sensor_1", 3777, 3777)}, 6) AS mean_3777 FROM readings""")
def rolling_mean_position_join(spark, d):
    """The path for windows too long for a halo."""
    df, rows = numbered(spark, d, "sensor_1")
    return plain(o.rolling(df, [o.Rolling("mean_3777", "sensor_1", 3777, 3777)], rows, halo_limit=1000).select(
        "id", "mean_3777"))


TREND = f"""trend AS (
  SELECT id, timestamp, x, coalesce(x - lag(x) OVER ({BY_TIME}), 0) AS velocity FROM (
    SELECT id, timestamp, {roll("sensor_1", 333, 100)} AS x FROM readings))"""


@query("trend_velocity", f"""WITH {READINGS}, {TREND}
SELECT id, round(velocity + 1e-9, 6) + 0.0 AS sensor_1_trend_velocity,
  round(coalesce(velocity - lag(velocity) OVER ({BY_TIME}), 0) + 1e-9, 6) + 0.0 AS sensor_1_trend_acceleration FROM trend""")
def trend_velocity(spark, d):
    df, rows = numbered(spark, d, "sensor_1")
    blocks = o.rolling_blocks(df, [o.Rolling("x", "sensor_1", 333, 100)], rows, extra=2)

    def step(c):
        return F.coalesce(F.col(c) - F.lag(c, 1).over(blocks.window), F.lit(0.0))

    blocks = blocks.with_columns({"sensor_1_trend_velocity": step("x")})
    blocks = blocks.with_columns({"sensor_1_trend_acceleration": step("sensor_1_trend_velocity")})
    names = ["sensor_1_trend_velocity", "sensor_1_trend_acceleration"]
    return plain(nudged(blocks.result().select("id", *names), names))


@query("rolling_variance", f"""WITH {READINGS}
SELECT id, round(coalesce(CASE WHEN count(sensor_1) OVER f >= 250 THEN var_samp(sensor_1) OVER f END, 0), 4)
  AS sensor_1_spectral_energy FROM readings
WINDOW f AS ({BY_TIME} ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)""")
def rolling_variance(spark, d):
    df, rows = numbered(spark, d, "sensor_1")
    out = o.rolling(df, [o.Rolling("v", "sensor_1", 500, 250, "variance")], rows)
    return plain(out.select("id", F.coalesce("v", F.lit(0.0)).alias("sensor_1_spectral_energy")), 4)


@query("elapsed_hours", f"""WITH {READINGS}
SELECT id, round((epoch_us(timestamp) - first_value(epoch_us(timestamp)) OVER ({BY_TIME})) / 3.6e9, 6)
  AS tiempo_operacion_horas FROM readings""")
def elapsed_hours(spark, d):
    r = views.readings(spark, d)
    start = r.agg(F.min_by(F.unix_micros("timestamp"), F.struct("timestamp", "id"))).first()[0]
    return plain(r.select("id", features.elapsed_hours(F.col("timestamp"), start).alias("tiempo_operacion_horas")))


@query("hours_diff", f"""WITH {READINGS}
SELECT id, round(coalesce(horas - lag(horas) OVER ({BY_TIME}), 0), 6) + 0.0 AS intensidad_operacional FROM readings""")
def hours_diff(spark, d):
    df, rows = numbered(spark, d, "horas")
    out = o.previous(df, {"_p": "horas"}, rows)
    return plain(out.select("id", F.coalesce(F.col("horas") - F.col("_p"), F.lit(0.0)).alias("intensidad_operacional")))


@query("baseline", f"""WITH {READINGS}, n AS (
  SELECT sensor_1, row_number() OVER ({BY_TIME}) AS i, count(*) OVER () AS n FROM readings)
SELECT round(avg(sensor_1), 6) AS baseline, count(*) AS used FROM n WHERE i <= least(333, n // 4)""")
def baseline(spark, d):
    df, rows = numbered(spark, d, "sensor_1")
    k = features.baseline_rows(views.EVENTS_HZ, rows)
    return plain(df.where(F.col("row_index") <= k).agg(
        F.avg("sensor_1").alias("baseline"), F.count(F.lit(1)).alias("used")))


CYCLES = f"""flags AS (
  SELECT id, timestamp, tipo_vehiculo, CASE WHEN tipo_vehiculo = lag(tipo_vehiculo) OVER ({BY_TIME}) THEN 0 ELSE 1 END
    AS cambio FROM readings), cyc AS (
  SELECT *, sum(cambio) OVER ({BY_TIME} ROWS UNBOUNDED PRECEDING) AS ciclo_id FROM flags), cstat AS (
  SELECT ciclo_id, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS dur, count(*) AS n
  FROM cyc GROUP BY ciclo_id), cpace AS (SELECT quantile_cont(dur, 0.1) AS pace FROM cstat), cycles AS (
  SELECT id, cambio AS cambio_vehiculo, CAST(ciclo_id AS BIGINT) AS ciclo_id, round(dur, 6) AS duracion_segundos,
    n AS num_muestras, round((row_number() OVER (PARTITION BY ciclo_id {BY_TIME}) - 1) / n, 6) AS posicion_en_ciclo,
    round(pace / CASE WHEN dur = 0 THEN 1 ELSE dur END, 6) AS eficiencia_relativa
  FROM cyc JOIN cstat USING (ciclo_id), cpace)"""


def engineered(spark, d, profile_="full", **kw):
    r = views.readings(spark, d)
    out, _ = features.engineer(r, views.ROLES, profile_, sampling_hz=views.EVENTS_HZ, **kw)
    return r, out


@query("cycle_stats", f"WITH {READINGS}, {CYCLES} SELECT * FROM cycles")
def cycle_stats(spark, d):
    roles = views.ROLES.with_(sensors=(), hours=None)
    r = views.readings(spark, d).select(*ORDER, "tipo_vehiculo")
    out, _ = features.engineer(r, roles, "complete", sampling_hz=views.EVENTS_HZ)
    return plain(out.select("id", "cambio_vehiculo", "ciclo_id", "duracion_segundos", "num_muestras",
                            "posicion_en_ciclo", "eficiencia_relativa"))


@query("engineered_features", f"WITH {READINGS}, {CYCLES}, ratios AS (SELECT id, {RATIOS} FROM readings), "
    + ", ".join(f"""b{c} AS (SELECT avg({c}) AS base{c} FROM (
  SELECT {c}, row_number() OVER ({BY_TIME}) AS i, count(*) OVER () AS n FROM readings) WHERE i <= least(333, n // 4)),
q{c} AS (SELECT quantile_cont({c}, 0.25) AS q1{c}, quantile_cont({c}, 0.75) AS q3{c} FROM readings)""" for c in SENSORS)
    + f""", base AS (SELECT id, timestamp, {ROW_STATS},
  {", ".join(f"{roll(c, w, low)} AS {c}_ma_{h}h" for c in SENSORS for h, (w, low) in WINDOWS.items())},
  {", ".join(f"CASE WHEN count({c}) OVER f >= 250 THEN var_samp({c}) OVER f ELSE 0 END AS {c}_energy" for c in SENSORS[:2])},
  {", ".join(f"{c} / base{c} AS {c}_ratio" for c in SENSORS)},
  {", ".join(f"CAST({c} < q1{c} - 1.5 * (q3{c} - q1{c}) OR {c} > q3{c} + 1.5 * (q3{c} - q1{c}) AS BIGINT) AS {c}_is_outlier"
             for c in SENSORS)},
  horas, horas - lag(horas) OVER ({BY_TIME}) AS dh,
  (epoch_us(timestamp) - first_value(epoch_us(timestamp)) OVER ({BY_TIME})) / 3.6e9 AS elapsed
  FROM readings, {", ".join(f"b{c}, q{c}" for c in SENSORS)}
  WINDOW f AS ({BY_TIME} ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)), vel AS (
  SELECT *, {", ".join(f"coalesce({c}_ma_24h - lag({c}_ma_24h) OVER ({BY_TIME}), 0) AS {c}_v" for c in SENSORS)} FROM base)
SELECT vel.id, hour(timestamp) AS hora_dia, month(timestamp) AS mes, isodow(timestamp) - 1 AS dia_semana,
  CAST(isodow(timestamp) >= 6 AS BIGINT) AS es_fin_semana,
  CAST(hour(timestamp) >= 22 OR hour(timestamp) <= 6 AS BIGINT) AS es_horario_nocturno,
  {", ".join(f"round({f}(2 * pi() * {part}), 6) + 0.0 AS {name}_{f}" for name, part in
             (("hora", "hour(timestamp) / 24"), ("dia", "(isodow(timestamp) - 1) / 7")) for f in ("sin", "cos"))},
  week(timestamp) - (SELECT min(week(timestamp)) FROM readings) + 1 AS semana_operacion,
  sensor_mean, sensor_std, sensor_max, sensor_min, sensor_range, sensor_median, sensor_skew,
  round(r01, 2) AS sensor_ratio_01, round(r02, 2) AS sensor_ratio_02, round(r12, 2) AS sensor_ratio_12,
  {", ".join(f"round({c}_ma_{h}h + 1e-9, 6) AS {c}_ma_{h}h" for c in SENSORS for h in WINDOWS)},
  {", ".join(f"round({c}_ratio, 6) AS {c}_deg_ratio_{h}h" for c in SENSORS for h in (1, 6))},
  {", ".join(f"round({c}_v + 1e-9, 6) + 0.0 AS {c}_trend_velocity" for c in SENSORS)},
  {", ".join(f"round(coalesce({c}_v - lag({c}_v) OVER ({BY_TIME}), 0) + 1e-9, 6) + 0.0 AS {c}_trend_acceleration" for c in SENSORS)},
  {", ".join(f"round({c}_energy, 4) AS {c}_spectral_energy" for c in SENSORS[:2])},
  {", ".join(f"{c}_is_outlier" for c in SENSORS)},
  round(elapsed, 6) AS tiempo_operacion_horas, round(horas / CASE WHEN elapsed = 0 THEN 1 ELSE elapsed END, 6)
    AS ratio_utilizacion, round(coalesce(dh, 0), 6) + 0.0 AS intensidad_operacional,
  cambio_vehiculo, ciclo_id, duracion_segundos, num_muestras, posicion_en_ciclo, eficiencia_relativa
FROM vel JOIN cycles USING (id) JOIN ratios USING (id)""")
def engineered_features(spark, d):
    before, out = engineered(spark, d)
    names = features.new_columns(before, out)
    out = nudged(out, [c for c in names if "_ma_" in c or "_trend_" in c])
    digits = {c: 2 if "sensor_ratio" in c else 4 if "spectral" in c else 6 for c in names}
    shaped = out.select("id", *[F.round(c, digits[c]).alias(c) if t == "double" else F.col(c)
                                for c, t in out.select(*names).dtypes])
    return plain(shaped)


@query("profile_windows", f"""WITH {READINGS}, m AS (
  SELECT id, {roll("sensor_1", 13, 3)} AS a, count(sensor_1) OVER l AS n, var_samp(sensor_1) OVER l AS b,
    count(sensor_1) OVER s AS k, var_samp(sensor_1) OVER s AS c1, var_samp(sensor_2) OVER s AS c2 FROM readings
  WINDOW l AS ({BY_TIME} ROWS BETWEEN 999 PRECEDING AND CURRENT ROW),
    s AS ({BY_TIME} ROWS BETWEEN 499 PRECEDING AND CURRENT ROW))
SELECT id, round(a + 1e-9, 6) AS optimized_ma_1h, round(CASE WHEN n >= 500 THEN b ELSE 0 END, 4) AS balanced_energy,
  round(CASE WHEN k >= 250 THEN c1 ELSE 0 END, 4) AS complete_energy_1,
  round(CASE WHEN k >= 250 THEN c2 ELSE 0 END, 4) AS complete_energy_2 FROM m""")
def profile_windows(spark, d):
    """Windows of the smaller feature sets, row by row; their sizes hold from 10,000 readings on."""
    _, o1 = engineered(spark, d, "optimized")
    _, o2 = engineered(spark, d, "balanced")
    _, o3 = engineered(spark, d, "complete")
    out = (nudged(o1.select("id", F.col("sensor_1_ma_1h").alias("optimized_ma_1h")), ["optimized_ma_1h"])
           .join(o2.select("id", F.round("sensor_1_spectral_energy", 4).alias("balanced_energy")), "id")
           .join(o3.select("id", F.round("sensor_1_spectral_energy", 4).alias("complete_energy_1"),
                           F.round("sensor_2_spectral_energy", 4).alias("complete_energy_2")), "id"))
    return plain(out)


@query("engineered_profiles", f"""WITH {READINGS}, s AS (
  SELECT count(*) AS n, avg(sqrt(((sensor_1 - m) ** 2 + (sensor_2 - m) ** 2 + (sensor_3 - m) ** 2) / 3)) AS mean_std
  FROM (SELECT *, (sensor_1 + sensor_2 + sensor_3) / 3 AS m FROM readings))
SELECT profile, new_columns, n, round(mean_std, 6) AS mean_std FROM s, (
  VALUES ('balanced', 38), ('optimized', 18), ('complete', 43)) AS p(profile, new_columns)""")
def engineered_profiles(spark, d):
    """The smaller feature sets side by side: rows and summed features of each."""
    out = None
    for name in ("balanced", "optimized", "complete"):
        before, rich = engineered(spark, d, name)
        new = features.new_columns(before, rich)
        total = rich.agg(F.count(F.lit(1)).alias("n"), F.avg("sensor_std").alias("mean_std")).select(
            F.lit(name).alias("profile"), F.lit(len(new)).alias("new_columns"), "n", "mean_std")
        out = total if out is None else out.unionByName(total)
    return plain(out)


@query("interpolate", f"""WITH {READINGS}, g AS (
  SELECT id, CASE WHEN sensor_1 <= 60 AND id % 1000 >= 300 THEN sensor_1 END AS x,
    row_number() OVER ({BY_TIME}) AS i FROM readings), p AS (
  SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS i0,
    last_value(x IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS x0,
    first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1,
    first_value(x IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1 FROM g)
SELECT id, round(coalesce(x, x0 + (x1 - x0) * (i - i0) / (i1 - i0), x0, x1), 6) AS sensor_1 FROM p""")
def interpolate(spark, d):
    r = views.readings(spark, d).select(*ORDER, F.when(
        (F.col("sensor_1") <= 60) & (F.col("id") % 1000 >= 300), F.col("sensor_1")).alias("sensor_1"))
    rows = r.count()
    return plain(o.interpolate(o.with_index(r, ORDER, rows=rows), ["sensor_1"], rows).select("id", "sensor_1"))


@query("cleaned_sensors", f"""WITH {READINGS}, q AS (
  SELECT quantile_cont(sensor_1, 0.25) AS q1, quantile_cont(sensor_1, 0.75) AS q3 FROM readings), g AS (
  SELECT id, CASE WHEN sensor_1 BETWEEN q1 - 2.5 * (q3 - q1) AND q3 + 2.5 * (q3 - q1) THEN sensor_1 END AS x,
    row_number() OVER ({BY_TIME}) AS i FROM readings, q), p AS (
  SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS i0,
    last_value(x IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS x0,
    first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1,
    first_value(x IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1 FROM g)
SELECT id, round(coalesce(x, x0 + (x1 - x0) * (i - i0) / (i1 - i0), x0, x1), 6) AS sensor_1_limpio FROM p""")
def cleaned_sensors(spark, d):
    df, rows = numbered(spark, d, "sensor_1")
    b = profile.iqr_bounds(df, ["sensor_1"], rows=rows).first()
    fences = {"sensor_1": [b["low"], b["high"], b["far_low"], b["far_high"]]}
    return plain(features.cleaned_sensors(df, ["sensor_1"], fences, rows).select("id", "sensor_1_limpio"))


@query("centered_ma", f"""WITH {READINGS}, w AS (
  SELECT id, count(sensor_1) OVER f AS c, avg(sensor_1) OVER f AS m FROM readings
  WINDOW f AS ({BY_TIME} ROWS BETWEEN 50 PRECEDING AND 49 FOLLOWING))
SELECT id, CASE WHEN c = 100 THEN round(m + 1e-9, 6) END AS media_movil FROM w""")
def centered_ma(spark, d):
    df, rows = numbered(spark, d, "sensor_1")
    out = o.centred_mean(df, "media_movil", "sensor_1", 100, rows).select("id", "media_movil")
    return plain(nudged(out, ["media_movil"]))


@query("directional_accuracy", f"""WITH {RULS}, d AS (
  SELECT y_true - lag(y_true) OVER w < 0 AS a, y_pred - lag(y_pred) OVER w < 0 AS b, row_number() OVER w AS i
  FROM ruls WINDOW w AS ({BY_TIME}))
SELECT 'directional_accuracy' AS metric, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS value FROM d WHERE i > 1""")
def directional_accuracy(spark, d):
    from stationcare.operators.rul_metrics import directional_accuracy as fn
    return plain(fn(views.rul_predictions(spark, d), ORDER))


@query("last_per_machine", f"""WITH {FLEET}
SELECT id, vehiculo_id, prioridad FROM acted QUALIFY row_number() OVER (
  PARTITION BY vehiculo_id ORDER BY timestamp DESC, id DESC) = 1""")
def last_per_machine(spark, d):
    plan = maintenance.action_plan(views.fleet_scores(spark, d))
    return maintenance.latest_per_machine(plan, "vehiculo_id", ORDER).select("id", "vehiculo_id", "prioridad")


@query("urgent_component", f"""WITH {FLEET} SELECT id, urgente AS componente_urgente FROM acted""")
def urgent_component(spark, d):
    return maintenance.urgent_component(views.fleet_scores(spark, d)).select("id", "componente_urgente")


@query("action_plan", f"WITH {FLEET} SELECT id, vehiculo_id, prioridad, accion_recomendada FROM acted")
def action_plan(spark, d):
    return maintenance.action_plan(views.fleet_scores(spark, d)).select(
        "id", "vehiculo_id", "prioridad", "accion_recomendada")


@query("maintenance_plan", f"""WITH {FLEET}
SELECT vehiculo_id, id, predicted_estado, round(min_rul, 6) AS rul_minimo, prioridad, accion_recomendada FROM acted
QUALIFY row_number() OVER (PARTITION BY vehiculo_id ORDER BY timestamp DESC, id DESC) = 1""")
def maintenance_plan(spark, d):
    latest = maintenance.latest_per_machine(views.fleet_scores(spark, d), "vehiculo_id", ORDER)
    plan = maintenance.action_plan(latest)
    return plain(plan.select("vehiculo_id", "id", "predicted_estado", F.least(
        "predicted_rul_aceite", "predicted_rul_frenos", "predicted_rul_refrigerante").alias("rul_minimo"),
        "prioridad", "accion_recomendada"))


@query("fleet_kpis", f"""WITH {FLEET}
SELECT count(*) FILTER (prioridad = 'ALTA') AS alta_rows, count(*) FILTER (prioridad = 'MEDIA') AS media_rows,
  count(DISTINCT vehiculo_id) FILTER (prioridad = 'ALTA') AS alta_machines,
  count(DISTINCT vehiculo_id) FILTER (prioridad = 'MEDIA') AS media_machines FROM acted""")
def fleet_kpis(spark, d):
    return maintenance.fleet_kpis(maintenance.action_plan(views.fleet_scores(spark, d)), "vehiculo_id")


@query("alert_list", f"""WITH {FLEET}
SELECT vehiculo_id, id, accion_recomendada FROM acted WHERE prioridad = 'ALTA'
QUALIFY row_number() OVER (PARTITION BY vehiculo_id ORDER BY timestamp DESC, id DESC) = 1""")
def alert_list(spark, d):
    plan = maintenance.action_plan(views.fleet_scores(spark, d))
    return maintenance.alert_list(plan, "vehiculo_id", ORDER, "ALTA").select("vehiculo_id", "id", "accion_recomendada")


@query("state_runs", f"""WITH {STATES}, f AS (
  SELECT id, timestamp, CASE WHEN estado_agrupado = lag(estado_agrupado) OVER ({BY_TIME}) THEN 0 ELSE 1 END AS c FROM states)
SELECT id, CAST(sum(c) OVER ({BY_TIME} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM f""")
def state_runs(spark, d):
    r = clean.group_states(views.readings(spark, d)).select(*ORDER, S.GROUPED_STATE)
    rows = r.count()
    return o.change_runs(o.with_index(r, ORDER, rows=rows), S.GROUPED_STATE, rows).select("id", "run_id")
