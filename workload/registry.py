"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable types: rounded doubles, 64-bit whole numbers."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # adding zero turns -0.0 into 0.0
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long").alias(f.name)
        out.append(c)
    return df.select(*out)


NUDGE = 1e-9


def nudged(df: DataFrame, names: list[str]) -> DataFrame:
    """Lift means off exact rounding ties, which the last bit of a sum would decide; the SQL does the same."""
    return df.withColumns({n: F.col(n) + F.lit(NUDGE) for n in names})


READINGS = """readings AS (
  SELECT event_id AS id, ts AS timestamp, user_id AS vehiculo_id,
    CASE WHEN user_id % 5 < 3 THEN 'Sedan' ELSE 'SUV' END AS tipo_vehiculo,
    CASE event_type WHEN 'view' THEN 'Normal_Operacion' WHEN 'click' THEN 'Degradacion_Gradual'
      WHEN 'purchase' THEN 'Fuga_Menor' WHEN 'signup' THEN 'RUL_Critico'
      WHEN 'error' THEN 'Fallo_Inminente_Bomba_Aceite' END AS estado_sistema,
    value AS sensor_1, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS sensor_2,
    CAST(event_id % 97 AS DOUBLE) AS sensor_3, event_id * CAST(0.05 AS DOUBLE) AS horas,
    value / 10 AS rul_aceite, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 4 AS rul_frenos,
    (event_id % 251) / 10 AS rul_refrigerante
  FROM events)"""

GROUPED = """CASE WHEN estado_sistema IS NULL THEN NULL WHEN contains(estado_sistema, 'Normal') THEN 'Normal'
  WHEN regexp_matches(estado_sistema, 'Inminente|Critico|Severa|Falla|Error|Perdida') THEN 'Critico'
  ELSE 'Advertencia' END"""

STATES = READINGS + f""", states AS (
  SELECT *, {GROUPED} AS estado_agrupado FROM readings)"""

CLASSES = READINGS + f""", preds AS (
  SELECT id, timestamp, vehiculo_id, {GROUPED} AS y_true,
    CASE WHEN id * 7 % 5 = 0 THEN 'Normal' WHEN id * 7 % 5 <= 2 THEN 'Advertencia' ELSE 'Critico' END AS y_pred,
    id % 2 AS fold, (sensor_2 + 1) / (sensor_2 + id % 13 + id % 29 + 3) AS p0,
    (id % 13 + 1) / (sensor_2 + id % 13 + id % 29 + 3) AS p1,
    (id % 29 + 1) / (sensor_2 + id % 13 + id % 29 + 3) AS p2
  FROM readings)"""

RULS = READINGS + """, ruls AS (
  SELECT id, timestamp, vehiculo_id, rul_aceite AS y_true,
    greatest(0, rul_aceite + (id % 7 - 3) * CAST(0.5 AS DOUBLE)) AS y_pred, id % 2 AS fold
  FROM readings)"""

FLEET = READINGS + """, fleet AS (
  SELECT id, timestamp, vehiculo_id,
    CASE WHEN id * 7 % 5 <= 2 THEN 'Normal' WHEN id * 7 % 5 = 3 THEN 'Advertencia' ELSE 'Critico' END
      AS predicted_estado,
    greatest(0, rul_aceite + (id % 7 - 3) * CAST(0.5 AS DOUBLE)) AS predicted_rul_aceite,
    greatest(0, rul_frenos + (id % 7 - 3) * CAST(0.5 AS DOUBLE)) AS predicted_rul_frenos,
    greatest(0, rul_refrigerante + (id % 7 - 3) * CAST(0.5 AS DOUBLE)) AS predicted_rul_refrigerante
  FROM readings), lowest AS (
  SELECT *, CASE WHEN predicted_rul_aceite <= predicted_rul_frenos
        AND predicted_rul_aceite <= predicted_rul_refrigerante THEN 'aceite'
      WHEN predicted_rul_frenos <= predicted_rul_refrigerante THEN 'frenos'
      ELSE 'refrigerante' END AS urgente,
    least(predicted_rul_aceite, predicted_rul_frenos, predicted_rul_refrigerante) AS min_rul
  FROM fleet), plan AS (
  SELECT *, CASE WHEN predicted_estado = 'Critico' OR min_rul < 3 THEN 'ALTA'
      WHEN predicted_estado = 'Advertencia' OR min_rul < 7 THEN 'MEDIA' ELSE 'BAJA' END AS prioridad
  FROM lowest), acted AS (
  SELECT *, CASE WHEN prioridad = 'ALTA' THEN 'INSPECCIONAR ' || upper(urgente) || ' URGENTE'
      ELSE 'Seguimiento estándar' END AS accion_recomendada
  FROM plan)"""


def hash_sql(*parts: str, seed: str = "42") -> str:
    text = "'" + seed + "'" + "".join(f" || '|' || CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
