"""Test tables seen as station tables. The same mapping is written as SQL in ``oracle``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcare.roles import Roles
from stationcare.sources.tables import read_table

# events arrive about once in 259 s at sf0.01; this rate gives windows of 13 / 83 / 333 rows
EVENTS_HZ = 0.00386

ROLES = Roles(sensors=("sensor_1", "sensor_2", "sensor_3"), hours="horas",
              rul_targets={"aceite": "rul_aceite", "frenos": "rul_frenos", "refrigerante": "rul_refrigerante"})


def load(spark: SparkSession, sf_dir: str, name: str, where: Column | None = None) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = read_table(spark, f"{sf_dir}/{name}.parquet", where=where)
    times = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else df


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    state = (F.when(F.col("event_type") == "view", "Normal_Operacion")
             .when(F.col("event_type") == "click", "Degradacion_Gradual")
             .when(F.col("event_type") == "purchase", "Fuga_Menor")
             .when(F.col("event_type") == "signup", "RUL_Critico")
             .when(F.col("event_type") == "error", "Fallo_Inminente_Bomba_Aceite"))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"),
        F.col("user_id").alias("vehiculo_id"),
        F.when(F.col("user_id") % 5 < 3, "Sedan").otherwise("SUV").alias("tipo_vehiculo"),
        state.alias("estado_sistema"), F.col("value").alias("sensor_1"), k.alias("sensor_2"),
        (F.col("event_id") % 97).cast("double").alias("sensor_3"),
        (F.col("event_id") * 0.05).alias("horas"), (F.col("value") / 10).alias("rul_aceite"),
        (k / 4).alias("rul_frenos"), ((F.col("event_id") % 251) / 10).alias("rul_refrigerante"))


def class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth, prediction and probabilities (Advertencia, Critico, Normal) per reading."""
    from stationcare.functions.states import grouped_state

    r = readings(spark, sf_dir)
    pick = (F.col("id") * 7) % 5
    said = F.when(pick == 0, "Normal").when(pick <= 2, "Advertencia").otherwise("Critico")
    k = F.col("sensor_2")
    total = k + (F.col("id") % 13) + (F.col("id") % 29) + 3
    return r.select(
        "id", "timestamp", "vehiculo_id", grouped_state(F.col("estado_sistema")).alias("y_true"),
        said.alias("y_pred"), (F.col("id") % 2).cast("int").alias("fold"),
        F.array((k + 1) / total, (F.col("id") % 13 + 1) / total, (F.col("id") % 29 + 1) / total).alias("proba"))


CLASSES = ["Advertencia", "Critico", "Normal"]


def rul_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    shift = ((F.col("id") % 7) - 3) * 0.5
    return r.select("id", "timestamp", "vehiculo_id", F.col("rul_aceite").alias("y_true"),
                    F.greatest(F.lit(0.0), F.col("rul_aceite") + shift).alias("y_pred"),
                    (F.col("id") % 2).cast("int").alias("fold"))


def fleet_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    pick = (F.col("id") * 7) % 5
    shift = ((F.col("id") % 7) - 3) * 0.5
    return r.select(
        "id", "timestamp", "vehiculo_id",
        F.when(pick <= 2, "Normal").when(pick == 3, "Advertencia").otherwise("Critico").alias("predicted_estado"),
        *[F.greatest(F.lit(0.0), F.col(f"rul_{c}") + shift).alias(f"predicted_rul_{c}")
          for c in ("aceite", "frenos", "refrigerante")])
