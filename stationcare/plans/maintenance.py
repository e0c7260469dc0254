"""From predictions to a maintenance plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.functions import states
from stationcare.operators.tables import settled


def _ruls(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(f"predicted_rul_{c}") for c in S.RUL_TARGETS if f"predicted_rul_{c}" in df.columns}


def action_plan(df: DataFrame) -> DataFrame:
    """Add priority and recommended action to scored rows."""
    ruls = _ruls(df)
    planned = df.withColumn("prioridad", states.priority(F.col("predicted_estado"), list(ruls.values())))
    return planned.withColumn("accion_recomendada", states.action(F.col("prioridad"), ruls))


def urgent_component(df: DataFrame) -> DataFrame:
    return df.withColumn("componente_urgente", states.lowest(_ruls(df)))


def latest_per_machine(df: DataFrame, machine_id: str, order_by: list[str]) -> DataFrame:
    """Last row of every machine; of rows with one order key, any one.

    The order keys alone are aggregated, then the rows that hold the last key of their machine are looked up, so
    wide rows are neither sorted nor moved unless they win.
    """
    last = df.groupBy(F.col(machine_id).alias("_g")).agg(F.max(F.struct(*order_by)).alias("_k"))
    key = F.struct(*order_by)
    won = df.join(settled(last), F.col(machine_id).eqNullSafe(F.col("_g")) & key.eqNullSafe(F.col("_k"))).drop("_g", "_k")
    place = F.row_number().over(Window.partitionBy(machine_id).orderBy(*order_by))
    return won.withColumn("_place", place).where("_place = 1").drop("_place")


def fleet_kpis(plan: DataFrame, machine_id: str) -> DataFrame:
    """Rows and machines per alert level."""
    high, mid = F.col("prioridad") == "ALTA", F.col("prioridad") == "MEDIA"
    per_machine = plan.groupBy(machine_id).agg(
        F.count_if(high).alias("h"), F.count_if(mid).alias("m"))
    return per_machine.agg(
        F.coalesce(F.sum("h"), F.lit(0)).alias("alta_rows"), F.coalesce(F.sum("m"), F.lit(0)).alias("media_rows"),
        F.count_if(F.col("h") > 0).alias("alta_machines"), F.count_if(F.col("m") > 0).alias("media_machines"))


def alert_list(plan: DataFrame, machine_id: str, order_by: list[str], level: str) -> DataFrame:
    """Latest row of every machine among the rows at one alert level."""
    return latest_per_machine(plan.where(F.col("prioridad") == level), machine_id, order_by)
