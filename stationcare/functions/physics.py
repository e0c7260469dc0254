"""Expected behaviour of the station without its random part."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stationcare.functions.states import lowest
from stationcare.settings import COMPONENT_LIFE


def _clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def expected_rul(hours: Column, temperature: Column, load: Column, health: Column,
                 component: str, pressure_deviation: Column | None = None) -> Column:
    """Remaining days from wear, ambient temperature, load and health."""
    life, sensitivity = COMPONENT_LIFE[component]
    deviation = F.lit(0.0) if pressure_deviation is None else pressure_deviation
    stress = sensitivity * (0.35 * _clamp((temperature - 15.0) / 15.0, 0.4, 2.5)
                            + 0.35 * _clamp(deviation + 1.0, 0.6, 2.0)
                            + 0.3 * _clamp(load, 0.7, 1.6))
    days = F.greatest(F.lit(0.0), life * health / stress - 1.1 * hours) / 24.0
    used = hours / life
    wear = F.when(used > 0.7, F.greatest(F.lit(0.1), 1.0 - 2.0 * (used - 0.7))).otherwise(1.0)
    return F.when(hours.isNotNull() & temperature.isNotNull() & load.isNotNull()
                  & health.isNotNull(), _clamp(days * wear, 0.5, 25.0))


def expected_ambient(hour: Column) -> Column:
    return 22.0 + 8.0 * F.sin(2 * math.pi * (hour / 24.0 - 0.25))


def expected_sensor(base: float, hours: Column, health: Column, temperature: Column) -> Column:
    """Reading expected from drift, wear and temperature."""
    warm = (temperature - 22.0) / 18.0
    drift = 0.002 * (hours / 100.0) + 0.001 * F.sin(hours / 24.0)
    wear = 0.2 * (1.0 - F.greatest(F.lit(0.2), health))
    reading = base * (1.0 + drift + wear + 0.04 * warm + 0.01 * warm * warm)
    return F.when(hours.isNotNull() & health.isNotNull() & temperature.isNotNull(),
                  F.greatest(F.lit(0.1), reading))


def rule_state(ruls: dict[str, Column], healths: list[Column], working: Column | None = None) -> Column:
    """State from the smallest RUL, then from mean health."""
    smallest = F.array_min(F.array(*ruls.values()))
    health = sum(healths[1:], healths[0]) / float(len(healths))
    name = F.replace(F.initcap(F.replace(lowest(ruls), F.lit("_"), F.lit(" "))),
                     F.lit(" "), F.lit("_"))
    state = (F.when(smallest <= 1, F.concat(F.lit("Fallo_Inminente_"), name))
             .when(smallest <= 3, "RUL_Critico")
             .when(smallest <= 7, "Degradacion_Avanzada")
             .when(smallest <= 12, "Degradacion_Moderada")
             .when(health < 0.5, "Degradacion_Severa")
             .when(health < 0.7, "Degradacion_Gradual")
             .otherwise("Normal_Operacion"))
    return state if working is None else F.when(~working, "INACTIVO").otherwise(state)


def volume_deviation(actual: Column, target: Column) -> Column:
    return F.try_divide((actual - target).cast("double"), target.cast("double"))
