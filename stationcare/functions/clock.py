"""Calendar and clock features as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text, with or without fractions of a second; NULL when it does not parse."""
    return F.try_to_timestamp(text)


def calendar_features(ts: Column, first_week: Column) -> dict[str, Column]:
    """The ten calendar columns of the feature set."""
    hour, day = F.hour(ts), F.weekday(ts)
    turn = 2 * math.pi
    return {
        "hora_dia": hour,
        "dia_semana": day,
        "mes": F.month(ts),
        "es_fin_semana": (day >= 5).cast("int"),
        "es_horario_nocturno": night(hour),
        "semana_operacion": F.weekofyear(ts) - first_week + 1,
        "hora_sin": F.sin(turn * hour / 24.0),
        "hora_cos": F.cos(turn * hour / 24.0),
        "dia_sin": F.sin(turn * day / 7.0),
        "dia_cos": F.cos(turn * day / 7.0),
    }


def basic_calendar_features(ts: Column, first_week: Column) -> dict[str, Column]:
    """The eight columns of the plain preprocessing set."""
    hour = F.hour(ts)
    return {
        "hora_dia": hour,
        "dia_semana": F.weekday(ts),
        "mes": F.month(ts),
        "es_fin_semana": (F.weekday(ts) >= 5).cast("int"),
        "semana_operacion": F.weekofyear(ts) - first_week + 1,
        "es_horario_laboral": hour.between(8, 17).cast("int"),
        "minuto_hora": F.minute(ts),
        "segundo_minuto": F.second(ts),
    }


def night(hour: Column) -> Column:
    return ((hour >= 22) | (hour <= 6)).cast("int")


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def week_of_month(ts: Column) -> Column:
    return F.floor((F.dayofmonth(ts) - 1) / 7).cast("int") + 1


def productive_shift(ts: Column) -> Column:
    """No Sundays; days 06-22 otherwise; nights only on Monday, Wednesday and Friday."""
    hour, day = F.hour(ts), F.weekday(ts)
    return (F.when(day == 6, False)
            .when((hour >= 6) & (hour < 22), True)
            .when(day == 5, False)
            .otherwise(day % 2 == 0))


def production_block(ts: Column) -> Column:
    return F.when(productive_shift(ts), F.hour(ts) % 3 + 1).otherwise(0)
