"""State grouping, class flags and maintenance decisions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stationcare import settings as S


def any_of(conditions: list[Column]) -> Column:
    """OR in which an unknown condition counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def contains_any(text: Column, parts: list[str]) -> Column:
    return text.rlike("|".join(parts))


def grouped_state(state: Column, idle_as: str | None = None) -> Column:
    """Raw station state to Normal / Advertencia / Critico; NULL stays NULL."""
    rules = F.when(state.isNull(), F.lit(None).cast("string"))
    if idle_as is not None:
        rules = rules.when(state == "INACTIVO", idle_as)
    return (rules.when(state.contains(S.NORMAL_PART), S.NORMAL)
            .when(contains_any(state, S.CRITICAL_PARTS), S.CRITICAL)
            .otherwise(S.WARNING))


def is_critical(label: Column, critical: list[str] | None = None, keywords: bool = False) -> Column:
    """Critical-class test: by exact names, or by keywords found in the name."""
    if keywords:
        hit = contains_any(label, critical or S.CRITICAL_KEYWORDS)
    else:
        hit = label.isin(critical or S.CRITICAL_CLASSES)
    return F.coalesce(hit, F.lit(False))


def critical_override(predicted: Column, probability: Column, critical: str = S.CRITICAL,
                      threshold: float = S.CRITICAL_PROBABILITY) -> Column:
    return F.when(probability > threshold, critical).otherwise(predicted)


def rul_alert(rul: Column) -> Column:
    """Reference lines of the RUL timeline: below 5 days, below 10 days."""
    return F.when(rul < 5, "critical").when(rul < 10, "warning").otherwise("ok")


def lowest(named: dict[str, Column]) -> Column:
    """Name of the smallest value in a row: NULLs skipped, first on ties."""
    entries = [F.struct(value.alias("v"), F.lit(i).alias("p"), F.lit(name).alias("n"))
               for i, (name, value) in enumerate(named.items())]
    known = F.filter(F.array(*entries), lambda e: e["v"].isNotNull())
    return F.array_min(known)["n"]


def priority(state: Column, ruls: list[Column]) -> Column:
    urgent = any_of([state == S.CRITICAL] + [r < S.URGENT_DAYS for r in ruls])
    soon = any_of([state == S.WARNING] + [r < S.SOON_DAYS for r in ruls])
    return F.when(urgent, "ALTA").when(soon, "MEDIA").otherwise("BAJA")


def action(priority_: Column, ruls: dict[str, Column]) -> Column:
    urgent = lowest(ruls) if ruls else F.lit(None).cast("string")
    return (F.when(priority_ != "ALTA", S.ACTION_STANDARD)
            .when(urgent.isNull(), S.ACTION_GENERIC)
            .otherwise(F.concat(F.lit("INSPECCIONAR "), F.upper(urgent), F.lit(" URGENTE"))))
