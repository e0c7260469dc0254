"""Which column plays which part, and how to find out from a schema."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcare import settings as S
from stationcare.functions.clock import parse_timestamp


@dataclass(frozen=True)
class Roles:
    timestamp: str = S.TIMESTAMP
    machine_id: str = S.MACHINE_ID
    target: str = S.GROUPED_STATE
    sensors: tuple[str, ...] = tuple(S.SENSORS)
    rul_targets: dict[str, str] = field(default_factory=lambda: dict(S.RUL_TARGETS))
    vehicle_type: str = S.VEHICLE_TYPE
    order_key: tuple[str, ...] = (S.TIMESTAMP, "id")
    hours: str | None = None

    def with_(self, **changes) -> "Roles":
        return replace(self, **changes)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def columns_of_kind(df: DataFrame) -> dict[str, list[str]]:
    """Column names by kind: numeric, categorical, datetime, other."""
    kinds: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": [], "other": []}
    for f in df.schema.fields:
        if is_numeric(f.dataType):
            kinds["numeric"].append(f.name)
        elif isinstance(f.dataType, T.StringType):
            kinds["categorical"].append(f.name)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kinds["datetime"].append(f.name)
        else:
            kinds["other"].append(f.name)
    return kinds


def _by_name(columns: list[str], names: list[str], parts: list[str]) -> str | None:
    for name in names:
        if name in columns:
            return name
    return next((c for c in columns if any(p in c.lower() for p in parts)), None)


def detect_timestamp(df: DataFrame) -> str | None:
    """By exact name, then by part of the name, then the first text column whose values all parse."""
    found = _by_name(df.columns, S.TIMESTAMP_NAMES, S.TIMESTAMP_PARTS)
    texts = columns_of_kind(df)["categorical"]
    if found or not texts:
        return found
    seen = df.agg(*[a for i, name in enumerate(texts) for a in (
        F.count(name).alias(f"n{i}"), F.count(parse_timestamp(F.col(name))).alias(f"ok{i}"))]).first()
    return next((name for i, name in enumerate(texts) if seen[f"n{i}"] and seen[f"n{i}"] == seen[f"ok{i}"]), None)


def detect_target(df: DataFrame, timestamp: str | None = None) -> str | None:
    """By exact name, then by part of the name, then the first text column with 2-50 values."""
    found = _by_name(df.columns, S.TARGET_NAMES, S.TARGET_PARTS)
    texts = [c for c in columns_of_kind(df)["categorical"] if c != timestamp]
    if found or not texts:
        return found
    counts = df.agg(*[F.approx_count_distinct(c, 0.01).alias(c) for c in texts]).first()
    for name in texts:
        if 1 <= counts[name] <= 60:
            exact = df.select(name).where(F.col(name).isNotNull()).distinct().limit(51).count()
            if 2 <= exact <= 50:
                return name
    return None


def detect_sensors(df: DataFrame, parts: list[str] | None = None) -> list[str]:
    parts = parts or S.SENSOR_PARTS
    return [f.name for f in df.schema.fields
            if is_numeric(f.dataType) and any(p in f.name.lower() for p in parts)]


def feature_columns(df: DataFrame, exclude: list[str | None]) -> list[str]:
    """Numeric columns that are neither timestamp, target nor a stored row index."""
    gone = {c for c in exclude if c} | {"index"}
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in gone]


def model_inputs(original: DataFrame, engineered: DataFrame, exclude: list[str | None]) -> list[str]:
    """Original numeric columns, then new ones sorted by name, without repeats."""
    base = feature_columns(original, exclude)
    new = sorted(set(feature_columns(engineered, exclude)) - set(original.columns))
    return base + new


def detect_roles(df: DataFrame) -> Roles:
    timestamp = detect_timestamp(df)
    if timestamp is None:
        raise ValueError("the readings need a timestamp column")
    target = detect_target(df, timestamp)
    sensors = [s for s in S.SENSORS if s in df.columns] or detect_sensors(df, S.QUALITY_SENSOR_PARTS)
    ruls = {k: v for k, v in S.RUL_TARGETS.items() if v in df.columns}
    order = (timestamp, "id") if "id" in df.columns else (timestamp,)
    return Roles(timestamp=timestamp, target=target, sensors=tuple(sensors), rul_targets=ruls,
                 order_key=order)
