"""Feature engineering: one numbering of the rows, one block pass for every window."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.functions.clock import calendar_features
from stationcare.functions.rows import one_for_zero, sensor_features
from stationcare.operators.ordered import (INDEX, Blocks, Rolling, change_runs, interpolate,
                                           rolling_blocks, with_index)
from stationcare.operators.profile import iqr_bounds
from stationcare.operators.quantiles import quantiles
from stationcare.roles import Roles
from stationcare.session import staged

PROFILES = {
    "full": dict(rows="complete", windows=[1, 6], trend=True, cycles=True, spectral=2, outliers=True),
    "complete": dict(rows="complete", windows=[1, 6], trend=False, cycles=True, spectral=2, outliers=False),
    "balanced": dict(rows="basic", windows=[1, 6], trend=False, cycles=True, spectral=1, outliers=False),
    "optimized": dict(rows="essential", windows=[1], trend=False, cycles=False, spectral=0, outliers=False),
}


@dataclass(frozen=True)
class FeatureState:
    """Numbers learnt from the training rows and reused unchanged when scoring."""

    rows: int
    sampling_hz: float
    first_week: int | None = None
    start_us: int | None = None
    baselines: dict[str, float | None] = field(default_factory=dict)
    fences: dict[str, list[float]] = field(default_factory=dict)
    cycles: int = 0
    cycle_baseline: float | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "FeatureState":
        return FeatureState(**json.loads(text))


def window_rows(hours: float, hz: float, rows: int) -> int:
    return min(int(hours * 3600 * hz), rows - 1)


def baseline_rows(hz: float, rows: int) -> int:
    return min(int(24 * 3600 * hz), rows // 4)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def ordered_readings(df: DataFrame, roles: Roles, rows: int | None = None, cycles: bool = True,
                     stage: bool = True) -> DataFrame:
    """Readings with their position and, where vehicles have types, the cycle they belong to.

    Several passes follow, so the rows are written once to the shared folder
    unless ``stage`` is off.
    """
    rows = df.count() if rows is None else rows
    out = with_index(df, list(roles.order_key), rows=rows)
    if cycles and roles.vehicle_type in df.columns:
        out = change_runs(out, roles.vehicle_type, rows, flag="cambio_vehiculo", run="ciclo_id")
    return staged(out, "ordered") if stage else out


def fit_features(ordered: DataFrame, roles: Roles, sampling_hz: float = S.SAMPLING_HZ,
                 rows: int | None = None) -> FeatureState:
    """Learn baselines, fences, first week and cycle pace from ordered readings."""
    rows = ordered.count() if rows is None else rows
    sensors, ts = list(roles.sensors), roles.timestamp
    k = baseline_rows(sampling_hz, rows)
    early = (F.col(INDEX) <= k) if k > 0 else F.lit(True)
    seen = ordered.agg(
        F.min(F.weekofyear(ts)).alias("week"), F.min(F.when(F.col(INDEX) == 1, _micros(ts))).alias("start"),
        *[F.avg(F.when(early, F.col(c).cast("double"))).alias(f"b_{c}") for c in sensors],
        F.max("ciclo_id").alias("cycles") if "ciclo_id" in ordered.columns else F.lit(0).alias("cycles")).first()
    fences = {r["column"]: [r["low"], r["high"], r["far_low"], r["far_high"]]
              for r in iqr_bounds(ordered, sensors, rows=rows).collect()} if sensors else {}
    cycles, pace = seen["cycles"] or 0, None
    if cycles > 10:
        pace = quantiles(cycle_table(ordered, ts), ["duracion_segundos"], [0.1], rows=cycles).first()["q"][0]
    return FeatureState(rows, sampling_hz, seen["week"], seen["start"],
                        {c: seen[f"b_{c}"] for c in sensors},
                        fences, cycles, pace)


def cycle_table(ordered: DataFrame, timestamp: str) -> DataFrame:
    """One row per cycle: duration, rows, first and last position."""
    us = _micros(timestamp)
    return ordered.groupBy("ciclo_id").agg(
        ((F.max(us) - F.min(us)) / 1e6).alias("duracion_segundos"), F.count(timestamp).alias("num_muestras"),
        F.min(INDEX).alias("_first"), F.max(INDEX).alias("_last"))


def rolling_plan(state: FeatureState, roles: Roles, profile: dict) -> list[Rolling]:
    """Windows and their widths follow the training rows, whatever table they are used on."""
    specs, rows = [], state.rows
    for sensor in roles.sensors:
        for hours in profile["windows"]:
            w = window_rows(hours, state.sampling_hz, rows)
            if w > 10:
                specs.append(Rolling(f"{sensor}_ma_{hours}h", sensor, w, max(1, w // 4)))
        if profile["trend"]:
            w = int(S.TREND_HOURS * 3600 * state.sampling_hz)
            specs.append(Rolling(f"{sensor}_ma_{S.TREND_HOURS}h", sensor, max(w, 1), S.TREND_MIN_PERIODS))
    size = {2: min(500, rows // 20), 1: min(1000, rows // 10), 0: 0}[profile["spectral"]]
    if size > 50:
        for sensor in roles.sensors[:profile["spectral"]]:
            specs.append(Rolling(f"{sensor}_spectral_energy", sensor, size, size // 2, "variance"))
    return specs


def engineer(df: DataFrame, roles: Roles, profile: str = "full", state: FeatureState | None = None,
             sampling_hz: float = S.SAMPLING_HZ, rows: int | None = None, clean_sensors: bool = False,
             stage: bool = True) -> tuple[DataFrame, FeatureState]:
    """Add the feature columns; ``state=None`` learns the numbers from this table."""
    parts = PROFILES[profile]
    rows = df.count() if rows is None else rows
    ordered = ordered_readings(df, roles, rows, parts["cycles"], stage)
    if state is None:
        state = fit_features(ordered, roles, sampling_hz, rows)
    ts, sensors = roles.timestamp, list(roles.sensors)
    specs = rolling_plan(state, roles, parts)
    blocks = rolling_blocks(ordered, specs, rows, extra=2)
    blocks = _differences(blocks, roles, parts)
    out = _cycles(blocks, ordered, ts, state) if "ciclo_id" in ordered.columns else blocks.result()
    new: dict[str, Column] = {}
    if state.first_week is not None:
        new |= calendar_features(F.col(ts).cast("timestamp"), F.lit(state.first_week))
    if sensors:
        new |= sensor_features([F.col(c) for c in sensors], parts["rows"])
    for sensor in sensors:
        for hours in parts["windows"]:
            # the minimal set has the mean only
            if parts["rows"] != "essential" and f"{sensor}_ma_{hours}h" in out.columns:
                new[f"{sensor}_deg_ratio_{hours}h"] = F.try_divide(
                    F.col(sensor).cast("double"), F.lit(state.baselines[sensor]).cast("double"))
        if parts["outliers"] and state.fences.get(sensor):
            low, high = state.fences[sensor][:2]
            new[f"{sensor}_is_outlier"] = outlier_flag(F.col(sensor), low, high)
        if f"{sensor}_spectral_energy" in out.columns:
            new[f"{sensor}_spectral_energy"] = F.coalesce(f"{sensor}_spectral_energy", F.lit(0.0))
    elapsed = elapsed_hours(F.col(ts), state.start_us)
    new["tiempo_operacion_horas"] = elapsed
    if roles.hours and roles.hours in df.columns:
        new["ratio_utilizacion"] = F.col(roles.hours).cast("double") / one_for_zero(elapsed)
    out = out.withColumns(new)
    if clean_sensors:
        out = cleaned_sensors(out, sensors, state.fences, rows)
    return out.drop(INDEX), state


def elapsed_hours(ts: Column, start_us: int | None) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) - F.lit(start_us).cast("long")) / F.lit(3.6e9)


def outlier_flag(value: Column, low: float | None, high: float | None) -> Column:
    outside = (value < F.lit(low).cast("double")) | (value > F.lit(high).cast("double"))
    return F.coalesce(outside.cast("int"), F.lit(0))


def _differences(blocks: Blocks, roles: Roles, parts: dict) -> Blocks:
    """First and second differences, on blocks that still carry two valid halo rows."""
    w, zero = blocks.window, F.lit(0.0)

    def step(c: str) -> Column:
        return F.coalesce(F.col(c) - F.lag(c, 1).over(w), zero)

    if parts["trend"]:
        means = {s: f"{s}_ma_{S.TREND_HOURS}h" for s in roles.sensors}
        blocks = blocks.with_columns({f"{s}_trend_velocity": step(m) for s, m in means.items()})
        blocks = blocks.with_columns({f"{s}_trend_acceleration": step(f"{s}_trend_velocity")
                                      for s in roles.sensors})
    if roles.hours and roles.hours in blocks.df.columns:
        blocks = blocks.with_columns({"intensidad_operacional": step(roles.hours)})
    return blocks


def _cycles(blocks: Blocks, ordered: DataFrame, timestamp: str, state: FeatureState) -> DataFrame:
    """Duration, size, position and pace of each row's cycle.

    A cycle meets every block it covers, so no join key holds more rows than a
    block, however long the cycle is.
    """
    length = F.lit(blocks.length)
    spread = cycle_table(ordered, timestamp).withColumn("_b", F.explode(F.sequence(
        F.floor((F.col("_first") - 1) / length).cast("long"),
        F.floor((F.col("_last") - 1) / length).cast("long")))).withColumnRenamed("ciclo_id", "_c")
    rows = blocks.own_rows().df
    joined = rows.join(spread, (F.col("_block") == F.col("_b")) & (F.col("ciclo_id") == F.col("_c")), "left")
    count = F.greatest(F.col("num_muestras"), F.lit(1))
    return joined.withColumns({
        "posicion_en_ciclo": (F.col(INDEX) - F.col("_first")) / count,
        "eficiencia_relativa": F.lit(state.cycle_baseline).cast("double")
        / one_for_zero(F.col("duracion_segundos"))}).drop(
        "_first", "_last", "_block", "_halo", "_b", "_c")


def cleaned_sensors(df: DataFrame, sensors: list[str], fences: dict[str, list[float]],
                    rows: int, suffix: str = "_limpio") -> DataFrame:
    """Sensors with extreme values removed and interpolated, as extra columns."""
    names = [s for s in sensors if fences.get(s)]
    kept = df.withColumns({s + suffix: F.when(
        F.col(s).between(F.lit(fences[s][2]), F.lit(fences[s][3])), F.col(s).cast("double")) for s in names})
    return interpolate(kept, [s + suffix for s in names], rows)


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    return sorted(set(after.columns) - set(before.columns))


def preview(df: DataFrame, roles: Roles, profile: str = "full", sampling_hz: float = S.SAMPLING_HZ,
            rows: int = 10_000_000) -> list[str]:
    """Names of the columns ``engineer`` would add, from the plan alone."""
    sample = df.limit(0)
    unit = [0.0] * 4
    state = FeatureState(rows, sampling_hz, 1, 0, {s: 1.0 for s in roles.sensors},
                         {s: unit for s in roles.sensors}, 11, 1.0)
    out, _ = engineer(sample, roles, profile, state, sampling_hz, rows, stage=False)
    return new_columns(df, out)
