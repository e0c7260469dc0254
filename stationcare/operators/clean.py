"""Row and column cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcare import settings as S
from stationcare.functions.clock import parse_timestamp
from stationcare.functions.hashing import stable_hash
from stationcare.functions.rows import clean_double
from stationcare.functions.states import grouped_state
from stationcare.operators.ordered import with_index
from stationcare.operators.skew import spread_join
from stationcare.roles import is_numeric


class BadTimestamps(ValueError):
    """More than nine in ten timestamps do not parse."""


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: clean_double(F.col(c)) for c in floats}) if floats else df


def group_states(df: DataFrame, state: str = S.RAW_STATE, target: str = S.GROUPED_STATE,
                 idle_as: str | None = None) -> DataFrame:
    return df.withColumn(target, grouped_state(F.col(state), idle_as))


def parse_timestamps(df: DataFrame, column: str = S.TIMESTAMP, max_bad: float = 0.9) -> DataFrame:
    """Text to timestamps; rows that do not parse are dropped, too many of them is an error."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(column, F.col(column).cast("timestamp"))
    parsed = df.withColumn(column, parse_timestamp(F.col(column).cast("string")))
    seen = parsed.agg(F.count(F.lit(1)).alias("n"),
                      F.count_if(F.col(column).isNull()).alias("bad")).first()
    if seen["n"] and seen["bad"] / seen["n"] > max_bad:
        examples = [r[0] for r in bad_timestamps(df, column, 5).collect()]
        raise BadTimestamps(f"{seen['bad']} of {seen['n']} values of {column} do not parse: {examples}")
    return parsed.where(F.col(column).isNotNull())


def bad_timestamps(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    text = F.col(column).cast("string")
    return df.where(parse_timestamp(text).isNull()).select(text.alias(column)).limit(n)


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def valid_rul(df: DataFrame, target: str, ceiling: float | None = S.RUL_CEILING) -> DataFrame:
    """Rows with a positive RUL, cut at the ceiling."""
    kept = df.where(F.col(target).isNotNull() & (F.col(target) > 0))
    return kept if ceiling is None else kept.withColumn(target, rul_ceiling(F.col(target), ceiling))


def rul_ceiling(rul: Column, ceiling: float = S.RUL_CEILING) -> Column:
    return F.when(rul.isNull(), None).otherwise(F.least(rul, F.lit(ceiling)))


def floor_zero(prediction: Column) -> Column:
    return F.when(prediction.isNull(), None).otherwise(F.greatest(F.lit(0.0), prediction))


def sample_machines(df: DataFrame, machine_id: str = S.MACHINE_ID, share: float = 0.1,
                    seed: int = S.SEED) -> DataFrame:
    """All rows of a seeded share of the machines, at least one machine."""
    ids = df.select(machine_id).where(F.col(machine_id).isNotNull()).distinct()
    total = ids.count()
    wanted = max(1, int(total * share))
    hashed = ids.withColumn("_h", stable_hash(F.col(machine_id), seed=seed))
    ranked = with_index(hashed, ["_h", machine_id], rows=total, index="_rank")
    return spread_join(df, ranked.where(F.col("_rank") <= wanted).select(machine_id), [machine_id], "left_semi")


def rows_with_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is among ``ids``: few ids are broadcast, else hot ids are spread over tasks."""
    return spread_join(df, ids.select(on).distinct(), [on], "left_semi")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = S.SEED,
                order_by: list[str] | None = None) -> DataFrame:
    """Exactly ``n`` seeded-random rows (all of a smaller table), optionally in order; ``key`` must be unique.

    Counts per hash bucket find where the sample ends, so no task gathers it.
    """
    from stationcare.operators.split import take_first

    marked = take_first(df.withColumn("_all", F.lit(1)), "_all", key, lambda rows: F.least(rows, F.lit(n)), seed,
                        taken="_taken")
    taken = marked.where("_taken").drop("_all", "_taken")
    return taken.orderBy(*order_by) if order_by else taken


def classifier_inputs(columns: list[str], rul_targets: list[str] | None = None) -> list[str]:
    gone = set(rul_targets or S.RUL_TARGETS.values()) | set(S.CLASSIFIER_LEAKS)
    return [c for c in columns if c not in gone]


def rul_inputs(columns: list[str], rul_targets: list[str] | None = None) -> list[str]:
    gone = set(rul_targets or S.RUL_TARGETS.values()) | set(S.RUL_LEAKS)
    return [c for c in columns if c not in gone and S.RUL_LEAK_PART not in c]


def drop_leaky_names(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Drop columns whose names tell the future; also list any still looking suspicious."""
    dropped = [c for c in df.columns if any(p in c.lower() for p in S.NAME_LEAKS)]
    kept = df.drop(*dropped)
    suspicious = [c for c in kept.columns if re.search(S.SUSPICIOUS_NAMES, c)]
    return kept, dropped, suspicious


def align_columns(df: DataFrame, columns: list[str], fill: float | None = None) -> DataFrame:
    """Exactly these columns in this order; only missing columns are filled."""
    filler = F.lit(fill).cast("double")
    return df.select(*[F.col(c) if c in df.columns else filler.alias(c) for c in columns])


def split_inputs(df: DataFrame, target: str, timestamp: str = S.TIMESTAMP,
                 targets: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inputs, target and timestamps, with every target removed from the inputs."""
    if target not in df.columns:
        raise ValueError(f"target column {target} is missing")
    gone = set(targets or [*S.RUL_TARGETS.values(), S.GROUPED_STATE, S.RAW_STATE]) | {target, timestamp}
    times = df.select(timestamp) if timestamp in df.columns else df.select()
    return df.select([c for c in df.columns if c not in gone]), df.select(target), times


def prioritise_by_domain(columns: list[str], limit: int | None = None,
                         quotas: dict[str, int] | None = None) -> list[str]:
    """Above ``limit`` columns, keep a quota of each kind of name; without a limit keep all.

    The original's numbers are ``settings.DOMAIN_LIMIT`` and ``settings.DOMAIN_QUOTAS``.
    """
    if limit is None or len(columns) <= limit:
        return list(columns)
    quotas = quotas or S.DOMAIN_QUOTAS
    kinds: dict[str, list[str]] = {k: [] for k in quotas}
    for c in columns:
        kind = next((k for k, parts in S.DOMAIN_PARTS.items()
                     if any(p in c.lower() for p in parts)), "other")
        kinds[kind].append(c)
    return [c for k, quota in quotas.items() for c in kinds[k][:quota]]


def downcast(df: DataFrame) -> DataFrame:
    """Narrow numeric columns to the smallest type their observed range allows."""
    fields = [f for f in df.schema.fields if is_numeric(f.dataType)]
    if not fields:
        return df
    seen = df.agg(*[a for f in fields for a in (F.min(f.name).alias(f"lo_{f.name}"),
                                                F.max(f.name).alias(f"hi_{f.name}"))]).first()
    casts = {}
    for f in fields:
        lo, hi = seen[f"lo_{f.name}"], seen[f"hi_{f.name}"]
        if lo is None:
            continue
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            casts[f.name] = F.col(f.name).cast("float")
        elif isinstance(f.dataType, T.IntegralType):
            for kind, top in (("byte", 2**7), ("short", 2**15), ("int", 2**31)):
                if -top <= lo and hi < top:
                    casts[f.name] = F.col(f.name).cast(kind)
                    break
    return df.withColumns(casts)
