"""Cleaning and preparation ahead of the features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.functions.clock import basic_calendar_features
from stationcare.operators.clean import (drop_missing_target, group_states, nan_to_null, parse_timestamps,
                                         sample_machines)
from stationcare.plans.features import FeatureState, engineer
from stationcare.roles import Roles, detect_roles, detect_sensors, feature_columns, model_inputs


@dataclass(frozen=True)
class Prepared:
    df: DataFrame
    roles: Roles
    features: list[str]
    sensors: list[str]
    state: FeatureState | None = None


def clean_readings(df: DataFrame, roles: Roles | None = None, idle_as: str | None = None) -> tuple[DataFrame, Roles]:
    """NaN to NULL, roles detected, states grouped, timestamps parsed."""
    df = nan_to_null(df)
    roles = roles or detect_roles(df)
    if S.GROUPED_STATE not in df.columns:
        source = roles.target if roles.target in df.columns else S.RAW_STATE
        if source in df.columns:
            df = group_states(df, source, S.GROUPED_STATE, idle_as)
    if S.GROUPED_STATE in df.columns:
        roles = roles.with_(target=S.GROUPED_STATE)
    return parse_timestamps(df, roles.timestamp), roles


def preprocess(df: DataFrame, profile: str = "full", sampling_hz: float = S.SAMPLING_HZ,
               roles: Roles | None = None, state: FeatureState | None = None,
               stage: bool = True) -> Prepared:
    """Clean, engineer, drop rows without a target, list the model inputs."""
    cleaned, roles = clean_readings(df, roles)
    rich, state = engineer(cleaned, roles, profile, state, sampling_hz, stage=stage)
    if roles.target in rich.columns:
        rich = drop_missing_target(rich, roles.target)
    inputs = model_inputs(cleaned, rich, [roles.timestamp, roles.target])
    return Prepared(rich, roles, inputs, list(roles.sensors), state)


def prepare_basic(df: DataFrame, share: float | None = None) -> Prepared:
    """Calendar features and column lists only, optionally on a share of the machines."""
    cleaned, roles = clean_readings(df)
    if share is not None and roles.machine_id in cleaned.columns:
        cleaned = sample_machines(cleaned, roles.machine_id, share)
    ts = F.col(roles.timestamp)
    first = cleaned.agg(F.min(F.weekofyear(ts)))
    out = cleaned.withColumns(basic_calendar_features(ts, first.scalar()))
    return Prepared(out, roles, feature_columns(out, [roles.timestamp, roles.target]), detect_sensors(out))
