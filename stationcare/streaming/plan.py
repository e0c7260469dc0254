"""The row-wise part of scoring on a stream: no state, the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stationcare import settings as S
from stationcare.functions.clock import calendar_features
from stationcare.functions.rows import sensor_features
from stationcare.functions.states import grouped_state
from stationcare.plans.features import FeatureState
from stationcare.plans.maintenance import action_plan


def enriched(readings: DataFrame, sensors: list[str], state: FeatureState,
             timestamp: str = S.TIMESTAMP, raw_state: str = S.RAW_STATE) -> DataFrame:
    """Grouped state, calendar and row statistics with frozen numbers."""
    return readings.withColumn(S.GROUPED_STATE, grouped_state(F.col(raw_state))).withColumns(
        calendar_features(F.col(timestamp), F.lit(state.first_week))
        | sensor_features([F.col(c) for c in sensors]))


def planned(scored: DataFrame) -> DataFrame:
    return action_plan(scored)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all files present now, then stop."""
    return (stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
