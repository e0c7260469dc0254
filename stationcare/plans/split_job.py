"""Split readings into training and test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.operators.clean import group_states
from stationcare.operators.profile import class_share
from stationcare.operators.split import stratified_split
from stationcare.sources.sinks import write_split


def split_readings(df: DataFrame, key: str = "id", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with ``split``, and the class shares of each side."""
    if S.GROUPED_STATE not in df.columns:
        df = group_states(df)
    split = stratified_split(df, S.GROUPED_STATE, key)
    if path:
        write_split(split, path)
        split = df.sparkSession.read.parquet(path)
    sides = [class_share(split.where(F.col("split") == side), S.GROUPED_STATE).withColumn("split", F.lit(side))
             for side in ("train", "test")]
    return split, sides[0].unionByName(sides[1])
