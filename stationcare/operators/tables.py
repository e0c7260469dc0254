"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000


def settled(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Fix a small table as a local relation and mark it for broadcast.

    The row count is checked first; a table over the limit comes back untouched
    and joins by shuffle.
    """
    rows = small.limit(limit + 1).collect()
    if len(rows) > limit:
        return small
    return F.broadcast(small.sparkSession.createDataFrame(rows, small.schema))


def melted(wide: DataFrame, by: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Named columns to ``(*by, metric, value)`` rows."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value"))
                               for n, c in metrics.items()]))
    return wide.select(*by, rows.alias("_m")).select(*by, "_m.metric", "_m.value")
