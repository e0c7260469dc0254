"""Statistics across the sensors of one row."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stationcare.settings import EPSILON


def _total(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def _if_complete(values: list[Column], result: Column) -> Column:
    complete = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
    return F.when(complete, result)


def _largest(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def _smallest(values: list[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def row_mean(values: list[Column]) -> Column:
    return _total(values) / F.lit(float(len(values)))


def row_std(values: list[Column]) -> Column:
    """Population standard deviation; NULL if any value is NULL."""
    mean = row_mean(values)
    return F.sqrt(_total([(v - mean) * (v - mean) for v in values]) / F.lit(float(len(values))))


def row_median(values: list[Column]) -> Column:
    n = len(values)
    ordered = F.sort_array(F.array(*values))
    low, high = F.get(ordered, F.lit((n - 1) // 2)), F.get(ordered, F.lit(n // 2))
    return _if_complete(values, (low + high) / 2.0)


def row_skew(values: list[Column]) -> Column:
    """Bias-corrected skewness of the non-NULL values; NULL below three values."""
    n = _total([v.isNotNull().cast("double") for v in values])
    mean = F.try_divide(_total([F.coalesce(v, F.lit(0.0)) for v in values]), n)
    gaps = [F.coalesce(v - mean, F.lit(0.0)) for v in values]
    m2 = F.try_divide(_total([g * g for g in gaps]), n)
    m3 = F.try_divide(_total([g * g * g for g in gaps]), n)
    skew = F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.try_divide(m3, m2 * F.sqrt(m2))
    flat = _largest_known(values) == _smallest_known(values)
    # items of an array, unlike branches, share what they have in common: mean and gaps are worked out once
    return F.get(F.array(skew, F.lit(0.0), F.lit(None).cast("double")), F.when(n < 3, 2).when(flat, 1).otherwise(0))


def _largest_known(values: list[Column]) -> Column:
    return F.array_max(F.array(*values))


def _smallest_known(values: list[Column]) -> Column:
    return F.array_min(F.array(*values))


def ratios(values: list[Column]) -> dict[str, Column]:
    return {f"sensor_ratio_{i}{j}": F.try_divide(values[i], values[j] + F.lit(EPSILON))
            for i, j in combinations(range(len(values)), 2)}


def sensor_features(values: list[Column], level: str = "complete") -> dict[str, Column]:
    """Row statistics: ``essential``, ``basic`` or ``complete``."""
    values = [v.cast("double") for v in values]
    out = {"sensor_mean": row_mean(values), "sensor_std": row_std(values)}
    if level == "essential":
        return out
    top = _if_complete(values, _largest(values))
    bottom = _if_complete(values, _smallest(values))
    out |= {"sensor_max": top, "sensor_min": bottom, "sensor_range": top - bottom}
    pairs = ratios(values)
    if level == "basic":
        return out | {k: v for k, v in pairs.items() if k == "sensor_ratio_01"}
    return out | {"sensor_median": row_median(values), "sensor_skew": row_skew(values)} | pairs


def clean_double(value: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(value), value)


def one_for_zero(value: Column) -> Column:
    return F.when(value == 0, F.lit(1).cast("double")).otherwise(value)
