"""Candidate splits of numeric columns, found once per training table and shared by all trees grown from it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcare.operators.quantiles import ACCURACY, EXACT_LIMIT, doubles, sorted_chunks, unpivot

MAX_BINS = 256
#: the sketch of a large table takes every STEP-th of the sorted values of a chunk, which shifts a rank by less than the sketch does
STEP = 8


def fit_cuts(df: DataFrame, columns: list[str], bins: int = MAX_BINS, rows: int | None = None) -> dict[str, list[float]]:
    """At most ``bins - 1`` ascending cuts per column; a value at or above a cut stands to its right.

    A column of up to ``bins`` different values is cut between any two of them, so no split of it is lost. Others
    are cut at quantiles from a sketch, to within one part in ``ACCURACY`` of their rank. NULLs and NaN have no say;
    a column without values, or with one, has no cut. The driver sees cuts only. Tables known to have many ``rows`` are
    sorted chunk by chunk in tasks, which also list the values of columns with few.
    """
    if not columns:
        return {}
    if rows is not None and rows > EXACT_LIMIT:
        return _chunked_cuts(df, columns, bins)
    long = unpivot(df, columns).where(~F.isnan("x"))
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    facts = long.groupBy("column").agg(F.approx_count_distinct("x").alias("about"),
                                       F.percentile_approx("x", probs, ACCURACY).alias("q")).collect()
    # the estimate is off by a few hundredths; only columns that may have few values are listed
    few = [r["column"] for r in facts if r["about"] <= 2 * bins]
    listed = long.where(F.col("column").isin(few)).groupBy("column").agg(F.sort_array(F.collect_set("x")).alias("v")).collect()
    values = {r["column"]: r["v"] for r in listed if len(r["v"]) <= bins}
    cuts = {r["column"]: sorted(set(r["q"])) for r in facts}
    cuts |= {c: [a + (b - a) / 2 for a, b in pairwise(v)] for c, v in values.items()}
    return {c: [float(x) for x in cuts.get(c, [])] for c in columns}


def _chunked_cuts(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, v in sorted_chunks(batches, columns):
            v = v[~np.isnan(v)] + 0.0  # one zero
            if not len(v):
                continue
            x, values = v[min(STEP, len(v)) // 2::STEP], v[np.flatnonzero(np.r_[True, v[1:] != v[:-1]])]
            few = values[:0] if len(values) > bins else values
            n, m = len(x), len(few)
            yield pa.RecordBatch.from_arrays([
                pa.repeat(name, n + m + 1), pa.concat_arrays([pa.array(x, pa.float64()), pa.nulls(m + 1, pa.float64())]),
                pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(few, pa.float64()), pa.nulls(1, pa.float64())]),
                pa.concat_arrays([pa.nulls(n + m, pa.bool_()), pa.array([len(values) > bins])])], ["column", "x", "few", "many"])

    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    seen = doubles(df, columns).mapInArrow(run, "column string, x double, few double, many boolean")
    facts = seen.groupBy("column").agg(F.percentile_approx("x", probs, ACCURACY).alias("q"), F.sort_array(F.collect_set("few")).alias("v"),
                                       F.bool_or("many").alias("many")).collect()
    cuts = {r["column"]: [a + (b - a) / 2 for a, b in pairwise(r["v"])] if not r["many"] and len(r["v"]) <= bins
            else sorted(set(r["q"])) for r in facts}
    return {c: [float(x) for x in cuts.get(c, [])] for c in columns}
