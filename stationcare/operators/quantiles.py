"""Exact quantiles (linear interpolation) of any number of rows.

Groups of up to ``EXACT_LIMIT`` rows take one ``percentile`` aggregate. Beyond that
its buffer of distinct values would outgrow a task, so a rank-bounded sketch first
brackets each wanted rank and only values inside the bracket are ordered. Both give
the same numbers; the limit only says which way they are found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcare.operators.tables import settled

EXACT_LIMIT = 200_000
BRACKET_LIMIT = 200_000
ACCURACY = 10_000
#: a sketch of whole columns takes every STEP-th of CHUNK sorted values of a task
STEP, CHUNK = 64, 100_000


def unpivot(df: DataFrame, columns: list[str], keep: list[str] | None = None,
            name: str = "column", value: str = "x") -> DataFrame:
    """One row per (row, column), values as double, NULLs dropped."""
    keep = list(keep or [])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value))
                                for c in columns]))
    return (df.select(*keep, pairs.alias("_p")).select(*keep, f"_p.{name}", f"_p.{value}")
            .where(F.col(value).isNotNull()))


def quantiles(df: DataFrame, columns: list[str], probs: list[float],
              by: list[str] | None = None, rows: int | None = None,
              exact_limit: int = EXACT_LIMIT, bracket_limit: int = BRACKET_LIMIT) -> DataFrame:
    """Rows ``(*by, column, n, q)`` with ``q`` an array in the order of ``probs``.

    Columns without values have no row.
    """
    by = list(by or [])
    rows = df.count() if rows is None else rows
    long = unpivot(df, columns, by)
    if rows <= exact_limit:
        return _aggregated(long, probs, by + ["column"])
    if not by:
        return _bracketed(long, probs, ["column"], bracket_limit, (df, columns))
    # only groups that are large themselves take the long way
    keys = by + ["column"]
    large = (long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > exact_limit)
             .select(*[F.col(k).alias(f"_l_{k}") for k in keys]))
    large = settled(large)
    same = [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys]
    return _bracketed(long.join(large, same, "left_semi"), probs, keys, bracket_limit).unionByName(
        _aggregated(long.join(large, same, "left_anti"), probs, keys))


def _aggregated(long: DataFrame, probs: list[float], keys: list[str]) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    return long.groupBy(*keys).agg(F.count("x").alias("n"), F.percentile("x", wanted).alias("q"))


def _values(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).drop_null().to_numpy(zero_copy_only=False)


def sorted_chunks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """Each column's sorted values of CHUNK rows at a time; a column without values is left out."""
    def chunk(batches: list[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
        for i, name in enumerate(columns if batches else ()):
            v = np.sort(np.concatenate([_values(b, i) for b in batches]))  # NaN comes last, as in Spark
            if len(v):
                yield name, v

    waiting, held = [], 0
    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held >= CHUNK:
            yield from chunk(waiting)
            waiting, held = [], 0
    yield from chunk(waiting)


def _sketched(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column and chunk of rows a row ``column, n, lo, hi`` and rows with every STEP-th of the sorted values in ``x``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, v in sorted_chunks(batches, columns):
            x = v[min(STEP, len(v)) // 2::STEP]
            rest = [None] * len(x)
            yield pa.RecordBatch.from_arrays([
                pa.repeat(name, len(x) + 1), pa.array([len(v), *rest], pa.int64()), pa.array([v[0], *rest], pa.float64()),
                pa.array([v[-1], *rest], pa.float64()), pa.array([None, *x], pa.float64())], ["column", "n", "lo", "hi", "x"])

    return doubles(df, columns).mapInArrow(run, "column string, n long, lo double, hi double, x double")


def doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def _looked_up(df: DataFrame, columns: list[str], wanted: list[tuple]) -> DataFrame:
    """``column, pi, below, inside, x, c`` for brackets ``(column, n, lo, hi, pi, p)`` of whole columns: per chunk how many
    values are below a bracket and in it, and a row for each different value in it with its count ``c``."""
    asked: dict[str, list[tuple]] = {}
    for name, _, lo, hi, pi, _ in wanted:
        asked.setdefault(name, []).append((pi, lo, hi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, v in sorted_chunks(batches, columns):
            for pi, lo, hi in asked.get(name, ()):
                # NaN is greater than any number, here as in Spark
                below, end = np.searchsorted(v, lo, "left"), np.searchsorted(v, hi, "right")
                part = v[below:end]
                x, c = np.unique(part, return_counts=True)
                n = len(x)
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(name, n + 1), pa.repeat(pa.scalar(pi, pa.int32()), n + 1),
                    pa.concat_arrays([pa.array([below], pa.int64()), pa.nulls(n, pa.int64())]),
                    pa.concat_arrays([pa.array([len(part)], pa.int64()), pa.nulls(n, pa.int64())]),
                    pa.concat_arrays([pa.nulls(1, pa.float64()), pa.array(x, pa.float64())]),
                    pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(c, pa.int64())])],
                    ["column", "pi", "below", "inside", "x", "c"])

    return doubles(df, columns).mapInArrow(run, "column string, pi int, below long, inside long, x double, c long")


def _bracketed(long: DataFrame, probs: list[float], keys: list[str], limit: int,
               wide: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """``wide`` is the table that ``long`` lists, where its columns are wanted as a whole: its values are compared column
    by column, and only those in a bracket get rows."""
    spark = long.sparkSession
    # the first pass brackets every rank already; a bracket that misses its rank is widened below
    slack = 3.0 / ACCURACY + (1.5 * STEP / CHUNK if wide else 0.0)
    points = sorted({min(max(p + side * slack, 0.0), 1.0) for p in probs for side in (-1, 1)})
    sketch = F.percentile_approx("x", F.array(*[F.lit(p) for p in points]), ACCURACY).alias("s")
    if wide:
        facts = _sketched(*wide).groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), sketch)
    else:
        facts = long.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), sketch)
    ranks = F.explode(F.array(*[F.struct(
        F.lit(i).alias("pi"), F.lit(float(p)).alias("p"), F.lit(points.index(max(p - slack, 0.0))).alias("a"),
        F.lit(points.index(min(p + slack, 1.0))).alias("b")) for i, p in enumerate(probs)]))
    targets = facts.select("*", ranks.alias("_r")).select(
        *keys, "n", "lo", "hi", "_r.pi", "_r.p", F.get("s", F.col("_r.a")).alias("_a"), F.get("s", F.col("_r.b")).alias("_b"))
    found = targets.collect()  # large groups x columns x probabilities
    if not found:
        return long.limit(0).select(*keys, F.lit(0).cast("long").alias("n"),
                                    F.array().cast("array<double>").alias("q"))
    schema = targets.drop("_a", "_b").schema
    ends = {tuple(r[k] for k in [*keys, "pi"]): (r["lo"], r["hi"]) for r in found}
    wanted = [(*[r[k] for k in keys], r["n"], r["_a"], r["_b"], r["pi"], r["p"]) for r in found]
    while True:
        current = spark.createDataFrame(wanted, schema)
        if wide:
            seen = _looked_up(*wide, wanted)
            inside = seen.where("x IS NOT NULL").drop("below", "inside").join(
                F.broadcast(current.withColumnsRenamed({"column": "_column", "pi": "_pi"})),
                (F.col("column") == F.col("_column")) & (F.col("pi") == F.col("_pi"))).drop("_column", "_pi")
            below = seen.groupBy(*keys, "pi").agg(F.sum("below").alias("below"), F.sum("inside").alias("inside"),
                                                  F.approx_count_distinct("x").alias("values"))
        else:
            inside, below = _inside(long, current, keys).withColumn("c", F.lit(1)), _below(long, current, keys)
        counts = {tuple(r[k] for k in [*keys, "pi"]): r for r in below.collect()}
        missed = _widened(wanted, counts, ends, len(keys))
        if missed != wanted:
            wanted = missed
            continue
        if max(r["values"] for r in counts.values()) <= limit:
            break
        narrowed = _narrow(inside, current, counts, keys)
        if narrowed == wanted:
            break
        wanted = narrowed
    kinds = [f for f in schema.fields if f.name in [*keys, "pi"]] + [T.StructField("below", T.LongType())]
    below = spark.createDataFrame([(*k, r["below"]) for k, r in counts.items()], T.StructType(
        sorted(kinds, key=lambda f: [*keys, "pi", "below"].index(f.name))))
    order = Window.partitionBy(*keys, "pi").orderBy("x")
    steps = (inside.groupBy(*keys, "pi", "p", "n", "x").agg(F.sum("c").alias("c"))
             .withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .join(below.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "pi"]], "below"),
                   [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("pi") == F.col("_pi")])
             .withColumn("upto", F.col("upto") + F.col("below")))
    spot = (F.col("n") - 1) * F.col("p")
    picked = steps.groupBy(*keys, "pi", "p", "n").agg(
        F.min(F.when(F.col("upto") > F.floor(spot), F.col("x"))).alias("v0"),
        F.min(F.when(F.col("upto") > F.ceil(spot), F.col("x"))).alias("v1"))
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * (spot - F.floor(spot))
    return (picked.groupBy(*keys, "n")
            .agg(F.sort_array(F.collect_list(F.struct("pi", value.alias("v")))).alias("_s"))
            .select(*keys, "n", F.col("_s.v").alias("q")))


def _matched(long: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    side = targets.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "lo", "hi", "pi", "p")
    return long.join(side, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(
        *[f"_{k}" for k in keys])


def _between() -> Column:
    return F.col("x").between(F.col("lo"), F.col("hi"))


def _inside(long: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    return _matched(long, targets, keys).where(_between())


def _below(long: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    return _matched(long, targets, keys).groupBy(*keys, "pi").agg(
        F.count_if(F.col("x") < F.col("lo")).alias("below"),
        F.count_if(_between()).alias("inside"),
        F.approx_count_distinct(F.when(_between(), F.col("x"))).alias("values"))


def _widened(wanted: list[tuple], counts: dict, ends: dict, width: int) -> list[tuple]:
    """Brackets that do not hold their rank go from the least to the greatest value."""
    out = []
    for row in wanted:
        key, (n, pi, p) = row[:width], (row[width], row[width + 3], row[width + 4])
        at, spot = counts[(*key, pi)], (n - 1) * p
        held = at["below"] <= math.floor(spot) and at["below"] + at["inside"] > math.ceil(spot)
        out.append(row if held else (*key, n, *ends[(*key, pi)], pi, p))
    return out


def _narrow(inside: DataFrame, current: DataFrame, counts: dict, keys: list[str]) -> list[tuple]:
    """New brackets around each wanted rank; the sketch errs by at most one part in ACCURACY."""
    slack, grid = 3.0 / ACCURACY, {}
    for row in current.collect():
        at = counts[tuple(row[k] for k in [*keys, "pi"])]
        spot = (row["n"] - 1) * row["p"] - at["below"]
        low = max(0.0, (spot - 1) / at["inside"] - slack)
        high = min(1.0, (spot + 2) / at["inside"] + slack)
        grid[tuple(row[k] for k in [*keys, "pi"])] = (low, high, row)
    points = sorted({p for low, high, _ in grid.values() for p in (low, high)})
    each = inside.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("c").cast("int"))))
    sketch = each.groupBy(*keys, "pi").agg(
        F.percentile_approx("x", F.array(*[F.lit(p) for p in points]), ACCURACY).alias("s"))
    out = []
    found = {tuple(r[k] for k in [*keys, "pi"]): r["s"] for r in sketch.collect()}
    for key, (low, high, row) in grid.items():
        values = found[key]
        lo = row["lo"] if low == 0.0 else values[points.index(low)]
        hi = row["hi"] if high == 1.0 else values[points.index(high)]
        out.append(tuple(row[k] for k in keys) + (row["n"], lo, hi, row["pi"], row["p"]))
    return out


def quantile_values(df: DataFrame, columns: list[str], probs: list[float],
                    rows: int | None = None, **limits) -> dict[str, list[float]]:
    """The same as plain numbers per column, for fitted thresholds (columns x probs scalars)."""
    found = {r["column"]: r["q"] for r in quantiles(df, columns, probs, None, rows, **limits).collect()}
    return {c: list(found[c]) if found.get(c) else [None] * len(probs) for c in columns}
