"""Profiling: shares, quality, time, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.functions.clock import day_name
from stationcare.operators.ordered import in_blocks, with_index
from stationcare.operators.quantiles import quantiles, unpivot
from stationcare.roles import columns_of_kind, is_numeric
from stationcare.session import staged


REST = "(rest)"


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: name, type, kind."""
    kinds = {c: k for k, names in columns_of_kind(df).items() for c in names}
    rows = [(f.name, f.dataType.simpleString(), kinds[f.name]) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, type string, kind string")


def kind_counts(df: DataFrame) -> dict[str, int]:
    return {k: len(names) for k, names in columns_of_kind(df).items()}


def class_share(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts and percentages, most frequent first, names breaking ties; ``top`` folds the rest into one last row."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(column))
    shares = counts.withColumn("share_pct", 100.0 * F.col("n") / total.scalar())
    if top is None:
        return shares.orderBy(F.desc("n"), column)
    first = shares.orderBy(F.desc("n"), column).limit(top)
    seen = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("seen"))
    rest = (df.agg(F.count(column).alias("_all")).withColumn("_seen", seen.scalar())
            .where(F.col("_all") > F.col("_seen"))
            .select(F.lit(REST).alias(column), (F.col("_all") - F.col("_seen")).alias("n"),
                    (100.0 * (F.col("_all") - F.col("_seen")) / F.col("_all")).alias("share_pct")))
    named = first.withColumn(column, F.col(column).cast("string"))
    return (named.withColumn("_last", F.lit(0)).unionByName(rest.withColumn("_last", F.lit(1)))
            .orderBy("_last", F.desc("n"), column).drop("_last"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, min, max, mean, sample standard deviation per column, in one pass."""
    wide = df.agg(*[a for c in columns for a in (
        F.count(c).alias(f"n_{c}"), F.min(F.col(c).cast("double")).alias(f"lo_{c}"),
        F.max(F.col(c).cast("double")).alias(f"hi_{c}"),
        F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"))])
    return _stacked(wide, columns, {"n": "n", "lo": "min_value", "hi": "max_value",
                                    "mean": "mean_value", "std": "std_value"})


def _stacked(wide: DataFrame, columns: list[str], names: dict[str, str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[
        F.col(f"{short}_{c}").alias(long) for short, long in names.items()]) for c in columns]))
    return wide.select(rows.alias("_r")).select("_r.*")


def missing_report(df: DataFrame, flag_above: float = 5.0) -> DataFrame:
    """Missing values per column, their percentage, and a flag above 5 %."""
    wide = df.agg(F.count(F.lit(1)).alias("_all"),
                  *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("missing"))
                               for c in df.columns]))
    pct = F.round(F.try_divide(100.0 * F.col("_r.missing"), F.col("_all")), 2)
    return wide.select("_all", rows.alias("_r")).select(
        "_r.column", "_r.missing", pct.alias("missing_pct"),
        F.coalesce(pct > flag_above, F.lit(False)).alias("flagged"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier row."""
    counts = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return counts.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicates"))


def iqr_bounds(df: DataFrame, columns: list[str], factor: float = S.IQR_FACTOR,
               rows: int | None = None) -> DataFrame:
    """Quartile fences per column; the outer fences lie one more IQR out."""
    q1, q3 = F.col("q")[0], F.col("q")[1]
    iqr = q3 - q1
    return quantiles(df, columns, [0.25, 0.75], rows=rows).select(
        "column", "n", q1.alias("q1"), q3.alias("q3"),
        (q1 - factor * iqr).alias("low"), (q3 + factor * iqr).alias("high"),
        (q1 - (factor + 1.0) * iqr).alias("far_low"), (q3 + (factor + 1.0) * iqr).alias("far_high"))


def iqr_report(df: DataFrame, columns: list[str], rows: int | None = None) -> DataFrame:
    """Outliers, their percentage, distinct values and an OK flag per sensor."""
    rows = df.count() if rows is None else rows
    values = unpivot(df, columns)
    fences = iqr_bounds(df, columns, rows=rows).select(F.col("column").alias("_c"), "low", "high")
    # value counts first: repeated readings shrink before any shuffle
    counted = values.groupBy("column", "x").agg(F.count(F.lit(1)).alias("c"))
    marked = counted.join(F.broadcast(fences), F.col("column") == F.col("_c"))
    out = marked.groupBy("column").agg(
        F.sum(F.when((F.col("x") < F.col("low")) | (F.col("x") > F.col("high")), F.col("c"))
              .otherwise(0)).alias("outliers"),
        F.count(F.lit(1)).alias("distinct_values"))
    pct = 100.0 * F.col("outliers") / F.lit(float(max(rows, 1)))
    return out.select("column", "outliers", pct.alias("outlier_pct"), "distinct_values",
                      ((pct < 5) & (F.col("distinct_values") > 10)).alias("ok"))


def time_gaps(df: DataFrame, timestamp: str, order_by: list[str], rows: int | None = None) -> DataFrame:
    """Seconds since the previous row, NULL on the first."""
    rows = df.count() if rows is None else rows
    micros = F.unix_micros(F.col(timestamp).cast("timestamp"))
    numbered = with_index(df.withColumn("_us", micros), order_by, rows=rows)
    blocks = in_blocks(numbered, rows, back=1)
    gap = (F.col("_us") - F.lag("_us", 1).over(blocks.window)) / 1e6
    return blocks.with_columns({"gap_seconds": gap}).result("_us")


def time_profile(df: DataFrame, timestamp: str, order_by: list[str],
                 rows: int | None = None) -> DataFrame:
    """Span, median interval, frequency, modal interval, gaps over twice the mode, largest gap."""
    rows = df.count() if rows is None else rows
    gaps = time_gaps(df, timestamp, order_by, rows)
    # one global sort; everything else reads the gaps it left
    known = staged(gaps.select("gap_seconds").where(F.col("gap_seconds").isNotNull()), "gaps")
    counted = known.groupBy("gap_seconds").agg(F.count(F.lit(1)).alias("c"))
    mode = counted.agg(F.max_by("gap_seconds", F.struct("c", -F.col("gap_seconds"))))
    median = quantiles(known, ["gap_seconds"], [0.5], rows=rows).select(F.col("q")[0])
    large = F.col("gap_seconds") > 2 * F.col("mode_seconds")
    over = counted.withColumn("mode_seconds", mode.scalar()).agg(F.struct(
        F.coalesce(F.sum(F.when(large, F.col("c"))), F.lit(0)).alias("large_gaps"),
        F.max(F.when(large, F.col("gap_seconds"))).alias("max_gap_seconds")))
    us = F.unix_micros(F.col(timestamp).cast("timestamp"))
    span = df.agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    one = span.withColumns({"median_seconds": median.scalar(), "mode_seconds": mode.scalar(),
                            "_over": over.scalar()})
    return one.select(
        "first_us", "last_us", ((F.col("last_us") - F.col("first_us")) / 1e6).alias("span_seconds"),
        "median_seconds",
        F.when(F.col("median_seconds") > 0, 1.0 / F.col("median_seconds")).otherwise(0.0)
        .alias("frequency_hz"), "mode_seconds", "_over.large_gaps", "_over.max_gap_seconds")


def hourly_target(df: DataFrame, timestamp: str, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull()).groupBy(F.hour(timestamp).alias("hora"), target).agg(
        F.count(F.lit(1)).alias("n"))


def daily_target(df: DataFrame, timestamp: str, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull()).groupBy(
        day_name(F.col(timestamp)).alias("dia_semana"), target).agg(F.count(F.lit(1)).alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of every column pair ``a`` before ``b``; NULL if either is constant.

    Per-partition matrices of sums, added up per pair: one way for any number of columns.
    """
    import numpy as np

    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    centre = [means[c] or 0.0 for c in columns]
    at_a, at_b = np.triu_indices(len(columns), 1)

    def sums(batches):
        n = np.zeros((len(centre), len(centre)))
        sx, sxx, sxy = n.copy(), n.copy(), n.copy()
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan) - centre
            known = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            n += known.T @ known
            sx += x.T @ known
            sxx += (x * x).T @ known
            sxy += x.T @ x
        import pandas as pd
        yield pd.DataFrame({
            "a_pos": at_a.astype("int32"), "b_pos": at_b.astype("int32"), "n": n[at_a, at_b],
            "sx": sx[at_a, at_b], "sy": sx[at_b, at_a], "sxx": sxx[at_a, at_b],
            "syy": sxx[at_b, at_a], "sxy": sxy[at_a, at_b]})

    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    parts = doubles.mapInPandas(sums, "a_pos int, b_pos int, n double, sx double, sy double, "
                                      "sxx double, syy double, sxy double")
    total = parts.groupBy("a_pos", "b_pos").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    tiny = 1e-12
    steady = (vx <= tiny * F.col("sxx")) | (vy <= tiny * F.col("syy"))
    names = F.array(*[F.lit(c) for c in columns])
    return total.select(
        F.get(names, F.col("a_pos")).alias("a"), F.get(names, F.col("b_pos")).alias("b"),
        "a_pos", "b_pos",
        F.when(~steady, F.try_divide(cov, F.sqrt(vx * vy))).alias("r"))


def top_correlations(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    ranked = correlations(df, columns).where(F.col("r").isNotNull())
    return (ranked.withColumn("abs_r", F.abs("r"))
            .orderBy(F.desc(F.round("abs_r", 9)), "a", "b").limit(n).drop("a_pos", "b_pos"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]
