"""Remaining-useful-life evaluation on a table of truths and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.operators.ordered import in_blocks, with_index
from stationcare.operators.tables import melted


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def error_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                  by: list[str] | None = None, bands: list[int] | None = None) -> DataFrame:
    """MAE, RMSE, R2, accuracy bands, prognostic horizon and alpha-lambda accuracy, in one pass."""
    by, bands = list(by or []), bands or S.ACCURACY_BANDS
    y, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    e = F.abs(y - p)
    far = y > S.HORIZON_DAYS
    wide = df.groupBy(*by).agg(
        F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"),
        F.var_pop(y).alias("var"), F.count(e).alias("n"),
        *[_share(e <= b).alias(f"band_{b}") for b in bands],
        F.coalesce(F.avg(F.when(far, (e <= S.HORIZON_DAYS).cast("double"))), F.lit(0.0)).alias("horizon"),
        F.count_if(far).alias("horizon_n"),
        _share(e / F.greatest(y, F.lit(0.1)) <= S.ALPHA).alias("alpha"),
        _share(e <= S.LAMBDA_DAYS).alias("lambda"))
    spread = F.col("var") * F.col("n")
    r2 = (F.when(spread > 0, 1.0 - F.try_divide(F.col("sse"), spread))
          .when(F.col("sse") == 0, 1.0).when(F.col("n") > 0, 0.0))
    return melted(wide, by, {
        "MAE": F.col("mae"), "RMSE": F.col("rmse"), "R2": r2,
        **{f"accuracy_band_{b}d": F.col(f"band_{b}") for b in bands},
        "prognostic_horizon": F.col("horizon"), "prognostic_horizon_samples": F.col("horizon_n"),
        "alpha_accuracy": F.col("alpha"), "lambda_accuracy": F.col("lambda"),
        "alpha_parameter": F.lit(S.ALPHA), "lambda_parameter": F.lit(S.LAMBDA_DAYS)})


def band_mae(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
             by: list[str] | None = None) -> DataFrame:
    """MAE by how near the failure is; bands without rows are absent."""
    by = list(by or [])
    y = F.col(y_true)
    band = None
    for low, high, name in S.MAE_BANDS:
        inside = (y >= low) & (y < high) if high is not None else y >= low
        band = F.when(inside, name) if band is None else band.when(inside, name)
    rows = df.select(*by, F.concat(F.lit("MAE_"), band).alias("metric"),
                     F.abs(y - F.col(y_pred)).cast("double").alias("e")).where(F.col("metric").isNotNull())
    return rows.groupBy(*by, "metric").agg(F.avg("e").alias("value"))


def directional_accuracy(df: DataFrame, order_by: list[str], y_true: str = "y_true",
                         y_pred: str = "y_pred", rows: int | None = None,
                         by: list[str] | None = None) -> DataFrame:
    """Share of steps on which truth and prediction both fall or both do not; 0 below two rows."""
    by = list(by or [])
    rows = df.count() if rows is None else rows
    numbered = with_index(df.select(*by, *order_by, y_true, y_pred), order_by, by=by, rows=rows)
    blocks = in_blocks(numbered, rows, back=1, by=by)
    down = {c: F.coalesce(F.col(c) - F.lag(c, 1).over(blocks.window) < 0, F.lit(False))
            for c in (y_true, y_pred)}
    steps = blocks.with_columns({"_a": down[y_true], "_b": down[y_pred]}).result()
    agree = F.when(F.col("row_index") > 1, (F.col("_a") == F.col("_b")).cast("double"))
    return steps.groupBy(*by).agg(F.coalesce(F.avg(agree), F.lit(0.0)).alias("value")).select(
        *by, F.lit("directional_accuracy").alias("metric"), "value")


def rul_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                order_by: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    out = error_metrics(df, y_true, y_pred, by).unionByName(band_mae(df, y_true, y_pred, by))
    if order_by:
        out = out.unionByName(directional_accuracy(df, order_by, y_true, y_pred, by=by))
    return out


def error_histogram(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                    bins: int = 30) -> DataFrame:
    """Prediction errors in equal-width bins, empty bins left out, with the mean error."""
    e = (F.col(y_pred) - F.col(y_true)).cast("double")
    errors = df.select(e.alias("e")).where(F.col("e").isNotNull())
    facts = errors.agg(F.struct(F.min("e").alias("lo"), F.max("e").alias("hi"), F.avg("e").alias("mean")))
    wide = errors.withColumn("_f", facts.scalar())
    lo, hi = F.col("_f.lo"), F.col("_f.hi")
    spot = F.floor(F.try_divide((F.col("e") - lo) * bins, hi - lo)).cast("int") + 1
    bin_ = F.when(hi > lo, F.least(spot, F.lit(bins))).otherwise(1)
    return (wide.groupBy(bin_.alias("bin"), "_f").agg(F.count(F.lit(1)).alias("n"))
            .select("bin", "n", (lo + (F.col("bin") - 1) * (hi - lo) / bins).alias("bin_start"),
                    F.col("_f.mean").alias("mean_error")))
