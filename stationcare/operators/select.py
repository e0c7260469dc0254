"""Feature selection: median fill, variance, correlation, F scores, k best."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.operators.profile import correlations
from stationcare.operators.quantiles import quantile_values, unpivot


def medians(df: DataFrame, columns: list[str], rows: int | None = None) -> dict[str, float]:
    """Exact median per column; columns without values are left out."""
    found = quantile_values(df, columns, [0.5], rows=rows)
    return {c: q[0] for c, q in found.items() if q[0] is not None}


def fill_medians(df: DataFrame, fitted: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v))
                           for c, v in fitted.items() if c in df.columns})


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population variance per column; columns without values have no row.

    One row per value keeps the generated code small for any number of columns,
    and the sums still combine before the shuffle.
    """
    return unpivot(df, columns, name="feature").groupBy("feature").agg(F.var_pop("x").alias("variance"))


def keep_varying(df: DataFrame, columns: list[str],
                 threshold: float = S.VARIANCE_THRESHOLD) -> DataFrame:
    return variances(df, columns).withColumn(
        "kept", F.coalesce(F.col("variance") > threshold, F.lit(False)))


def correlated_columns(df: DataFrame, columns: list[str],
                       threshold: float = S.CORRELATION_THRESHOLD) -> DataFrame:
    """Columns with a too strong correlation to any earlier column."""
    return (correlations(df, columns).where(F.abs("r") > threshold)
            .select(F.col("b").alias("feature")).distinct())


def anova_f(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """One-way ANOVA F per feature, from one aggregate per class."""
    known = df.where(F.col(target).isNotNull())
    stats = unpivot(known, columns, [target], name="feature").groupBy("feature", target).agg(
        F.count("x").cast("double").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    folded = stats.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m")).alias("total"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"))
    between = F.col("squares") - F.col("total") * F.col("total") / F.col("n")
    ratio = F.try_divide(F.try_divide(between, F.col("k") - 1),
                         F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    return folded.select("feature", ratio.alias("f_score"))


def regression_f(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """F of a one-variable regression per feature."""
    pairs = unpivot(df.withColumn("_y", F.col(target).cast("double")).where(F.col("_y").isNotNull()),
                    columns, ["_y"], name="feature")
    r = F.try_divide(F.covar_pop("x", "_y"), F.stddev_pop("x") * F.stddev_pop("_y"))
    fitted = pairs.groupBy("feature").agg(r.alias("r"), F.count("x").cast("double").alias("n"))
    r2 = F.col("r") * F.col("r")
    return fitted.select("feature", (F.try_divide(r2, 1.0 - r2) * (F.col("n") - 2)).alias("f_score"))


def k_best(scores: DataFrame, columns: list[str], k: int = S.K_BEST) -> list[str]:
    """The k highest scores, in the original column order."""
    if k >= len(columns):
        return list(columns)
    found = {r["feature"]: r["f_score"] for r in scores.collect()}  # one row per column
    ranked = sorted(columns, key=lambda c: (found.get(c) is None, -(found.get(c) or 0.0),
                                            columns.index(c)))
    chosen = set(ranked[:k])
    return [c for c in columns if c in chosen]


@dataclass(frozen=True)
class Selection:
    """A fitted selector: what to keep, how to fill, and what was removed why."""

    columns: list[str]
    medians: dict[str, float]
    removed: dict[str, list[str]] = field(default_factory=dict)
    scores: dict[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return fill_medians(df, {c: v for c, v in self.medians.items() if c in self.columns})

    def report(self, df: DataFrame) -> DataFrame:
        rows = [("removed", why, float(len(gone))) for why, gone in sorted(self.removed.items())]
        top = sorted(self.scores.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
        rows += [("score", name, value) for name, value in top]
        return df.sparkSession.createDataFrame(rows, "kind string, name string, value double")


def fit_selection(df: DataFrame, columns: list[str], target: str, task: str = "classification",
                  k: int = S.K_BEST, variance: float = S.VARIANCE_THRESHOLD,
                  correlation: float = S.CORRELATION_THRESHOLD, rows: int | None = None) -> Selection:
    """Median fill, variance, correlation, then the k best by F score, over all rows."""
    rows = df.count() if rows is None else rows
    fitted = medians(df, columns, rows)
    filled = fill_medians(df, fitted)
    present = [c for c in columns if c in fitted]
    removed = {"all_missing": [c for c in columns if c not in fitted]}
    varying = {r["feature"] for r in keep_varying(filled, present, variance).where("kept").collect()}
    removed["variance"] = [c for c in present if c not in varying]
    left = [c for c in present if c in varying]
    # |r| above 1 cannot happen: the default keeps every column without a pass
    twins = ({r["feature"] for r in correlated_columns(filled, left, correlation).collect()}
             if correlation < 1.0 and len(left) > 1 else set())
    removed["correlation"] = [c for c in left if c in twins]
    left = [c for c in left if c not in twins]
    score = anova_f if task == "classification" else regression_f
    scored = {r["feature"]: r["f_score"] for r in score(filled, left, target).collect()} if left else {}
    ranked = sorted(left, key=lambda c: (scored.get(c) is None, -(scored.get(c) or 0.0), left.index(c)))
    chosen = set(ranked[:k])
    removed["k_best"] = [c for c in left if c not in chosen]
    kept = [c for c in left if c in chosen]
    return Selection(kept, fitted, removed, {c: v for c, v in scored.items() if v is not None})
