"""Report tables: class mix over time, sensor spread, costs, model choice."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.functions.states import is_critical
from stationcare.operators.class_metrics import confusion, per_class
from stationcare.operators.profile import class_share
from stationcare.operators.quantiles import quantiles
from stationcare.sources.sinks import append_rows


def relative_week(df: DataFrame, timestamp: str, name: str = "semana_relativa",
                  calendar: bool = False) -> DataFrame:
    """ISO week counted from the first one; ``calendar`` keeps counting across a year end."""
    ts = F.col(timestamp).cast("timestamp")
    if calendar:
        day = F.unix_date(F.date_trunc("week", ts).cast("date"))
        first = df.agg(F.min(day))
        return df.withColumn(name, F.floor((day - first.scalar()) / 7).cast("int") + 1)
    first = df.agg(F.min(F.weekofyear(ts)))
    return df.withColumn(name, F.weekofyear(ts) - first.scalar() + 1)


def weekly_normal(df: DataFrame, week: str, label: str, normal: str = S.NORMAL) -> DataFrame:
    """Percentage of normal rows per week, with the straight-line trend over weeks."""
    weekly = df.where(F.col(week).isNotNull()).groupBy(week).agg(
        (100.0 * F.avg(F.coalesce(F.col(label) == normal, F.lit(False)).cast("double"))).alias("normal_pct"))
    x, y = F.col(week).cast("double"), F.col("normal_pct")
    fit = weekly.agg(F.struct(F.try_divide(F.covar_pop(x, y), F.var_pop(x)).alias("slope"),
                              F.avg(x).alias("mx"), F.avg(y).alias("my")))
    line = weekly.withColumn("_f", fit.scalar())
    return line.select(week, "normal_pct", F.col("_f.slope").alias("slope"),
                       (F.col("_f.my") - F.col("_f.slope") * F.col("_f.mx")).alias("intercept"))


def state_by_hour(df: DataFrame, timestamp: str, label: str, top: int = 8) -> DataFrame:
    """Share of each of the most frequent states within each hour of the day."""
    counts = df.where(F.col(label).isNotNull()).groupBy(
        F.hour(timestamp).alias("hora"), label).agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy(label).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), label).limit(top)
    kept = counts.join(main.select(label), label, "left_semi")
    return kept.withColumn("share_pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("hora")))


def box_stats(df: DataFrame, sensor: str, label: str, keywords: list[str] | None = None,
              rows: int | None = None) -> DataFrame:
    """Quartiles and whiskers of a sensor for critical and other rows."""
    flagged = df.select(is_critical(F.col(label), keywords, keywords=True).alias("es_critico"),
                        F.col(sensor).cast("double").alias("x")).where(F.col("x").isNotNull())
    q = F.col("q")
    box = quantiles(flagged, ["x"], [0.25, 0.5, 0.75], by=["es_critico"], rows=rows).select(
        F.col("es_critico").alias("_k"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    joined = flagged.join(F.broadcast(box), F.col("es_critico") == F.col("_k"))  # two rows
    return joined.groupBy("es_critico", "q1", "median", "q3").agg(
        F.min(F.when(near, F.col("x"))).alias("whisker_low"),
        F.max(F.when(near, F.col("x"))).alias("whisker_high"), F.count(F.lit(1)).alias("n"))


def rul_by_week(df: DataFrame, week: str, rul: str, rows: int | None = None) -> DataFrame:
    """RUL quartiles and row count per week."""
    q = F.col("q")
    return quantiles(df.where(F.col(rul).isNotNull()), [rul], [0.25, 0.5, 0.75], by=[week], rows=rows).select(
        week, "n", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"))


def rul_extremes(df: DataFrame, ruls: list[str]) -> DataFrame:
    return df.agg(F.min(F.array_min(F.array(*ruls))).alias("rul_min"), F.max(F.array_max(F.array(*ruls))).alias("rul_max"))


def prediction_summary(df: DataFrame, prediction: str) -> DataFrame:
    shares = class_share(df, prediction)
    return shares.select(prediction, "n", F.round("share_pct", 2).alias("pct"))


def prediction_examples(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    first = df.orderBy(*order_by).limit(n).withColumn("end", F.lit("first"))
    last = df.orderBy(*[F.desc(c) for c in order_by]).limit(n).withColumn("end", F.lit("last"))
    return first.unionByName(last)


def model_comparison(metrics: DataFrame, metric: str = "f1_macro", target: float = S.TARGET_F1) -> DataFrame:
    """Mean of one metric per model, its band, and whether it reaches the target."""
    mean = metrics.where(F.col("metric") == metric).groupBy("model").agg(F.avg("value").alias("value"))
    v = F.col("value")
    return mean.withColumns({
        "band": F.when(v > 0.7, "good").when(v > 0.5, "fair").otherwise("poor"),
        "meets_target": v >= target})


def mean_over_folds(metrics: DataFrame, by: list[str]) -> DataFrame:
    return metrics.groupBy(*by, "metric").agg(F.avg("value").alias("value"))


def best_models(metrics: DataFrame) -> DataFrame:
    """Best model per task: highest mean macro F1, lowest mean MAE; fallbacks where nothing is known."""
    mean = metrics.where(F.col("value").isNotNull()).groupBy("task", "metric", "model").agg(
        F.avg("value").alias("v"))
    wanted = (((F.col("task") == "classification") & (F.col("metric") == "f1_macro"))
              | ((F.col("task") == "rul") & (F.col("metric") == "MAE")))
    score = F.when(F.col("task") == "rul", -F.col("v")).otherwise(F.col("v"))
    chosen = (mean.where(wanted).withColumn("_s", score).groupBy("task")
              .agg(F.min_by("model", F.struct(-F.col("_s"), F.col("model"))).alias("model"),
                   F.max_by("v", F.col("_s")).alias("value")))
    tasks = metrics.sparkSession.createDataFrame(list(S.FALLBACK_MODELS.items()), "task string, fallback string")
    return (F.broadcast(tasks).join(chosen, "task", "left")
            .select("task", F.coalesce("model", "fallback").alias("model"), "value"))


def classification_costs(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                         critical: list[str] | None = None) -> DataFrame:
    """One-vs-rest cost of the critical classes, with 30 days of monitoring."""
    classes = per_class(confusion(df, y_true, y_pred, zeros=False))
    mine = F.col("label").isin(critical or S.CRITICAL_CLASSES)
    fp = F.coalesce(F.sum(F.when(mine, F.col("predicted") - F.col("hits"))), F.lit(0)) * S.FALSE_POSITIVE_COST
    fn = F.coalesce(F.sum(F.when(mine, F.col("support") - F.col("hits"))), F.lit(0)) * S.FALSE_NEGATIVE_COST
    watch = S.MONITORING_DAYS * S.MONITORING_PER_DAY
    return classes.agg(fp.alias("false_positive_cost"), fn.alias("false_negative_cost")).withColumns({
        "monitoring_cost": F.lit(watch),
        "total_cost": F.col("false_positive_cost") + F.col("false_negative_cost") + watch})


def rul_business_case() -> dict[str, Column]:
    """Yearly benefit, net benefit and payback of the RUL system."""
    gross = (S.ANNUAL_MAINTENANCE * S.PLANNED_SAVINGS
             + S.ANNUAL_MAINTENANCE * S.INVENTORY_SHARE * S.INVENTORY_SAVINGS
             + S.ANNUAL_DOWNTIME * S.DOWNTIME_SAVINGS)
    net = gross - S.UPKEEP_COST
    start = S.DEVELOPMENT_COST + S.INTEGRATION_COST + S.TRAINING_COST
    payback = start / net if net > 0 else float("inf")
    return {"total_annual_benefits": F.lit(gross), "net_annual_benefit": F.lit(net),
            "payback_period_years": F.lit(payback)}


def business_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Costs, business case and recommendations in one row."""
    costs = classification_costs(df, y_true, y_pred).withColumns(rul_business_case())
    misses = F.col("false_negative_cost") > 5 * F.col("false_positive_cost")
    return costs.withColumn("recommendations", F.array(
        F.when(misses, "raise recall on critical classes").otherwise("balance precision and recall"),
        F.when(F.col("payback_period_years") < 2, "roll out the RUL system").otherwise("improve the RUL model"),
        F.lit("validate on production data")))


def recommendations(report: DataFrame) -> DataFrame:
    return report.select(F.posexplode("recommendations").alias("position", "recommendation"))


def write_reported(before: DataFrame, after: DataFrame, path: str, manifest: str | None = None) -> DataFrame:
    """Write ``after`` and report on that very write: rows, seconds, bytes, columns, NULLs of each new column.

    Everything counted is observed while the rows go by, so there is no second scan. Lines are ``kind, name, value``;
    with ``manifest`` they are also appended there, under the path that was written.
    """
    spark = after.sparkSession
    new = [c for c in after.columns if c not in set(before.columns)]
    seen = Observation()
    counted = after.observe(seen, F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(new)])
    start = time.monotonic()
    counted.write.mode("overwrite").parquet(path)
    seconds = time.monotonic() - start
    found = seen.get
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(where).getLength()
    lines = [("rows", "", float(found["rows"])), ("seconds", "", seconds), ("bytes", "", float(size)),
             ("rows_per_second", "", found["rows"] / seconds if seconds > 0 else None),
             ("columns", "", float(len(after.columns))), ("columns_added", "", float(len(new)))]
    lines += [("nulls", c, float(found[f"nulls_{i}"])) for i, c in enumerate(new)]
    report = spark.createDataFrame(lines, "kind string, name string, value double")
    if manifest is not None:
        append_rows(report.withColumn("path", F.lit(path)), manifest)
    return report
