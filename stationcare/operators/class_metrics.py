"""Classifier evaluation on a table of truths and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.functions.states import critical_override, is_critical
from stationcare.operators.ordered import change_runs, with_index
from stationcare.operators.tables import melted
from stationcare.operators.quantiles import quantiles
from stationcare.session import staged


def confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
              by: list[str] | None = None, zeros: bool = True) -> DataFrame:
    """Counts per (true, predicted) label, empty cells included."""
    by = list(by or [])
    counts = df.groupBy(*by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))
    if not zeros:
        return counts
    labels = counts.groupBy(*by).agg(F.array_distinct(F.concat(
        F.collect_set("y_true"), F.collect_set("y_pred"))).alias("_l"))
    grid = labels.select(*by, "_l", F.explode("_l").alias("y_true")).select(
        *by, "y_true", F.explode("_l").alias("y_pred"))
    empty = grid.withColumn("n", F.lit(0).cast("long"))
    return counts.unionByName(empty).groupBy(*by, "y_true", "y_pred").agg(F.sum("n").alias("n"))


def per_class(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of each label, 0 where undefined."""
    by = list(by or [])
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"), hit.alias("hits")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits"))))
    totals = counts.select(*by, sides.alias("_s")).select(*by, "_s.*").groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    zero = F.lit(0.0)
    return totals.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), zero),
        "recall": F.coalesce(F.try_divide(F.col("hits"), F.col("support")), zero),
        "f1": F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), zero)})


def basic_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                  by: list[str] | None = None) -> DataFrame:
    """accuracy, macro and weighted F1, macro precision and recall."""
    by = list(by or [])
    classes = per_class(confusion(df, y_true, y_pred, by, zeros=False), by)
    wide = classes.groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"))
    names = ["accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro"]
    return melted(wide, by, {n: F.col(n) for n in names})


def critical_class_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                           critical: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of each critical class that occurs in the truth."""
    by = list(by or [])
    classes = per_class(confusion(df, y_true, y_pred, by, zeros=False), by)
    wanted = classes.where(F.col("label").isin(critical or S.CRITICAL_CLASSES) & (F.col("support") > 0))
    rows = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{m}_"), F.col("label")).alias("metric"),
                                        F.col(m).alias("value")) for m in ("precision", "recall", "f1")]))
    return wanted.select(*by, rows.alias("_m")).select(*by, "_m.*")


def cost_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                 critical: list[str] | None = None, keywords: bool = False,
                 by: list[str] | None = None,
                 miss_cost: float = S.FALSE_NEGATIVE_COST,
                 alarm_cost: float = S.FALSE_POSITIVE_COST) -> DataFrame:
    """Cost of missed critical rows and of false alarms."""
    by = list(by or [])
    counts = confusion(df, y_true, y_pred, by, zeros=False)
    truth, said = (is_critical(F.col(c), critical, keywords) for c in ("y_true", "y_pred"))
    wide = counts.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(truth & ~said, F.col("n"))), F.lit(0)).alias("missed"),
        F.coalesce(F.sum(F.when(~truth & said, F.col("n"))), F.lit(0)).alias("alarms"),
        F.sum("n").alias("n"))
    fn, fp = F.col("missed") * miss_cost, F.col("alarms") * alarm_cost
    return melted(wide, by, {
        "total_operational_cost": fn + fp,
        "cost_per_prediction": F.coalesce(F.try_divide(fn + fp, F.col("n")), F.lit(0.0)),
        "total_fp_cost": fp, "total_fn_cost": fn})


def ranked_classes(probabilities: Column, classes: list[str]) -> Column:
    """Class names by falling probability; the later class first on ties."""
    pairs = F.array(*[F.struct(F.get(probabilities, F.lit(i)).alias("p"), F.lit(i).alias("i"),
                               F.lit(c).alias("c")) for i, c in enumerate(classes)])
    return F.transform(F.sort_array(pairs, asc=False), lambda e: e["c"])


def precision_at_k(df: DataFrame, classes: list[str], y_true: str = "y_true",
                   probabilities: str = "proba", ks: list[int] | None = None,
                   critical: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Share of critical rows whose true class is among the k most probable."""
    by, ks = list(by or []), ks or S.TOP_K
    ranked = df.withColumn("_rank", ranked_classes(F.col(probabilities), classes))
    hard = is_critical(F.col(y_true), critical)
    hit = {k: F.array_contains(F.slice("_rank", 1, min(k, len(classes))), F.col(y_true)) for k in ks}
    wide = ranked.groupBy(*by).agg(*[
        F.coalesce(F.avg(F.when(hard, hit[k].cast("double"))), F.lit(0.0)).alias(f"k{k}") for k in ks])
    return melted(wide, by, {f"precision_at_{k}_critical": F.col(f"k{k}") for k in ks})


def _runs(df: DataFrame, order_by: list[str], y_true: str, y_pred: str, critical: list[str] | None,
          keywords: bool, rows: int | None, by: list[str]) -> DataFrame:
    """Critical and other runs in row order, each with the offset of its first critical prediction."""
    rows = df.count() if rows is None else rows
    numbered = with_index(df.select(
        *by, *order_by, is_critical(F.col(y_true), critical, keywords).alias("_t"),
        is_critical(F.col(y_pred), critical, keywords).alias("_p")), order_by, by=by, rows=rows)
    runs = change_runs(numbered, "_t", rows, by=by)
    return (runs.groupBy(*by, "run_id", "_t").agg(
        F.min("row_index").alias("first_index"), F.count(F.lit(1)).alias("run_rows"),
        F.min(F.when(F.col("_p"), F.col("row_index"))).alias("_hit"))
        .select(*by, "run_id", "_t", "first_index", "run_rows",
                (F.col("_hit") - F.col("first_index")).alias("delay")))


def detection_runs(df: DataFrame, order_by: list[str], y_true: str = "y_true", y_pred: str = "y_pred",
                   critical: list[str] | None = None, keywords: bool = False,
                   rows: int | None = None, by: list[str] | None = None) -> DataFrame:
    """One row per critical run: its length and the offset of the first critical prediction."""
    return _runs(df, order_by, y_true, y_pred, critical, keywords, rows, list(by or [])).where("_t").drop("_t")


def time_to_detection(df: DataFrame, order_by: list[str], y_true: str = "y_true",
                      y_pred: str = "y_pred", critical: list[str] | None = None,
                      keywords: bool = False, rows: int | None = None,
                      by: list[str] | None = None) -> DataFrame:
    """Mean and median delay and share of detected critical runs.

    No critical run: 0, 0, 1. None detected: infinite delays.
    """
    by = list(by or [])
    rows = df.count() if rows is None else rows
    # one row per run; the sort behind it is done once
    runs = staged(_runs(df, order_by, y_true, y_pred, critical, keywords, rows, by), "runs")
    late = F.when(F.col("_t"), F.col("delay"))
    facts = runs.groupBy(*by).agg(F.count_if("_t").alias("runs"), F.count(late).alias("found"),
                                  F.avg(late).alias("mean_delay"))
    median = quantiles(runs.where("_t"), ["delay"], [0.5], by=by)
    if by:
        side = median.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("q")[0].alias("median_delay"))
        wide = facts.join(side, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left")
    else:
        wide = facts.withColumn("median_delay", median.select(F.col("q")[0]).scalar())
    none, never = F.col("runs") == 0, F.lit(float("inf"))
    delay = {n: F.when(none, 0.0).otherwise(F.coalesce(F.col(n), never)) for n in ("mean_delay", "median_delay")}
    return melted(wide, by, {
        "avg_time_to_detection": delay["mean_delay"], "median_time_to_detection": delay["median_delay"],
        "detection_rate": F.when(none, 1.0).otherwise(F.try_divide(F.col("found"), F.col("runs")))})


def classification_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                           probabilities: str | None = None, classes: list[str] | None = None,
                           order_by: list[str] | None = None, critical: list[str] | None = None,
                           threshold: float = S.CRITICAL_PROBABILITY,
                           by: list[str] | None = None) -> DataFrame:
    """The full set as ``(*by, metric, value)``; probabilities switch on the critical override and top-k."""
    critical = critical or S.CRITICAL_CLASSES
    if probabilities and classes and critical[0] in classes:
        chance = F.get(F.col(probabilities), F.lit(classes.index(critical[0])))
        df = df.withColumn(y_pred, critical_override(F.col(y_pred), chance, critical[0], threshold))
    parts = [basic_metrics(df, y_true, y_pred, by), critical_class_metrics(df, y_true, y_pred, critical, by),
             cost_metrics(df, y_true, y_pred, critical, by=by)]
    if probabilities and classes:
        parts.append(precision_at_k(df, classes, y_true, probabilities, critical=critical, by=by))
    if order_by:
        parts.append(time_to_detection(df, order_by, y_true, y_pred, critical, by=by))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distribution_drift(df: DataFrame, week: str, label: str) -> DataFrame:
    """1 minus the Jensen-Shannon distance between week 1 and each later week."""
    known = df.where(F.col(label).isNotNull() & F.col(week).isNotNull())
    counts = known.groupBy(week, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(F.col(week).alias("_w")).agg(F.sum("n").alias("_t"))
    shares = counts.join(totals, F.col(week) == F.col("_w")).select(
        F.col(week).alias("w"), F.col(label).alias("c"), (F.col("n") / F.col("_t")).alias("p"))
    first = shares.where("w = 1").select("c", F.col("p").alias("p"))
    classes = shares.select("c").distinct()
    # a report table: at most 53 weeks
    weeks = shares.where("w <> 1").agg(F.collect_set("w"))
    lined = (classes.select("c", F.explode(weeks.scalar()).alias("w"))
             .join(first, "c", "left")
             .join(shares.select("w", "c", F.col("p").alias("q")), ["w", "c"], "left")
             .na.fill(0.0, ["p", "q"]))
    middle = (F.col("p") + F.col("q")) / 2.0

    def term(x: str) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / middle)).otherwise(0.0)

    divergence = F.greatest(F.lit(0.0), F.sum(term("p") + term("q")) / 2.0)
    return lined.groupBy(F.col("w").alias(week)).agg(
        (1.0 - F.coalesce(F.sqrt(divergence), F.lit(0.0))).alias("similarity"))
