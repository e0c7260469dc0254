"""Writing results: tables, stage checkpoints, predictions, manifest, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ["features", "classification", "rul"]

MANIFEST = ("id long, fecha_generacion string, version string, total_muestras long, "
            "configuracion_json string, metricas_json string, es_enriquecido boolean, "
            "config_enriquecimiento_json string")

METRICS = ("session string, task string, component string, model string, fold int, "
           "metric string, value double")


def replace_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def replace_database_table(df: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    df.write.mode("overwrite").jdbc(url, table, properties=properties or {})


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """Train and test in one write, as ``split=train`` and ``split=test``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_scores(df: DataFrame, path: str, session: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/session={session}")


def save_predictions(df: DataFrame, path: str, task: str, model: str, session: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/task={task}/model={model}/session={session}")


def load_predictions(spark: SparkSession, path: str, task: str, model: str, session: str) -> DataFrame:
    return spark.read.parquet(f"{path}/task={task}/model={model}/session={session}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished write is there, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(marker))


class Checkpoints:
    """Stage outputs of a session, written once and read back on later runs."""

    def __init__(self, spark: SparkSession, root: str, session: str):
        self.spark, self.root, self.session = spark, root.rstrip("/"), session

    def path(self, phase: str) -> str:
        return f"{self.root}/session={self.session}/phase={phase}"

    def has(self, phase: str) -> bool:
        return path_exists(self.spark, self.path(phase))

    def save(self, phase: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(phase))
        return self.load(phase)

    def load(self, phase: str) -> DataFrame:
        return self.spark.read.parquet(self.path(phase))

    def clear(self, phase: str) -> None:
        self._delete(self.path(phase))

    def clear_all(self) -> None:
        self._delete(f"{self.root}/session={self.session}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def stage(self, phase: str, build: Callable[[], DataFrame], force: str | None = None) -> DataFrame:
        """Reuse a finished stage unless ``force`` is ``all`` or names this stage."""
        if force not in ("all", phase) and self.has(phase):
            return self.load(phase)
        return self.save(phase, build())


def manifest_row(spark: SparkSession, run_id: int, date: str, version: str, rows: int,
                 config: dict, metrics: dict, enriched: bool | None = None,
                 enrichment: dict | None = None) -> DataFrame:
    """One run as a manifest row; settings and metrics become JSON text."""
    def text(values: dict | None):
        if values is None:
            return F.lit(None).cast("string")
        return F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in values.items()])) if values else F.lit("{}")

    base = spark.createDataFrame([(run_id, date, version, rows, enriched)],
                                 "id long, fecha_generacion string, version string, "
                                 "total_muestras long, es_enriquecido boolean")
    return base.select("id", "fecha_generacion", "version", "total_muestras",
                       text(config).alias("configuracion_json"), text(metrics).alias("metricas_json"),
                       "es_enriquecido", text(enrichment).alias("config_enriquecimiento_json"))


def publish_manifest(manifest: DataFrame, path: str) -> int:
    """Write the whole manifest as its next version; columns it does not have yet are NULL. Readers see whole versions."""
    version = manifest_version(manifest.sparkSession, path) + 1
    have = set(manifest.columns)
    columns = [part.strip().split(" ") for part in MANIFEST.split(",")]
    wide = manifest.select(*[F.col(n).cast(k).alias(n) if n in have else F.lit(None).cast(k).alias(n) for n, k in columns])
    wide.write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def manifest_version(spark: SparkSession, path: str) -> int:
    """Number of the last version whose write finished, 0 without any."""
    version = 0
    while path_exists(spark, f"{path}/version={version + 1}"):
        version += 1
    return version


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/version={manifest_version(spark, path)}")


def nested_setting(text: Column, where: str, kind: str) -> Column:
    """A value inside JSON settings, as ``$.a.b[0]``; NULL where the text or the place is none."""
    return F.try_variant_get(F.try_parse_json(text), where, kind)


def enriched_latest(manifest: DataFrame, enrichment: Column) -> DataFrame:
    """The manifest with the run of the largest id marked as enriched, with its settings as JSON."""
    last = F.col("id") == manifest.agg(F.max("id")).scalar()
    return manifest.withColumns({
        "es_enriquecido": F.when(last, True).otherwise(F.col("es_enriquecido")),
        "config_enriquecimiento_json": F.when(last, F.to_json(enrichment)).otherwise(F.col("config_enriquecimiento_json"))})


def latest_run(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.max_by(F.struct(*manifest.columns), F.col("id")).alias("_r")).select("_r.*")


def metrics_table(metrics: DataFrame, session: str, task: str, component: str = "-",
                  model: str = "-", fold: int | None = None) -> DataFrame:
    """``(metric, value)`` rows with their place in the session."""
    keep = [F.col(c) if c in metrics.columns else None for c in ("model", "fold")]
    return metrics.select(
        F.lit(session).alias("session"), F.lit(task).alias("task"), F.lit(component).alias("component"),
        (keep[0] if keep[0] is not None else F.lit(model)).alias("model"),
        (keep[1] if keep[1] is not None else F.lit(fold)).cast("int").alias("fold"), "metric", "value")


def metrics_view(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One column per metric."""
    return metrics.groupBy("session", "task", "component", "model").pivot("metric", names).agg(F.avg("value"))


def sessions(manifest: DataFrame) -> DataFrame:
    """Sessions of each task, newest name first, and the latest of them."""
    return manifest.groupBy("task").agg(
        F.sort_array(F.collect_set("session"), asc=False).alias("sessions"),
        F.max("session").alias("latest"))
