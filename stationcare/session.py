"""Session helpers: shared folder, staged tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="stationcare-")
    return _local_dirs[sc.applicationId]


def staged(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, keeps columnar pruning."""
    path = f"{shared_dir(df.sparkSession)}/staged/{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def free_shuffles(spark: SparkSession) -> None:
    """Let go of shuffle files of finished jobs.

    Spark deletes them once the driver's JVM has collected what referred to them, which may be long after a large
    step; worth asking for behind a staged table whose shuffles were large.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no result reads any more."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
