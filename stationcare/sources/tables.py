"""Reading the station's tables: files, databases, and the usual filters."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcare import settings as S
from stationcare.operators.clean import nan_to_null

_COMPONENTS = list(S.RUL_TARGETS)

READINGS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("timestamp", T.StringType()),
     T.StructField("bloque_productivo", T.LongType()), T.StructField("vehiculo_id", T.LongType()),
     T.StructField("tipo_vehiculo", T.StringType()), T.StructField("estado_sistema", T.StringType())]
    + [T.StructField(s, T.DoubleType()) for s in S.SENSORS]
    + [T.StructField("temperatura_ambiente_celsius", T.DoubleType())]
    + [T.StructField(f"volumen_{kind}_{c}_ml", T.LongType())
       for c in _COMPONENTS for kind in ("real", "objetivo")]
    + [T.StructField(S.MACHINE_HOURS, T.DoubleType())]
    + [T.StructField(f"horas_operacion_comp_{c}", T.DoubleType()) for c in _COMPONENTS]
    + [T.StructField(r, T.DoubleType()) for r in S.RUL_TARGETS.values()]
    + [T.StructField("timestamp_unix", T.LongType()), T.StructField("semana_del_mes", T.LongType())])

FORMATS = {".parquet": "parquet", ".csv": "csv", ".db": "jdbc", ".sqlite": "jdbc", ".sqlite3": "jdbc"}


def source_format(path: str) -> str:
    """Format from the file name; anything unknown is an error."""
    name = path.rstrip("/").lower()
    for ending, kind in FORMATS.items():
        if name.endswith(ending):
            return kind
    raise ValueError(f"no reader for {path}; expected one of {sorted(FORMATS)}")


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | None = None, table: str = "datos_estacion",
               where: Column | None = None, **jdbc) -> DataFrame:
    """Lazy scan of Parquet, CSV or a database table, NaN read as NULL.

    ``where`` goes to the scan itself (pushed down, on the raw columns) and is asked
    again once NaN is NULL, so that a NaN passes no comparison.
    """
    fmt = fmt or source_format(path)
    if fmt == "jdbc":
        return read_database(spark, f"jdbc:sqlite:{path}", table, **jdbc)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    raw = reader.load(path)
    return nan_to_null(raw) if where is None else nan_to_null(raw.where(where)).where(where)


def read_database(spark: SparkSession, url: str, table: str, column: str | None = "id",
                  lower: int = 0, upper: int = 1, partitions: int = 1,
                  properties: dict[str, str] | None = None) -> DataFrame:
    """Parallel JDBC scan in ranges of a numeric column; needs the driver jar on the classpath."""
    if partitions > 1:
        return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                               numPartitions=partitions, properties=properties or {})
    return spark.read.jdbc(url, table, properties=properties or {})


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def check_table(spark: SparkSession, name: str, columns: list[str] | None = None) -> int:
    """Row count of a catalog table that must exist and carry the given columns."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"table {name} does not exist")
    return require_columns(spark.table(name), columns or []).count()


def sensor_data(df: DataFrame, sensors: list[str] | None = None, epoch: str = "timestamp_unix",
                limit: int | None = None) -> DataFrame:
    """Sensor columns in time order, with the epoch seconds as a timestamp."""
    wanted = [c for c in (sensors or S.SENSORS) if c in df.columns]
    out = df.select(epoch, F.timestamp_seconds(epoch).alias("timestamp"), *wanted).orderBy(epoch)
    return out if limit is None else out.limit(limit)


def state_data(df: DataFrame, state: str | None = None, rul_range: tuple[float, float] | None = None,
               limit: int | None = None, state_column: str = S.RAW_STATE,
               rul_column: str = "rul_dias_aceite", order_by: tuple[str, ...] = ("timestamp_unix",)) -> DataFrame:
    """Rows in one state and/or a RUL range, in time order."""
    out = df.where(in_state(state, rul_range, state_column, rul_column)).orderBy(*order_by)
    return out if limit is None else out.limit(limit)


def in_state(state: str | None = None, rul_range: tuple[float, float] | None = None,
             state_column: str = S.RAW_STATE, rul_column: str = "rul_dias_aceite") -> Column:
    """Condition for ``read_table(where=)``: one state and/or a RUL range."""
    out = F.lit(True)
    if state is not None:
        out = out & (F.col(state_column) == state)
    if rul_range is not None:
        out = out & F.col(rul_column).between(*rul_range)
    return out


def date_range(df: DataFrame, start: str | None = None, end: str | None = None,
               timestamp: str = S.TIMESTAMP, order_by: tuple[str, ...] | None = None) -> DataFrame:
    """Rows between two times, both ends included."""
    ts = F.col(timestamp)
    kind = df.schema[timestamp].dataType.simpleString()
    out = df
    if start is not None:
        out = out.where(ts >= F.lit(start).cast(kind))
    if end is not None:
        out = out.where(ts <= F.lit(end).cast(kind))
    return out.orderBy(*(order_by or (timestamp,)))


def table_info(df: DataFrame, timestamp: str = S.TIMESTAMP, state: str = S.RAW_STATE) -> DataFrame:
    """Count, first and last time, and the count of each state."""
    us = F.unix_micros(F.col(timestamp).cast("timestamp"))
    facts = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.min(us).alias("lo"), F.max(us).alias("hi")))
    states = df.groupBy(state).agg(F.count(F.lit(1)).alias("state_rows")).withColumn("_f", facts.scalar())
    return states.select(state, "state_rows", F.col("_f.n").alias("total_rows"),
                         F.col("_f.lo").alias("first_us"), F.col("_f.hi").alias("last_us"))


def table_names(spark: SparkSession) -> DataFrame:
    return spark.sql("show tables").select("tableName")


def numeric_text(df: DataFrame, column: str) -> bool:
    """Do all known values of a column read as numbers? False where none is known."""
    value = F.col(column)
    found = df.where(value.isNotNull()).agg(
        F.bool_and(value.cast("string").try_cast("double").isNotNull())).first()[0]
    return bool(found)


def run_query(df: DataFrame, query: str, args: dict | list | None = None,
              name: str = "datos_estacion") -> DataFrame:
    """SQL with bound parameters over the readings, under the name ``datos_estacion``.

    The view has a private name, so that two users of one session do not meet.
    """
    private = f"{name}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(private)
    text = re.sub(rf"(?i)\b{re.escape(name)}\b", private, query)
    return df.sparkSession.sql(text, args=args) if args else df.sparkSession.sql(text)
