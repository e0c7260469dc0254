"""Joins on keys of which a few hold much of the table.

A small right side is broadcast after its rows were counted. Otherwise the keys of the left side are counted
(map-side first), and those with more rows than an even share of a shuffle partition are hot: their rows get a
salt, the matching rows of the right side are repeated once per salt, and both meet on key and salt. All other
rows join as usual, in the same shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcare.operators.tables import BROADCAST_ROWS, settled
from stationcare.session import staged

#: A hot key is cut into this many pieces per even share, so that pieces which meet in one task weigh little.
PIECES = 4
#: Shares are never finer than this; there are at most as many hot keys.
MAX_SHARES = 10_000
KINDS = ("inner", "left", "left_semi", "left_anti")


def shares_of(df: DataFrame) -> int:
    """Number of even shares: shuffle partitions, at most MAX_SHARES."""
    return min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_SHARES)


def hot_keys(counts: DataFrame, total: int, shares: int) -> DataFrame | None:
    """Keys with more than ``total / shares`` rows, with the number of ``_salts`` each; None if there is none.

    ``counts`` has one row per key and its rows in ``_n``. Fewer than ``shares`` keys can be hot, so the driver
    gets fewer than ``shares`` rows whatever the table.
    """
    salts = F.ceil(F.col("_n") * F.lit(PIECES * shares) / F.lit(max(total, 1))).cast("int")
    found = counts.where(F.col("_n") * F.lit(shares) > F.lit(total)).withColumn("_salts", salts).drop("_n")
    rows = found.collect()
    return counts.sparkSession.createDataFrame(rows, found.schema) if rows else None


def _hashable(df: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]


def _salted(df: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """``df`` with ``_salts`` of its key, 1 where the key is not hot (null keys count as a key)."""
    marked = hot.select(*[F.col(f"`{k}`").alias(f"_hot_{i}") for i, k in enumerate(on)], "_salts")
    same = F.lit(True)
    for i, k in enumerate(on):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_hot_{i}"))
    # bounded: fewer rows than shares
    joined = df.join(F.broadcast(marked), same, "left").drop(*[f"_hot_{i}" for i in range(len(on))])
    return joined.withColumn("_salts", F.coalesce("_salts", F.lit(1)))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", counts: DataFrame | None = None,
                total: int | None = None, shares: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``left.join(right, on, how)`` that no key of ``left`` can hold up; ``how`` is one of KINDS.

    The columns of ``left`` come first, in their order; other columns of ``right`` must have names of their own.
    ``counts`` are rows per key of ``left`` (``*on, _n``) where the caller has them, else they are counted; keys
    left out of it are not hot. ``total`` is the number of rows of ``left``. Salts are hashes of a row's own
    values and its input partition, so a task that runs again gives the same ones, and equal rows from different
    partitions spread. A key that is hot on both sides gives all pairs, as any join does. Null keys match nothing
    and spread as well. Columns named ``_salt`` or ``_salts`` are not allowed.
    """
    if how not in KINDS:
        raise ValueError(f"{how} is none of {KINDS}")
    wanted = [f"`{c}`" for c in left.columns]
    if how in ("inner", "left"):
        wanted += [f"`{c}`" for c in right.columns if c not in on]
    small = settled(right, limit)
    if small is not right:
        return left.join(small, on, how).select(*wanted)
    shares = shares or shares_of(left)
    if counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(counts.select(*on, "_n"), left.count() if total is None else total, shares)
    if hot is None:
        return left.join(right, on, how).select(*wanted)
    own = F.xxhash64(*_hashable(left), F.spark_partition_id())
    one = _salted(left, hot, on).withColumn(
        "_salt", F.when(F.col("_salts") > 1, F.pmod(own, F.col("_salts")).cast("int")).otherwise(0)).drop("_salts")
    other = _salted(right, hot, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return one.join(other.drop("_salts"), [*on, "_salt"], how).select(*wanted)


def with_group_stats(df: DataFrame, on: list[str], stats: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates of each key's rows in new columns.

    Aggregates are summed map-side, written once, and joined back by ``spread_join`` with the counts of that
    same table. Rows with a null in the key have null aggregates.
    """
    known = F.lit(True)
    for k in on:
        known = known & F.col(f"`{k}`").isNotNull()
    grouped = staged(df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"),
                                         *[c.alias(name) for name, c in stats.items()]), "group-stats")
    # null keys are hot too, if they are many: their rows must spread though they match nothing
    total = grouped.agg(F.sum("_n")).first()[0] or 0
    return spread_join(df, grouped.where(known).drop("_n"), on, "left", grouped.select(*on, "_n"), total)


def stacked(parts: dict[str, DataFrame], mark: str) -> DataFrame:
    """Tables one below the other, by column name; ``mark`` names the part a row comes from.

    A column that a part lacks is null there. Nothing is shuffled.
    """
    if not parts:
        raise ValueError("no tables")
    marked = [df.withColumn(mark, F.lit(name)) for name, df in parts.items()]
    out = marked[0]
    for df in marked[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
