"""Joins whose left side has hot keys."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from stationcare.operators import clean, skew

ROWS, SHARES = 24_000, 8


@pytest.fixture(scope="module")
def left(spark):
    """A third of the rows on key 7, a tenth without a key, the others on 500 keys; every row stands twice."""
    rows = spark.range(ROWS // 2, numPartitions=6)
    key = (F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None)
           .otherwise(1000 + F.pmod(F.xxhash64("id"), F.lit(500)))).cast("long")
    once = rows.select(F.col("id").alias("row"), key.alias("key"))
    return once.union(once)


@pytest.fixture(scope="module")
def right(spark):
    """Two rows for key 7, one for most others, a null key and keys that nobody asks for."""
    rows = [(7, "seven"), (7, "again"), (None, "none"), (5, "five")] + [(1000 + k, f"v{k}") for k in range(450)]
    return spark.createDataFrame(rows, "key long, value string")


@pytest.fixture()
def plain_shuffle(spark):
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": str(SHARES)}
    before = {k: spark.conf.get(k) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def counted(df):
    return sorted(((tuple(r), r["_c"]) for r in df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c")).collect()),
                  key=str)


@pytest.mark.parametrize("how", skew.KINDS)
def test_spread_join_equals_join(left, right, plain_shuffle, how):
    want = left.join(right, "key", how)
    got = skew.spread_join(left, right, ["key"], how, limit=0)
    assert got.columns[:2] == left.columns
    assert counted(got.select(*want.columns)) == counted(want)
    assert counted(skew.spread_join(left, right, ["key"], how).select(*want.columns)) == counted(want)


def test_other_kinds_are_refused(left, right):
    with pytest.raises(ValueError, match="none of"):
        skew.spread_join(left, right, ["key"], "full")


@pytest.mark.parametrize("how", ["left", "left_semi"])
def test_no_task_holds_the_hot_key(left, right, plain_shuffle, how):
    once = right.dropDuplicates(["key"])

    def sizes(df):
        # every column is read, or the optimizer leaves a join out whose right side is unique
        read = F.max(F.xxhash64(*df.columns))
        return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(
            F.count(F.lit(1)).alias("n"), read.alias("h")).collect()]

    before = sizes(left.join(once, "key", how))
    after = sizes(skew.spread_join(left, once, ["key"], how, limit=0))
    assert sum(before) == sum(after) and len(after) == SHARES
    assert max(after) < 3 * statistics.median(after) < max(before)


def test_hot_keys_are_few_and_exact(left):
    counts = left.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    hot = {r["key"]: r["_salts"] for r in skew.hot_keys(counts, ROWS, SHARES).collect()}
    assert hot == {7: math.ceil(ROWS / 3 * skew.PIECES * SHARES / ROWS)}
    assert skew.hot_keys(counts.where("key > 7"), ROWS, SHARES) is None
    assert skew.hot_keys(counts.limit(0), 0, SHARES) is None


def test_two_keys_and_odd_tables(spark, plain_shuffle):
    rows = [(1, None, i) for i in range(300)] + [(1, "a", i) for i in range(300)] + [(2, "b", 0), (None, None, 1)]
    df = spark.createDataFrame(rows, "k long, s string, v int")
    other = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0), (None, None, 4.0)], "k long, s string, w double")
    for a, b in ((df, other), (df.limit(0), other), (df, other.limit(0))):
        want = a.join(b, ["k", "s"], "left").select("k", "s", "v", "w")
        for limit in (0, 100):
            assert counted(skew.spread_join(a, b, ["k", "s"], limit=limit)) == counted(want)


def test_group_stats_and_ids(left, plain_shuffle, monkeypatch):
    monkeypatch.setattr(skew.spread_join, "__defaults__", ("left", None, None, None, 0))
    got = skew.with_group_stats(left, ["key"], {"n": F.count(F.lit(1)), "high": F.max("row")})
    facts = {r["key"]: (r["n"], r["high"]) for r in left.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("row").alias("high")).collect()}
    rows = got.collect()
    assert len(rows) == ROWS and got.columns == ["row", "key", "n", "high"]
    assert all((r["n"], r["high"]) == (facts[r["key"]] if r["key"] is not None else (None, None)) for r in rows)
    ids = left.select("key").where("key = 7 OR key % 2 = 0")
    assert clean.rows_with_ids(left, ids, "key").count() == left.where("key = 7 OR key % 2 = 0").count()


def test_stacked_tables(spark):
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    two = spark.createDataFrame([("y", 2.0), ("y", 2.0)], "b string, c double")
    got = sorted(map(tuple, skew.stacked({"first": one, "second": two}, "part").select("part", "a", "b", "c").collect()))
    assert got == [("first", 1, "x", None), ("second", None, "y", 2.0), ("second", None, "y", 2.0)]
    with pytest.raises(ValueError):
        skew.stacked({}, "part")
