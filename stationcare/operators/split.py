"""Splits and folds that hold for hot classes and hot groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.functions.hashing import stable_hash
from stationcare.operators.ordered import with_index
from stationcare.operators.tables import settled

COARSE_BITS = 40  # hash bits below the coarse bucket: 2**20 buckets per class


def take_first(df: DataFrame, by: str, key: str, wanted: Callable[[Column], Column],
               seed: int | str = S.SEED, taken: str = "taken") -> DataFrame:
    """Mark exactly ``wanted(class size)`` seeded-random rows of every class.

    Counts per coarse hash bucket find the one bucket per class where the quota
    runs out; only that bucket's rows are ranked. Everything else is decided row
    by row, so a class of any size never meets one task. ``key`` must be unique.
    """
    h = stable_hash(F.col(key), seed=seed)
    coarse = F.shiftright(h, COARSE_BITS)
    hashed = df.select(F.col(by).alias("_by"), F.col(key).alias("_key"), h.alias("_h"), coarse.alias("_b"))
    counts = hashed.groupBy("_by", "_b").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_by")
    quota = wanted(F.sum("_c").over(whole)).cast("long")
    spots = (counts.withColumn("_upto", F.sum("_c").over(run)).withColumn("_want", quota)
             .where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_c") < F.col("_want")))
             .select(F.col("_by").alias("_sby"), F.col("_b").alias("_sb"),
                     (F.col("_want") - F.col("_upto") + F.col("_c")).alias("_need")))
    spots = settled(spots)
    edge = hashed.join(spots, F.col("_by").eqNullSafe(F.col("_sby")) & (F.col("_b") == F.col("_sb")))
    rank = F.row_number().over(Window.partitionBy("_by").orderBy("_h", "_key"))
    cuts = (edge.withColumn("_r", rank).where(F.col("_r") == F.col("_need"))
            .select(F.col("_by").alias("_cby"), F.struct("_h", "_key").alias("_cut")))
    marked = df.withColumn("_at", F.struct(h.alias("_h"), F.col(key).alias("_key")))
    joined = marked.join(settled(cuts), F.col(by).eqNullSafe(F.col("_cby")), "left")
    return (joined.withColumn(taken, F.coalesce(F.col("_at") <= F.col("_cut"), F.lit(False)))
            .drop("_at", "_cby", "_cut"))


def stratified_split(df: DataFrame, target: str, key: str, test_share: float = S.TEST_SHARE,
                     seed: int | str = S.SEED) -> DataFrame:
    """Add ``split``: train or test, the same share of every class to within one row."""
    marked = take_first(df, target, key, lambda n: F.floor(n * F.lit(test_share) + 0.5), seed)
    return marked.withColumn("split", F.when(F.col("taken"), "test").otherwise("train")).drop("taken")


def cap_per_class(df: DataFrame, target: str, key: str, cap: int | None = None,
                  total: int | None = None, seed: int | str = S.SEED) -> DataFrame:
    """At most ``cap`` rows of each class, or ``total`` shared evenly between the classes."""
    if (cap is None) == (total is None):
        raise ValueError("give cap or total")
    if cap is None:
        classes = df.where(F.col(target).isNotNull()).select(target).distinct().count()
        cap = total // max(classes, 1)
    marked = take_first(df, target, key, lambda n: F.least(n, F.lit(cap)), seed)
    return marked.where("taken").drop("taken")


def fold_runs(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Folds of groups that go one by one, largest first, to the lightest fold (ties: lowest number).

    ``sizes``: (group size, number of such groups), falling. Returns (group size, first group, groups, folds in
    turn): equal groups go round in turn once their folds are level, so the answer is as short as the list.
    """
    loads, out, at = [0] * k, [], 0
    for size, count in sizes:
        while count:
            low = min(loads)
            turn = sorted((f for f in range(k) if loads[f] < low + size), key=lambda f: (loads[f], f))
            others = [loads[f] for f in range(k) if loads[f] >= low + size]
            # whole rounds while every fold of the turn stays lighter than the rest
            rounds = count // len(turn)
            if others:
                rounds = min(rounds, max(0, (min(others) - loads[turn[-1]]) // size))
            taken = rounds * len(turn) or 1
            turn = turn if rounds else turn[:1]
            for f in turn:
                loads[f] += (rounds or 1) * size
            out.append((size, at, taken, turn))
            at, count = at + taken, count - taken
    return out


def _with_folds(df: DataFrame, group: str, sized: DataFrame, k: int) -> DataFrame:
    """Place the groups of ``sized (_s, _g, _n)`` stratum by stratum and attach ``fold`` to the rows.

    The driver sees how many groups there are of each size, never the groups: there are at most about
    sqrt(2 * rows) different sizes.
    """
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in sized.groupBy("_s", "_n").agg(F.count(F.lit(1)).alias("c")).orderBy("_s", F.desc("_n")).collect():
        counts.setdefault(r["_s"], []).append((r["_n"], r["c"]))
    runs, start = [], 1
    for stratum, sizes in counts.items():
        runs += [(stratum, size, start + at, start + at + n, folds) for size, at, n, folds in fold_runs(sizes, k)]
        start += sum(c for _, c in sizes)
    ranked = with_index(sized.withColumn("_turn", -F.col("_n")), ["_s", "_turn", "_g"], rows=start - 1, index="_at")
    stretches = settled(df.sparkSession.createDataFrame(
        runs, "_rs string, _rn long, _from long, _to long, _folds array<int>"))
    placed = ranked.join(stretches, (F.col("_s") == F.col("_rs")) & (F.col("_n") == F.col("_rn"))
                         & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    folds = placed.select(F.col("_g").alias("_fg"), F.get(
        "_folds", F.pmod(F.col("_at") - F.col("_from"), F.size("_folds")).cast("int")).alias("fold"))
    return df.join(settled(folds), F.col(group).eqNullSafe(F.col("_fg")), "left").drop("_fg")


def group_folds(df: DataFrame, group: str, k: int = S.FOLDS) -> DataFrame:
    """Add ``fold``; all rows of a group share it and the folds are of like size.

    The groups go by falling size, then by name, to the lightest fold: one rule for any number of groups.
    """
    sized = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.lit(""))
    return _with_folds(df, group, sized, k)


def stratified_group_folds(df: DataFrame, group: str, target: str, k: int = S.FOLDS) -> DataFrame:
    """Like ``group_folds``, keeping the class mix of the folds alike as well.

    A group belongs to the class of which it holds the largest share (ties: first by name); the groups of each
    class are spread over the folds as ``group_folds`` spreads all. Groups without a class are spread last.
    """
    counts = df.groupBy(F.col(group).alias("_g"), F.col(target).alias("_c")).agg(F.count(F.lit(1)).alias("_m"))
    totals = settled(counts.where(F.col("_c").isNotNull()).groupBy(F.col("_c").alias("_tc"))
                     .agg(F.sum("_m").alias("_t")))
    shares = counts.join(totals, F.col("_c") == F.col("_tc"), "left").withColumn("_share", F.col("_m") / F.col("_t"))
    known = F.col("_c").isNotNull()
    sized = shares.groupBy("_g").agg(
        F.sum("_m").alias("_n"),
        F.min(F.when(known, F.struct((-F.col("_share")).alias("a"), F.col("_c").cast("string").alias("c"))))
        .alias("_best"))
    last = F.when(F.col("_best").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("_best.c")))
    return _with_folds(df, group, sized.select("_g", "_n", last.alias("_s")), k)


def leaking_groups(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups present in more than one fold; none means no leak."""
    return (df.groupBy(group).agg(F.min(fold).alias("first_fold"), F.max(fold).alias("last_fold"))
            .where(F.col("first_fold") != F.col("last_fold")))


def shared_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    return train.select(group).intersect(test.select(group))


def label_union(df: DataFrame, first: str, second: str) -> DataFrame:
    """All labels seen as truth or as prediction."""
    both = df.select(F.col(first).alias("label")).union(df.select(F.col(second).alias("label")))
    return both.where(F.col("label").isNotNull()).distinct()
