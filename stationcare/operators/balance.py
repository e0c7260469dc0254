"""Class balance: under-sampling, then synthetic minority rows between neighbours."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.functions.hashing import stable_hash, stable_uniform
from stationcare.operators.ordered import with_index
from stationcare.operators.split import cap_per_class
from stationcare.session import staged

TILE = 2_048
#: rows that steer where cells are cut, and the most blocks whose bounds travel with the tasks
CUT_SAMPLE, MAX_BLOCKS = 20_000, 20_000
#: cuts of a path that may leave sides of very unlike size, and all of its cuts
UNEVEN_DEPTH, DEPTH = 30, 60


def _cells(points: np.ndarray, least: int, depth: int = 0) -> list:
    """Cuts of a k-d tree: [dimension, value, lower half, upper half], or [] for a cell of at most ``least`` points.

    The widest side is cut where the sides, weighed by their points, are shortest together: in the middle of even values,
    between the bulk and the far end of uneven ones, for a cell that holds a far point is near to everything. Deep
    cells are cut in halves; a path has fewer cuts than a number has bits.
    """
    if len(points) <= least or depth == DEPTH:
        return []
    spread = points.max(axis=0) - points.min(axis=0)
    d = int(spread.argmax())
    if not spread[d] > 0:
        return []
    v = np.sort(points[:, d])
    fresh = np.flatnonzero(v[1:] > v[:-1]) + 1
    if depth < UNEVEN_DEPTH:
        cost = fresh * (v[fresh - 1] - v[0]) + (len(v) - fresh) * (v[-1] - v[fresh])
    else:
        cost = np.abs(2 * fresh - len(v))
    value = float(v[fresh[cost.argmin()]])
    low = points[:, d] < value
    return [d, value, _cells(points[low], least, depth + 1), _cells(points[~low], least, depth + 1)]


def _cell_of(cuts: list, points: np.ndarray, first: int = 1) -> np.ndarray:
    """Number of the cell of each point: the path through the cuts as bits."""
    out = np.full(len(points), first, np.int64)
    if cuts:
        d, value, below, above = cuts
        low = points[:, d] < value
        out[low] = _cell_of(below, points[low], 2 * first)
        out[~low] = _cell_of(above, points[~low], 2 * first + 1)
    return out


def _close(part: np.ndarray, own: np.ndarray, points: np.ndarray, ids: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, point) of at least the ``take`` nearest points of each row, and of all that are as near as the last of them.

    In many dimensions squared distances come from one matrix product of centred points, with the reach widened by more
    than its rounding errors; the caller measures what is left exactly.
    """
    slack = 0.0
    if points.shape[1] > 8 and np.isfinite(points).all() and np.isfinite(part).all():
        middle = points.mean(axis=0)
        a, b = part - middle, points - middle
        a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
        gap = a2[:, None] + b2[None, :] - 2.0 * (a @ b.T)
        slack = 1e-12 * (a2.max() + b2.max() + (middle * middle).sum())
    else:
        gap = np.zeros((len(part), len(points)))
        for d in range(points.shape[1]):
            gap += (part[:, d, None] - points[None, :, d]) ** 2
    gap[own[:, None] == ids[None, :]] = np.inf
    reach = np.partition(gap, take - 1, axis=1)[:, take - 1] + 2.0 * slack
    return np.nonzero(gap <= reach[:, None])


def _nearest(x: np.ndarray, i: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest points of each row as (row, squared distance, id); equal distances go to the lower id."""
    found = []
    for start in range(0, len(x), 512):
        part, own = x[start:start + 512], i[start:start + 512]
        take = min(k, len(points))
        row, at = _close(part, own, points, ids, take)
        gap = np.zeros(len(row))
        for d in range(points.shape[1]):
            gap += (part[row, d] - points[at, d]) ** 2
        gap[own[row] == ids[at]] = np.inf
        order = np.lexsort((ids[at], gap, row))
        row, at, gap = row[order], at[order], gap[order]
        first = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        good = (place < take) & np.isfinite(gap)
        found.append((row[good] + start, gap[good], ids[at[good]]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _candidates(near: pd.DataFrame, label: str, x: np.ndarray, i: np.ndarray, k: int, seen: set, boxes: dict) -> list[list[int]]:
    """For each row the blocks of its class that may hold a point nearer than its k-th, or as near with a lower position."""
    own = boxes.get(label)
    if own is None:
        return [[] for _ in i]
    numbers, low, high, first = own
    reach, last = np.full(len(i), np.inf), np.full(len(i), np.iinfo(np.int64).max)
    counts = np.bincount(near["row"], minlength=len(i))
    ends = np.cumsum(counts) - 1
    full = counts >= k
    reach[full], last[full] = near["distance"].to_numpy()[ends[full]], near["j"].to_numpy()[ends[full]]
    other = ~np.isin(numbers, list(seen))
    out: list = [[] for _ in i]
    order = np.argsort(reach, kind="stable")
    for start in range(0, len(order), 256):
        # rows of like reach first drop the blocks that are out of reach of all of them
        own_rows = order[start:start + 256]
        bottom, top = x[own_rows].min(axis=0), x[own_rows].max(axis=0)
        bound = np.zeros(len(numbers))
        for d in range(x.shape[1]):
            bound += np.maximum(np.maximum(low[:, d] - top[d], bottom[d] - high[:, d]), 0.0) ** 2
        near_by = np.flatnonzero(other & ~(bound > reach[own_rows[-1]]))
        for row in own_rows:
            bound = np.zeros(len(near_by))
            for d in range(x.shape[1]):
                bound += np.maximum(np.maximum(low[near_by, d] - x[row, d], x[row, d] - high[near_by, d]), 0.0) ** 2
            asked = (bound < reach[row]) | ((bound == reach[row]) & (first[near_by] < last[row]))
            out[row] = numbers[near_by[asked]].tolist()
    return out


def _blocks(df: DataFrame, label: str, tile: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``(l, block, lead, i, x, asks)`` in blocks of at most ``tile`` rows of one cell, and the bounds of each block.

    Cells come from quantile cuts of a bounded sample; they steer only how much is looked at. A cell that cuts cannot
    divide, for its points are equal, is divided by position; ``lead`` is its first block.
    """
    sizes = {r["l"]: r["n"] for r in df.groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    tile = max(tile, math.ceil(total / MAX_BLOCKS))
    sample = df.select(F.col(label).alias("l"), "x")
    share = CUT_SAMPLE / max(total, 1)
    drawn = (sample.sample(False, share, S.SEED) if share < 1 else sample).limit(2 * CUT_SAMPLE).collect()
    by: dict = {}
    for r in drawn:
        by.setdefault(r["l"], []).append(r["x"])
    cuts = {c: _cells(np.array(v, float), max(1, tile * len(v) // sizes[c])) for c, v in by.items()}

    @F.pandas_udf("long")
    def cell(labels: pd.Series, points: pd.Series) -> pd.Series:
        out = np.ones(len(labels), np.int64)
        for c in labels.unique():
            rows = (labels == c).to_numpy()
            out[rows] = _cell_of(cuts.get(c, []), np.vstack(points[rows].to_numpy()))
        return pd.Series(out)

    celled = staged(df.select(F.col(label).alias("l"), F.col("position").alias("i"), "x", "asks", cell(F.col(label), F.col("x"))
                              .alias("cell")), "cells")
    placed = with_index(celled, ["i"], by=["l", "cell"], rows=total, index="_at")
    part = F.floor((F.col("_at") - 1) / F.lit(tile)).cast("long")
    placed = staged(placed.withColumn("part", part).drop("_at"), "blocks")
    width = len(placed.select("x").first()["x"]) if total else 0
    bounds = placed.groupBy("l", "cell", "part").agg(F.min("i").alias("first"), F.array(*[F.min(F.col("x")[d]) for d in range(width)])
                                                    .alias("low"), F.array(*[F.max(F.col("x")[d]) for d in range(width)]).alias("high"))
    numbered = [(r["l"], r["cell"], r["part"], n, r["first"], r["low"], r["high"])
                for n, r in enumerate(bounds.orderBy("l", "cell", "part").collect())]  # at most about MAX_BLOCKS rows
    kind = placed.schema["l"].dataType.simpleString()
    names = df.sparkSession.createDataFrame(numbered, f"l {kind}, cell long, part long, block long, first long, "
                                            "low array<double>, high array<double>")
    leads = names.where("part = 0").select("l", "cell", F.col("block").alias("lead"))
    keyed = placed.join(F.broadcast(names.select("l", "cell", "part", "block").join(leads, ["l", "cell"])), ["l", "cell", "part"])
    return keyed.select("l", "block", "lead", "i", "x", "asks"), names


def _first_look(df: DataFrame, label: str, k: int, tile: int, asks: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows in blocks, and for each row that asks the nearest of its own block and the blocks it has to ask (``asked``)."""
    rows, names = _blocks(df.withColumn("asks", F.lit(True) if asks is None else asks), label, tile)
    boxes: dict = {}
    for r in names.collect():
        boxes.setdefault(r["l"], []).append(r)
    boxes = {c: (np.array([r["block"] for r in b]), np.array([r["low"] for r in b], float), np.array([r["high"] for r in b], float),
                 np.array([r["first"] for r in b])) for c, b in boxes.items()}
    kind = rows.schema["l"].dataType.simpleString()
    # the first block of a cell also goes to the other blocks of the cell
    followers = names.select("l", "cell", "block", "part").where("part > 0").join(
        names.where("part = 0").select("l", "cell", F.col("block").alias("lead")), ["l", "cell"]).select("lead", F.col("block").alias("_to"))
    visitors = rows.join(F.broadcast(followers), "lead").where(F.col("block") == F.col("lead"))
    # rows that ask nothing are there to be found only
    pool = rows.select("l", "block", "lead", "i", "x", F.col("asks").alias("own")).unionByName(
        visitors.select("l", F.col("_to").alias("block"), "lead", "i", "x", F.lit(False).alias("own")))

    def inside(g: pd.DataFrame) -> pd.DataFrame:
        mine = g["own"].to_numpy()
        if not mine.any():
            return pd.DataFrame(columns=["l", "block", "i", "x", "distance", "j", "asked"])
        points, ids = np.vstack(g["x"].to_numpy()), g["i"].to_numpy()
        x, i = points[mine], ids[mine]
        row, distance, j = _nearest(x, i, points, ids, k)
        near = pd.DataFrame({"row": row, "distance": distance, "j": j})
        block, lead, c = g["block"].iloc[0], g["lead"].iloc[0], g["l"].iloc[0]
        asked = _candidates(near, c, x, i, k, {block, lead}, boxes)
        groups = np.split(np.arange(len(row)), np.cumsum(np.bincount(row, minlength=len(i)))[:-1])
        return pd.DataFrame({"l": c, "block": block, "i": i, "x": list(x), "distance": [distance[s] for s in groups],
                             "j": [j[s] for s in groups], "asked": asked})

    found = staged(pool.groupBy("l", "block").applyInPandas(
        inside, f"l {kind}, block long, i long, x array<double>, distance array<double>, j array<long>, asked array<long>"), "near")
    return rows, found


def neighbours(df: DataFrame, label: str, key: str, k: int = S.SMOTE_NEIGHBOURS, tile: int = TILE,
               asks: Column | None = None) -> DataFrame:
    """The exact ``k`` nearest rows of the same class, by position within the class; only for rows that meet ``asks`` if given.

    ``df`` carries ``position`` (1..n per class), ``size`` and the vector ``x``. A row first finds the nearest of its
    own block (and of the first block of its cell), then asks only blocks whose bounds are nearer than its k-th, or
    as near with a lower position. A task holds two blocks, and no list of pairs is ever built.
    """
    rows, found = _first_look(df, label, k, tile, asks)
    kind = rows.schema["l"].dataType.simpleString()
    asking = found.select("l", F.col("block").alias("a"), F.explode("asked").alias("b"), "i", "x")
    pairs = found.select(F.col("block").alias("_a"), F.explode("asked").alias("_b")).distinct()
    hosts = rows.join(pairs, F.col("block") == F.col("_b")).select(
        "l", F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("i").alias("j"), F.col("x").alias("y"))

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names_ = ["l", "i", "distance", "j"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names_)
        i = left["i"].to_numpy()
        row, distance, j = _nearest(np.vstack(left["x"].to_numpy()), i, np.vstack(right["y"].to_numpy()), right["j"].to_numpy(), k)
        return pd.DataFrame({"l": left["l"].iloc[0], "i": i[row], "distance": distance, "j": j})

    more = asking.groupBy("l", "a", "b").cogroup(hosts.groupBy("l", "a", "b")).applyInPandas(
        across, f"l {kind}, i long, distance double, j long")
    first = found.select("l", "i", F.explode(F.arrays_zip("distance", "j")).alias("n")).select("l", "i", "n.distance", "n.j")
    best = F.slice(F.sort_array(F.collect_list(F.struct("distance", "j"))), 1, k)
    return (first.unionByName(more).groupBy("l", "i").agg(best.alias("near"))
            .select(F.col("l").alias(label), F.col("i").alias("position"),
                    F.posexplode("near").alias("rank", "n"))
            .select(label, "position", (F.col("rank") + 1).alias("rank"),
                    F.col("n.j").alias("neighbour"), F.col("n.distance").alias("squared_distance")))


def smote(df: DataFrame, label: str, key: str, features: list[str],
          k: int = S.SMOTE_NEIGHBOURS, tile: int = TILE, seed: int = S.SEED) -> DataFrame:
    """Rows ``(label, *features, synthetic)`` with every class as large as the largest.

    Comes back unchanged if there is one class, or a class too small to have
    ``k`` neighbours.
    """
    base = df.select(label, key, *[F.col(c).cast("double").alias(c) for c in features])
    sizes = {r[label]: r["n"] for r in base.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    original = base.select(label, *features, F.lit(False).alias("synthetic"))
    largest = max(sizes.values(), default=0)
    small = {c: n for c, n in sizes.items() if n < largest}
    if not small or min(small.values()) <= k:
        return original
    kind = df.schema[label].dataType.simpleString()
    plan = df.sparkSession.createDataFrame(
        [(c, n, largest - n) for c, n in small.items()], f"_l {kind}, size long, lacking long")
    minority = base.join(F.broadcast(plan), F.col(label) == F.col("_l")).drop("_l")
    placed = with_index(minority, [key], by=[label], rows=sum(small.values()), index="position")
    placed = placed.withColumn("x", F.array(*features))
    copies = (F.floor(F.col("lacking") / F.col("size"))
              + (F.col("position") <= F.col("lacking") % F.col("size")).cast("long")).cast("int")
    # a class that lacks few rows has few that need neighbours
    near = neighbours(placed, label, key, k, tile, copies > 0)
    drawn = (placed.where(copies > 0)
             .select(label, key, "position", "x", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
             .withColumn("rank", (F.pmod(stable_hash(F.col(label), F.col(key), F.col("copy"), seed=seed),
                                         F.lit(k)) + 1).cast("int"))
             .withColumn("u", stable_uniform(F.col(label), F.col(key), F.col("copy"), F.lit("gap"), seed=seed)))
    ends = placed.select(label, F.col("position").alias("neighbour"), F.col("x").alias("y"))
    made = (drawn.join(near, [label, "position", "rank"]).join(ends, [label, "neighbour"])
            .select(label, *[(F.col("x")[i] + F.col("u") * (F.col("y")[i] - F.col("x")[i])).alias(c)
                             for i, c in enumerate(features)], F.lit(True).alias("synthetic")))
    return original.unionByName(made)


def balance(df: DataFrame, label: str, key: str, features: list[str],
            cap: int = S.UNDERSAMPLE_CAP, seed: int = S.SEED) -> DataFrame:
    """Cap each class, then fill the smaller classes with synthetic rows."""
    capped = cap_per_class(df.where(F.col(label).isNotNull()), label, key, cap, seed=seed)
    return smote(capped, label, key, features, seed=seed)
