"""Random forests and decision trees on Spark, grown level by level, all trees of a forest in the same passes.

Rows are binned once (``operators.binning``) and dealt to tasks in two directions: by parts of at most ``LARGE_PART``
rows and, while those are fewer than the cores, by groups of trees. A task sends each row down its trees, and sums what
the rows hold of every class (or of the target) by (node, feature, bin); only bins that hold a row are kept, so deep
levels cost what their rows cost. The sums of a tree meet in one task, which finds the best cut of each of its nodes;
the driver receives one line per node. Where the rows are a single part, no sums have to meet: every group of trees
grows in its task from root to leaves. Targets of many rows are rounded so that their sums are exact (``boosting.sum_grid``);
where every node looks at all inputs, only the rows of smaller siblings are then added up.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.operators.binning import fit_cuts
from stationcare.plans.boosting import (BLOCK_ROWS, Tree, _Block, _blocks, binned_table, binned_values, few_parts, rounded, spread,
                                         sum_grid)
from stationcare.session import unstage

#: shares of a Poisson(1) draw up to 0, 1, 2, ... copies of a row in the sample of a tree
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


@dataclass(frozen=True)
class Forest:
    """Fitted trees; the value of a node is its share of each class, or the mean of the target."""

    columns: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    classes: int
    trees: tuple[Tree, ...]

    def values(self, bins: np.ndarray) -> np.ndarray:
        total = np.zeros((len(bins), max(self.classes, 1)))
        for tree in self.trees:
            total += tree.value[tree.leaves(bins)]
        return total / max(len(self.trees), 1)

    def transform(self, df: DataFrame) -> DataFrame:
        """``prediction`` and, for classes, ``probability`` as an array: the mean over all trees."""
        @F.pandas_udf("array<double>")
        def scored(values: pd.DataFrame) -> pd.Series:
            return pd.Series(list(self.values(binned_values(self.cuts, values.to_numpy(float)))))

        own = F.struct(*[F.col(c).cast("double").alias(c) for c in self.columns])
        out = df.withColumn("_scores", scored(own))
        if not self.classes:
            return out.withColumn("prediction", F.col("_scores")[0]).drop("_scores")
        best = F.array_position("_scores", F.array_max("_scores")) - 1
        return out.withColumns({"prediction": best.cast("double"), "probability": F.col("_scores")}).drop("_scores")

    def importances(self) -> list[float]:
        """Each input's share of the impurity that a tree removes, mean over the trees."""
        total = np.zeros(len(self.columns))
        for tree in self.trees:
            own = np.zeros(len(self.columns))
            inner = tree.feature >= 0
            np.add.at(own, tree.feature[inner], tree.gain[inner])
            total += own / own.sum() if own.sum() > 0 else own
        return list(total / total.sum()) if total.sum() > 0 else list(total)

    def to_rows(self) -> list[str]:
        """A header and one text per tree."""
        head = {"columns": self.columns, "cuts": self.cuts, "classes": self.classes}
        return [json.dumps(head), *[t.to_json() for t in self.trees]]

    @classmethod
    def from_rows(cls, rows: list[str]) -> Forest:
        head = json.loads(rows[0])
        return cls(tuple(head["columns"]), tuple(map(tuple, head["cuts"])), head["classes"],
                   tuple(Tree.from_json(r) for r in rows[1:]))


@dataclass
class _Growing:
    """Arrays of a tree on the driver while it grows; ``first`` is where the nodes of the current level begin."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    stats: np.ndarray
    gain: np.ndarray
    first: int = 0

    @classmethod
    def root(cls, width: int) -> _Growing:
        return cls(*[np.array([v], np.int32) for v in (-1, 0, -1, -1)], np.zeros((1, width)), np.zeros(1))

    @property
    def active(self) -> int:
        return len(self.feature) - self.first

    def routes(self) -> Tree:
        empty = np.zeros(0)
        return Tree(self.feature, self.cut, self.left, self.right, empty, empty, empty)

    def split(self, found: tuple[np.ndarray, ...]) -> np.ndarray:
        """Open a node for each side of every cut found; the others stay leaves. Places of the nodes that were cut."""
        place, gain, feature, cut, left, whole = found
        at = place + self.first
        if self.first == 0 and len(self.feature) == 1 and len(whole):
            self.stats[0] = whole[0]
        good = gain > 1e-12
        at, n = at[good], len(self.feature)
        children = n + 2 * np.arange(len(at))
        self.feature[at], self.cut[at], self.gain[at] = feature[good], cut[good], gain[good]
        self.left[at], self.right[at] = children, children + 1
        sides = np.stack([left[good], whole[good] - left[good]], axis=1).reshape(2 * len(at), self.stats.shape[1])
        more = 2 * len(at)
        self.feature = np.concatenate([self.feature, np.full(more, -1, np.int32)])
        for name in ("cut", "left", "right"):
            setattr(self, name, np.concatenate([getattr(self, name), np.full(more, -1, np.int32)]))
        self.stats, self.gain = np.concatenate([self.stats, sides]), np.concatenate([self.gain, np.zeros(more)])
        self.first = n
        return place[good]

    def tree(self, weights: np.ndarray | None) -> Tree:
        if weights is None:
            cover = self.stats[:, 0]
            value = self.stats[:, 1:2] / np.maximum(cover, 1e-300)[:, None]
        else:
            held = self.stats * weights
            cover = held.sum(axis=1)
            value = held / np.maximum(cover, 1e-300)[:, None]
        return Tree(self.feature, self.cut, self.left, self.right, value, cover, self.gain)


def copies(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row stands in the sample of a tree, from a hash of the row's key."""
    return np.searchsorted(_POISSON, spread(key, 2 * tree + 1, seed) / 2.0**64, side="right")


def chosen_features(tree: int, nodes: np.ndarray, columns: int, take: int, seed: int) -> np.ndarray:
    """The features that a node may be cut on (nodes x take), by a hash of tree, node and feature."""
    if take >= columns:
        return np.tile(np.arange(columns), (len(nodes), 1))
    key = nodes.astype(np.int64)[:, None] * columns + np.arange(columns)
    return np.sort(np.argsort(spread(key, 2 * tree, seed), axis=1)[:, :take], axis=1)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, spot = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    out = np.zeros((len(keys), a[1].shape[1]))
    out[spot[:len(a[0])]] += a[1]
    out[spot[len(a[0]):]] += b[1]
    return keys, out


def _summed(label: np.ndarray, times: np.ndarray, spot: np.ndarray, bin_of: np.ndarray, rows: np.ndarray, own: np.ndarray,
            columns: int, bins: int, classes: int, lines: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys = (node * columns + feature) * bins + bin, and what the rows hold under each of them.

    ``spot`` is the node of each row in ``rows``, ``own`` the features of each node; ``bin_of`` is read fastest if it lies
    row by row. ``lines`` has the bins of ``rows`` feature by feature, if every node looks at all of them. Sums go into a table of all bins while that is not much larger than the rows; deep levels sort their keys instead.
    """
    nodes, take = own.shape
    width = classes or 2
    flat = bin_of.ravel()
    start = rows * columns
    if nodes * take * bins * width <= max(1 << 20, 2 * len(spot) * take):
        # a number and its product with the label are one complex number: one pass for both
        table = np.zeros(nodes * take * bins * max(classes, 1), float if classes else complex)
        value = times if classes else times + 1j * (times * label)
        step = bins * max(classes, 1)
        at = spot * (take * step) + (label if classes else 0)
        for j in range(take):
            held = flat.take(start + own[:, j].take(spot)) if lines is None else lines[j]
            np.add.at(table, at + (held * np.int64(classes) if classes else held), value)
            at += step
        sums = table.reshape(-1, classes) if classes else np.stack([table.real, table.imag], axis=1)
        seen = sums[:, 0].copy()
        for k in range(1, classes):
            seen += sums[:, k]
        held = np.flatnonzero(seen)
        group, at = held // bins, held % bins
        return (group // take * columns + own.ravel()[group]) * bins + at, sums[held]
    # features of a node ascend, so their places do for them in the sorted numbers
    binned = flat.take(start[:, None] + own.take(spot, axis=0))
    if not classes:
        key = ((spot[:, None] * take + np.arange(take)) * bins + binned).ravel()
        keys, at = np.unique(key, return_inverse=True)
        wide, y = np.repeat(times, take), np.repeat(label, take)
        sums = np.stack([np.bincount(at, wide, len(keys)), np.bincount(at, wide * y, len(keys))], axis=1)
    else:
        # class and number of copies ride along in the last bits of the sorted number
        low, copy = (classes - 1).bit_length(), 4
        kind = np.uint32 if (nodes * take * bins) << (low + copy) < 2**32 else np.int64
        riding = (spot * (take * bins) << (low + copy)) + (label << copy) + times.astype(np.int64)
        code = binned.astype(kind)
        code += (np.arange(take) * bins).astype(kind)
        code <<= kind(low + copy)
        code += riding.astype(kind)[:, None]
        code = code.ravel()
        code.sort()
        key = code >> kind(low + copy)
        fresh = np.r_[True, key[1:] != key[:-1]]
        keys, at = key[fresh].astype(np.int64), np.cumsum(fresh) - 1
        said = (code >> kind(copy)) & kind((1 << low) - 1)
        sums = np.bincount(at * classes + said.astype(np.int64), (code & kind(15)).astype(float), len(keys) * classes).reshape(-1, classes)
    group = keys // bins
    return (group // take * columns + own.ravel()[group]) * bins + keys - group * bins, sums


def _table(value: np.ndarray, spot: np.ndarray, lines: np.ndarray, nodes: int, bins: int) -> np.ndarray:
    """Sums of ``value`` by (feature, node, bin); ``lines`` has the rows' bins feature by feature."""
    out = np.zeros((len(lines), nodes * bins), complex)
    for start in range(0, len(spot), BLOCK_ROWS):
        stretch = slice(start, start + BLOCK_ROWS)
        at = spot[stretch] * bins
        for sums, line in zip(out, lines, strict=True):
            np.add.at(sums, at + line[stretch], value[stretch])
    return out.reshape(len(lines), nodes, bins)


def _halved(value: np.ndarray, spot: np.ndarray, lines: np.ndarray, count: np.ndarray, cut: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Like ``_table``, for pairs of siblings with ``count`` rows and their parents' places ``cut`` in the sums ``above``."""
    pair = np.arange(len(cut))
    few = count[1::2] < count[::2]
    small, large = 2 * pair + few, 2 * pair + 1 - few
    place = np.full(2 * len(cut), -1, np.int64)
    place[small] = pair
    own = place.take(spot)
    rows = np.flatnonzero(own >= 0)
    out = np.empty((len(lines), 2 * len(cut), above.shape[2]), complex)
    out[:, small] = _table(value[rows], own[rows], lines.take(rows, axis=1), len(cut), above.shape[2])
    out[:, large] = above[:, cut] - out[:, small]
    return out


def _held(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sums as those of ``_summed``."""
    sums = table.transpose(1, 0, 2).ravel()
    keys = np.flatnonzero(sums.real)
    return keys, np.stack([sums.real[keys], sums.imag[keys]], axis=1)


def _counted(growing: dict[int, tuple[Tree, int, int]], groups: int, columns: int, take: int, bins: int, classes: int,
             bootstrap: bool, seed: int, grid: float = 0.0) -> Callable[[Iterator], Iterator[tuple]]:
    """(tree, (keys, sums)) over the rows of a task, keys = (node * columns + feature) * bins + bin."""
    def run(parts: Iterator[tuple[tuple[int, int], _Block]]) -> Iterator[tuple]:
        out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for (_, group), b in parts:
            label = b.label.astype(np.int64) if classes else rounded(b.label, grid)
            lined = np.ascontiguousarray(b.bins)
            for t, (tree, first, active) in growing.items():
                if t % groups != group:
                    continue
                spot = tree.leaves(b.bins) - first
                times = copies(b.key, t, seed) if bootstrap else np.ones(len(b.key), np.int64)
                rows = np.flatnonzero((spot >= 0) & (times > 0))
                if not len(rows):
                    continue
                own = chosen_features(t, np.arange(first, first + active), columns, take, seed)
                found = _summed(label[rows], times[rows].astype(float), spot[rows], lined, rows, own, columns, bins, classes)
                out[t] = _merged(out[t], found) if t in out else found
        yield from out.items()

    return run


def _grown(trees: int, depth: int, groups: int, columns: int, take: int, bins: int, classes: int, bootstrap: bool, seed: int,
           weights: np.ndarray | None, least: tuple[int, int],
           grid: float = 0.0) -> Callable[[Iterator], Iterator[tuple[int, _Growing]]]:
    """Whole trees of a group, from all rows: those of a single part."""
    def run(parts: Iterator[tuple[tuple[int, int], _Block]]) -> Iterator[tuple[int, _Growing]]:
        blocks, group = [], 0
        for (_, group), b in parts:
            blocks.append(b)
        if not blocks:
            return
        bin_of = np.concatenate([np.ascontiguousarray(b.bins) for b in blocks])
        key, labels = np.concatenate([b.key for b in blocks]), np.concatenate([b.label for b in blocks])
        labels = labels.astype(np.int64) if classes else rounded(labels, grid)
        # a node of fewer rows has no cut; sums of a target are left whole, for their last digits hang on all rows before
        fewest = max(2 * least[0], least[1]) if classes else 0
        del blocks
        for t in range(group, trees, groups):
            g = _Growing.root(classes or 2)
            times = copies(key, t, seed) if bootstrap else np.ones(len(key), np.int64)
            rows = np.flatnonzero(times > 0)
            label, times, node = labels[rows], times[rows].astype(float), np.zeros(len(rows), np.int64)
            lines = None if take < columns else np.ascontiguousarray(bin_of[rows].T)
            sums, cut = None, None
            for _ in range(depth):
                if not len(node):
                    break
                spot = node - g.first
                if grid and lines is not None:
                    value = times + 1j * (times * label)
                    sums = (_table(value, spot, lines, g.active, bins) if sums is None else
                            _halved(value, spot, lines, g.stats[g.first:, 0], cut, sums))
                    found = _held(sums)
                else:
                    own = chosen_features(t, np.arange(g.first, g.first + g.active), columns, take, seed)
                    found = _summed(label, times, spot, bin_of, rows, own, columns, bins, classes, lines)
                cut = g.split(best_splits(*found, columns, bins, weights, *least))
                # rows of leaves have no say any more
                feature = g.feature.take(node)
                inner = np.flatnonzero(feature >= 0)
                if len(inner) < len(node):
                    rows, node, feature = rows[inner], node[inner], feature[inner]
                above = bin_of.ravel().take(rows * columns + feature) > g.cut.take(node)
                node = np.where(above, g.right.take(node), g.left.take(node)).astype(np.int64)
                if fewest:
                    kept = np.flatnonzero((g.stats[g.first:].sum(axis=1) >= fewest).take(node - g.first))
                    rows, node, inner = rows[kept], node[kept], inner[kept]
                if len(inner) < len(label):
                    label, times = label[inner], times[inner]
                    lines = None if lines is None else lines.take(inner, axis=1)
            yield t, g

    return run


def best_splits(keys: np.ndarray, sums: np.ndarray, columns: int, bins: int, weights: np.ndarray | None,
                least_rows: int, least_split: int) -> tuple[np.ndarray, ...]:
    """Per node: place, gain, feature, cut, sums left of the cut and of the node. A node without a cut has gain -1."""
    group = keys // bins
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    run = np.cumsum(sums, axis=0)
    size = np.diff(np.r_[start, len(keys)])
    before = np.repeat(run[start] - sums[start], size, axis=0)
    left = run - before
    whole = np.repeat(run[start + size - 1] - (run[start] - sums[start]), size, axis=0)
    right = whole - left

    def purity(s: np.ndarray) -> np.ndarray:
        if weights is None:
            return s[:, 1] ** 2 / np.maximum(s[:, 0], 1e-300)
        held, squares = np.zeros(len(s)), np.zeros(len(s))
        for k, w in enumerate(weights):
            own = s[:, k] * w
            held += own
            squares += own**2
        return squares / np.maximum(held, 1e-300)

    def rows(s: np.ndarray) -> np.ndarray:
        return s[:, 0] if weights is None else s.sum(axis=1)

    gain = purity(left) + purity(right) - purity(whole)
    fits = (rows(left) >= max(least_rows, 0.5)) & (rows(right) >= max(least_rows, 0.5)) & (rows(whole) >= least_split)
    gain = np.where(fits, gain, -1.0)
    node = group // columns
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    top = np.repeat(np.maximum.reduceat(gain, first), np.diff(np.r_[first, len(keys)]))
    _, at = np.unique(np.where(gain == top, node, -1), return_index=True)
    at = at[gain[at] == top[at]]
    return node[at], gain[at], group[at] % columns, keys[at] % bins, left[at], whole[at]


def fit_forest(df: DataFrame, columns: list[str], label: str, classes: int = 0, trees: int = 100, depth: int = 10,
               least_rows: int = 1, least_split: int = 2, feature_share: float | str = "sqrt", bootstrap: bool = True,
               class_weights: list[float] | None = None, seed: int = S.SEED,
               cuts: dict[str, list[float]] | None = None) -> Forest:
    """Grow a forest from rows with a non-NULL ``label`` (0, 1, ... for classes). Inputs must not be NULL.

    Each tree sees every row a Poisson number of times (``bootstrap``), each node ``feature_share`` of the inputs
    (``sqrt``: the root of their number). A leaf holds at least ``least_rows`` rows, a node that is cut
    ``least_split``. ``class_weights`` weigh the classes in cuts and values.
    """
    if not columns:
        raise ValueError("a forest needs inputs")
    cuts = fit_cuts(df, columns) if cuts is None else cuts
    bins = max((len(cuts[c]) for c in columns), default=0) + 1
    take = math.isqrt(len(columns)) if feature_share == "sqrt" else int(float(feature_share) * len(columns))
    take = min(max(take, 1), len(columns))
    weights = np.array(class_weights or [1.0] * classes) if classes else None
    width = classes or 2
    rows = df.count()
    parts = few_parts(rows, df.sparkSession.sparkContext.defaultParallelism)
    table = binned_table(df, columns, cuts, label, None, parts)
    largest = 0.0 if classes else table.agg(F.max(F.abs("label"))).first()[0]
    # a row stands in a sample up to a dozen times
    grid = sum_grid(rows, 16.0 * largest) if largest else 0.0
    picked = table.select("bins", "label", "held", "key")
    rdd = (picked.coalesce(1) if parts == 1 else picked).rdd.mapPartitions(_blocks(len(columns), 1, 0.0))
    parts = rdd.getNumPartitions()
    groups = min(trees, max(1, df.sparkSession.sparkContext.defaultParallelism // parts))
    dealt = rdd.mapPartitionsWithIndex(lambda p, it: (((p, g), b) for b in it for g in range(groups)))
    dealt = dealt.partitionBy(parts * groups, lambda k: k[0] * groups + k[1])
    if parts > 1:
        dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    growing = [_Growing.root(width) for _ in range(trees)]
    least = (least_rows, least_split)
    try:
        if parts == 1:
            # one job: a tree is grown where its rows are
            whole = _grown(trees, depth, groups, len(columns), take, bins, classes, bootstrap, seed, weights, least, grid)
            for t, g in dealt.mapPartitions(whole, True).collect():
                growing[t] = g
            depth = 0
        for _ in range(depth):
            open_ = {t: (g.routes(), g.first, g.active) for t, g in enumerate(growing) if g.active}
            if not open_:
                break
            summed = dealt.mapPartitions(_counted(open_, groups, len(columns), take, bins, classes, bootstrap, seed, grid), True)
            if parts > 1:
                summed = summed.reduceByKey(_merged, min(trees, parts * groups))
            found = dict(summed.mapValues(lambda s: best_splits(*s, len(columns), bins, weights, *least)).collect())
            for t in open_:
                if t in found:
                    growing[t].split(found[t])
                else:
                    growing[t].first = len(growing[t].feature)
    finally:
        dealt.unpersist()
        unstage(table)
    return Forest(tuple(columns), tuple(tuple(cuts[c]) for c in columns), classes, tuple(g.tree(weights) for g in growing))
