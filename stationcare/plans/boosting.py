"""Gradient-boosted trees on Spark: one ensemble for any number of classes, or for a numeric target.

Rows are binned once (``operators.binning``) and kept as blocks of bytes over the cluster. A round grows one tree
per class, all of them level by level: each task adds the first and second derivatives of the loss of its rows into
sums by (node, bin) for every feature, the sums of a feature meet in one task, which finds the feature's best cut of
every node, and the driver picks among the features. The driver holds trees and one line per (feature, node), never
rows. Losses of a round are taken in the first pass of the next one; training stops once the validation rows have
not gained for ``patience`` rounds, and the best round is kept. A table of a single part (at most ``SMALL_PART`` rows)
has no sums that must meet, so its rounds follow each other inside one task instead of a job per level.

Derivatives of more than ``EXACT_ROWS`` rows are rounded to a grid so fine that all their sums are exact. The trees are then
the same however the rows lie, and the sums of a node are those of its parent less those of its sibling, so inside a task
only the rows of smaller siblings are added up.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.operators.binning import fit_cuts
from stationcare.session import staged, unstage

#: rounds after which the scores of the rows are written into the blocks
KEEP = 8
BLOCK_ROWS = 100_000
#: most rows of a table that stays in one task (about 150 bytes a row there), and of a partition of a larger one
SMALL_PART, LARGE_PART = 4_000_000, 1_000_000
#: rows above which sums are exact
EXACT_ROWS = 1_000_000


_INTS = ("feature", "cut", "left", "right")
_ALL = (*_INTS, "value", "cover", "gain")


def _bytes_text(values: np.ndarray, kind: str) -> dict:
    return {"shape": values.shape, "bytes": base64.b64encode(np.ascontiguousarray(values, kind)).decode()}


def _numbers(found: dict | list, kind: str) -> np.ndarray:
    """Lists are of models saved earlier."""
    if isinstance(found, list):
        return np.array(found)
    return np.frombuffer(base64.b64decode(found["bytes"]), kind).reshape(found["shape"])


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays; ``feature`` is -1 in a leaf, rows in a bin above ``cut`` go right."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @cached_property
    def _ways(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Feature and cut of each node and both ways out of it, side by side, and the longest way. A leaf leads to itself."""
        inner, own = self.feature >= 0, np.arange(len(self.feature))
        out = np.stack([np.where(inner, self.left, own), np.where(inner, self.right, own)], axis=1).astype(np.intp)
        level, depth = np.flatnonzero(inner[:1]), 0
        while len(level):
            reached = out[level].ravel()
            level, depth = reached[inner[reached]], depth + 1
        return np.maximum(self.feature, 0).astype(np.intp), self.cut, out.ravel(), depth

    def _step(self, bins: np.ndarray, start: np.ndarray, node: np.ndarray) -> np.ndarray:
        feature, cut, out, _ = self._ways
        above = bins.take(start + feature.take(node)) > cut.take(node)
        return out.take(2 * node + above)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node each row ends in."""
        node, start = np.zeros(len(bins), np.intp), np.arange(len(bins)) * bins.shape[1]
        flat = bins.ravel()
        for _ in range(self._ways[3]):
            node = self._step(flat, start, node)
        return node

    def below(self, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The node each row is in one level further down; rows in leaves stay. ``bins`` is read fastest if it lies row by row."""
        return self._step(bins.ravel(), np.arange(len(bins)) * bins.shape[1], node)

    def to_json(self) -> str:
        """Arrays as their bytes: a deep tree has some 200,000 numbers, which as digits take most of a save."""
        return json.dumps({n: _bytes_text(getattr(self, n), "<i4" if n in _INTS else "<f8") for n in _ALL})

    @classmethod
    def from_json(cls, text: str) -> Tree:
        d = json.loads(text)
        return cls(*[_numbers(d[n], "<i4" if n in _INTS else "<f8").astype(np.int64 if n in _INTS else float) for n in _ALL])


@dataclass
class _Growing:
    """A tree on the driver while it grows."""

    nodes: list[list] = field(default_factory=list)
    active: list[int] = field(default_factory=list)

    def add(self, grad: float, hess: float, penalty: float, rate: float) -> int:
        self.nodes.append([-1, 0, -1, -1, -rate * grad / (hess + penalty), hess, 0.0])
        return len(self.nodes) - 1

    def tree(self) -> Tree:
        columns = list(zip(*self.nodes, strict=True)) if self.nodes else [()] * len(_ALL)
        return Tree(*[np.array(c, np.int64 if n in _INTS else float) for n, c in zip(_ALL, columns, strict=True)])


@dataclass(frozen=True)
class Boosted:
    """A fitted ensemble. ``classes`` is 0 for a numeric target; ``rounds[r]`` has a tree per class."""

    columns: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    classes: int
    base: float
    rounds: tuple[tuple[Tree, ...], ...]
    losses: tuple[tuple[int, float, float | None], ...] = ()

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full((len(bins), max(self.classes, 1)), self.base)
        _add_rounds(out, bins, self.rounds)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``prediction`` and, for classes, ``probability`` as an array."""
        @F.pandas_udf("array<double>")
        def scored(values: pd.DataFrame) -> pd.Series:
            out = self.margins(binned_values(self.cuts, values.to_numpy(float)))
            return pd.Series(list(_softmax(out) if self.classes else out))

        own = F.struct(*[F.col(c).cast("double").alias(c) for c in self.columns])
        out = df.withColumn("_scores", scored(own))
        if not self.classes:
            return out.withColumn("prediction", F.col("_scores")[0]).drop("_scores")
        best = F.array_position("_scores", F.array_max("_scores")) - 1
        return out.withColumns({"prediction": best.cast("double"), "probability": F.col("_scores")}).drop("_scores")

    def importances(self) -> list[float]:
        """Share of each input in the gain of all splits."""
        total = np.zeros(len(self.columns))
        for tree in (t for trees in self.rounds for t in trees):
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return list(total / total.sum()) if total.sum() > 0 else list(total)

    def round_table(self, spark: SparkSession) -> DataFrame:
        """Loss of the training and validation rows after each round that was grown, and whether it was kept."""
        rows = [(r, a, b, r <= len(self.rounds)) for r, a, b in self.losses]
        return spark.createDataFrame(rows, "round long, train_loss double, validation_loss double, kept boolean")

    def to_rows(self) -> list[str]:
        """A header and one text per tree, round by round."""
        head = {"columns": self.columns, "cuts": self.cuts, "classes": self.classes, "base": self.base, "losses": self.losses}
        return [json.dumps(head), *[t.to_json() for trees in self.rounds for t in trees]]

    @classmethod
    def from_rows(cls, rows: list[str]) -> Boosted:
        head, trees = json.loads(rows[0]), [Tree.from_json(r) for r in rows[1:]]
        step = max(head["classes"], 1)
        rounds = tuple(tuple(trees[i:i + step]) for i in range(0, len(trees), step))
        return cls(tuple(head["columns"]), tuple(map(tuple, head["cuts"])), head["classes"], head["base"], rounds,
                   tuple(map(tuple, head["losses"])))


@dataclass(frozen=True)
class _Block:
    bins: np.ndarray
    label: np.ndarray
    held: np.ndarray
    key: np.ndarray
    score: np.ndarray


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _add_rounds(score: np.ndarray, bins: np.ndarray, rounds: tuple[tuple[Tree, ...], ...]) -> None:
    for trees in rounds:
        for k, tree in enumerate(trees):
            score[:, k] += tree.value[tree.leaves(bins)]


def derivatives(score: np.ndarray, label: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivative of the loss by each score, and the loss, per row."""
    if not classes:
        gap = score[:, 0] - label
        return gap[:, None], np.ones((len(gap), 1)), gap * gap
    p = _softmax(score)
    own = np.zeros_like(p)
    own[np.arange(len(p)), label.astype(np.int64)] = 1.0
    loss = -np.log(np.maximum((p * own).sum(axis=1), 1e-300))
    return p - own, np.maximum(2.0 * p * (1.0 - p), 1e-16), loss


def spread(key: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """Evenly spread 64-bit numbers, one for each key and turn."""
    x = key.view(np.uint64) ^ np.uint64((turn * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def drawn(key: np.ndarray, turn: int, share: float, seed: int) -> np.ndarray:
    """Rows that a round looks at: a hash of the row's own key, so a task that runs again draws the same."""
    if share >= 1.0:
        return np.ones(len(key), bool)
    return spread(key, turn, seed) < np.uint64(int(share * 2**64))


def binned_values(cuts: tuple[tuple[float, ...], ...], values: np.ndarray) -> np.ndarray:
    """Number of cuts at or below each value."""
    out = np.zeros((len(values), len(cuts)), np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(np.array(c), values[:, i], side="right")
    return out


def _blocks(columns: int, outputs: int, base: float) -> Callable[[Iterator], Iterator[_Block]]:
    def made(rows: list, before: int) -> _Block:
        # equal rows draw different numbers: the table is written, so a row keeps its place in its partition
        place = (before + np.arange(len(rows), dtype=np.int64)).view(np.uint64) * np.uint64(0xA0761D6478BD642F)
        key = np.array([r[3] for r in rows], np.int64).view(np.uint64) + place
        bins = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(len(rows), columns)
        return _Block(np.asfortranarray(bins), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], bool),
                      key.view(np.int64), np.full((len(rows), outputs), base))

    def run(rows: Iterator) -> Iterator[_Block]:
        waiting: list = []
        before = 0
        for row in rows:
            waiting.append(row)
            if len(waiting) == BLOCK_ROWS:
                yield made(waiting, before)
                before, waiting = before + len(waiting), []
        if waiting:
            yield made(waiting, before)

    return run


def sum_grid(rows: int, bound: float) -> float:
    """The power of two to whose multiples numbers up to ``bound`` are rounded, for sums of ``rows`` of them to be exact; 0
    leaves them as they are."""
    if rows <= EXACT_ROWS or not 0.0 < bound < math.inf:
        return 0.0
    return 2.0 ** (math.ceil(math.log2(rows)) + math.ceil(math.log2(bound)) - 52)


def rounded(values: np.ndarray, grid: float) -> np.ndarray:
    return np.rint(values / grid) * grid if grid else values


def _add_sums(out: dict[int, np.ndarray], lines: np.ndarray, spot: np.ndarray, value: np.ndarray, features: np.ndarray,
              nodes: int, bins: int) -> None:
    """Add rows to the sums by (node, bin) of every feature. ``lines`` has the rows' bins of one feature after the other, ``spot``
    the node of each row, ``value`` both derivatives as one complex number, which halves the passes over the rows."""
    if not len(spot):
        return
    at = spot * bins
    for f, line in zip(features, lines, strict=True):
        sums = np.zeros(nodes * bins, complex)
        np.add.at(sums, at + line, value)
        if int(f) in out:
            out[int(f)] += sums
        else:
            out[int(f)] = sums


def _lines(bins: np.ndarray, features: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.stack([bins[:, f].take(rows) for f in features])


def _losses(loss: np.ndarray, held: np.ndarray) -> list[float]:
    return [loss[~held].sum(), (~held).sum(), loss[held].sum(), held.sum()]


def _sums(fresh: tuple, growing: tuple[Tree, ...], slots: tuple[np.ndarray, ...], features: tuple[np.ndarray, ...],
          classes: int, bins: int, turn: int, share: float, seed: int, grid: float = 0.0) -> Callable[[Iterator[_Block]], Iterator[tuple]]:
    """Sums by (node, bin) of every feature over the blocks of a task, and under -1 the losses."""
    nodes = sum(int((s >= 0).sum()) for s in slots)

    def run(blocks: Iterator[_Block]) -> Iterator[tuple]:
        out: dict[int, np.ndarray] = {}
        losses = np.zeros(4)
        for b in blocks:
            score = b.score.copy()
            _add_rounds(score, b.bins, fresh)
            grad, hess, loss = derivatives(score, b.label, classes)
            losses += _losses(loss, b.held)
            grad, hess = rounded(grad, grid), rounded(hess, grid)
            seen = ~b.held & drawn(b.key, turn, share, seed)
            own = np.ascontiguousarray(b.bins)
            for k, tree in enumerate(growing):
                spot = slots[k][tree.leaves(own)]
                rows = np.flatnonzero(seen & (spot >= 0))
                _add_sums(out, _lines(b.bins, features[k], rows), spot[rows], grad[rows, k] + 1j * hess[rows, k], features[k], nodes, bins)
        yield -1, losses
        yield from out.items()

    return run


def best_cuts(sums: np.ndarray, bins: int, penalty: float, least: float) -> np.ndarray:
    """Per node: gain, cut, then first and second derivatives left of the cut and in the whole node."""
    g, h = (x.reshape(-1, bins) for x in sums)
    left_g, left_h = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = 0.5 * sum(sign * x**2 / np.maximum(y + penalty, 1e-300) for sign, x, y in (
        (1, left_g, left_h), (1, right_g, right_h), (-1, all_g, all_h)))
    gain[(left_h < least) | (right_h < least) | (left_h <= 0) | (right_h <= 1e-12)] = -np.inf
    cut = gain.argmax(axis=1)
    rows = np.arange(len(cut))
    return np.stack([gain[rows, cut], cut, left_g[rows, cut], left_h[rows, cut], all_g[:, 0], all_h[:, 0]], axis=1)


def _parts(rows: int, cores: int) -> int:
    """One part for few rows: going over them takes less than a job for each level."""
    return max(1, cores, math.ceil(rows / LARGE_PART)) if rows > SMALL_PART else 1


def few_parts(rows: int, cores: int) -> int:
    """As few parts as may be, for work that is also dealt by trees."""
    return max(min(math.ceil(rows / SMALL_PART), _parts(rows, cores)), math.ceil(rows / LARGE_PART)) if rows > SMALL_PART else 1


def binned_table(df: DataFrame, columns: list[str], cuts: dict[str, list[float]], label: str,
                 validation: str | None, parts: int) -> DataFrame:
    """``bins, label, held, key``: the inputs of a row as bytes; written once, read by every pass."""
    edges = tuple(tuple(cuts[c]) for c in columns)

    @F.pandas_udf("binary")
    def packed(values: pd.DataFrame) -> pd.Series:
        return pd.Series([r.tobytes() for r in binned_values(edges, values.to_numpy(float))])

    own = [F.col(c).cast("double").alias(c) for c in columns]
    held = F.coalesce(F.col(validation).cast("boolean"), F.lit(False)) if validation else F.lit(False)
    slim = df.select(packed(F.struct(*own)).alias("bins"), F.col(label).cast("double").alias("label"), held.alias("held"),
                     F.xxhash64(*own, F.col(label)).alias("key"))
    return staged(slim.repartition(parts, "key"), "binned")


def fit_boosted(df: DataFrame, columns: list[str], label: str, classes: int = 0, rounds: int = 100, depth: int = 6,
                rate: float = 0.3, row_share: float = 1.0, column_share: float = 1.0, penalty: float = 1.0,
                least_gain: float = 0.0, least_hessian: float = 1.0, validation: str | None = None,
                patience: int | None = None, seed: int = S.SEED, cuts: dict[str, list[float]] | None = None) -> Boosted:
    """Grow an ensemble from rows with a non-NULL ``label`` (0, 1, ... for classes). Inputs must not be NULL.

    Rows where ``validation`` is true steer only when to stop. ``least_hessian`` is the smallest sum of second
    derivatives of a leaf, ``least_gain`` the smallest gain of a split, ``penalty`` the weight of squared leaf values.
    """
    if not columns:
        raise ValueError("boosted trees need inputs")
    cuts = fit_cuts(df, columns) if cuts is None else cuts
    bins = max((len(cuts[c]) for c in columns), default=0) + 1
    rows = df.count()
    parts = _parts(rows, df.sparkSession.sparkContext.defaultParallelism)
    table = binned_table(df, columns, cuts, label, validation, parts)
    outputs = max(classes, 1)
    seen = table.where(~F.col("held")).agg(F.avg("label"), F.min("label"), F.max("label")).first() if not classes else (0.0, 0.0, 1.0)
    base = float(seen[0] or 0.0)
    # a gap between score and label may pass the largest at the start, not by far
    bound = 1.0 if classes else 2.0 * max(1.0, float(seen[2]) - base, base - float(seen[1])) if seen[0] is not None else 0.0
    picked = table.select("bins", "label", "held", "key")
    made = _blocks(len(columns), outputs, base)
    plan = _Plan(len(columns), outputs, rounds, depth, rate, row_share, column_share, penalty, least_gain, least_hessian, patience,
                 validation is not None, classes, bins, seed, sum_grid(rows, bound))
    if parts == 1:
        try:
            (done, losses), = picked.coalesce(1).rdd.mapPartitions(made).mapPartitions(plan.inside).collect()
        finally:
            unstage(table)
    else:
        done, losses = _across(picked.rdd.mapPartitions(made).persist(StorageLevel.MEMORY_AND_DISK), plan, table)
    return Boosted(tuple(columns), tuple(tuple(cuts[c]) for c in columns), classes, base, done, losses)


@dataclass(frozen=True)
class _Plan:
    """How an ensemble is grown, wherever its rows are."""

    columns: int
    outputs: int
    rounds: int
    depth: int
    rate: float
    row_share: float
    column_share: float
    penalty: float
    least_gain: float
    least_hessian: float
    patience: int | None
    held_any: bool
    classes: int
    bins: int
    seed: int
    grid: float = 0.0

    def run(self, level: Callable, ended: Callable) -> tuple[tuple, tuple]:
        """Kept rounds and losses. ``level`` gives the best cuts of the active nodes and, under -1, the losses of the
        rounds so far; ``ended`` hears of all rounds after each of them."""
        rng = np.random.default_rng(self.seed)
        done: list[tuple[Tree, ...]] = []
        losses: list[tuple[int, float, float | None]] = []
        best = 0

        def note(sums: np.ndarray) -> bool:
            """Losses after the rounds so far; whether to go on."""
            nonlocal best
            train, n, held, m = sums
            if not done:
                return True
            losses.append((len(done), float(train / n), float(held / m) if m else None))
            if not self.held_any or not m:
                best = len(done)
                return True
            if best == 0 or losses[-1][2] < losses[best - 1][2]:
                best = len(done)
            return self.patience is None or len(done) - best < self.patience

        while True:
            take = max(1, int(self.column_share * self.columns))
            features = tuple(np.sort(rng.permutation(self.columns)[:take]) for _ in range(self.outputs))
            growing = [_Growing() for _ in range(self.outputs)]
            for g in growing:
                g.active = [g.add(0.0, 0.0, 1.0, self.rate)]
            for step in range(self.depth):
                found = level(growing, features, step, done)
                if step == 0 and (not note(found[-1]) or len(done) == self.rounds):
                    growing = []
                    break
                if not _split(growing, found, features, self.penalty, self.least_gain, self.rate, first=step == 0):
                    break
            if not growing:
                break
            done.append(tuple(g.tree() for g in growing))
            ended(done)
        return tuple(done[:best]), tuple(losses)

    def slots(self, growing: list[_Growing]) -> tuple[np.ndarray, ...]:
        """Per tree the place of each active node among all of them, -1 for other nodes."""
        slots, at = [], 0
        for g in growing:
            slot = np.full(len(g.nodes), -1, np.int64)
            slot[g.active] = np.arange(at, at + len(g.active))
            at += len(g.active)
            slots.append(slot)
        return tuple(slots)

    def cuts(self, sums: np.ndarray) -> np.ndarray:
        return best_cuts(np.stack([sums.real, sums.imag]), self.bins, self.penalty, self.least_hessian)

    def inside(self, parts: Iterator[_Block]) -> Iterator[tuple[tuple, tuple]]:
        """All rounds over the rows of one task. A row keeps its node from level to level; rows that have a say are laid out
        feature by feature, and leave once they are in a leaf."""
        blocks = list(parts)
        lined = [np.ascontiguousarray(b.bins) for b in blocks]
        state: list[tuple] = []  # per block: node of each row by tree; rows with a say, their bins and derivatives by tree
        before: dict[int, np.ndarray] = {}  # sums of the level above, where the larger sibling is found by subtraction
        above: list[tuple[int, int]] = []

        def level(growing: list[_Growing], features: tuple, step: int, done: list) -> dict[int, np.ndarray]:
            nonlocal before, above
            out: dict[int, np.ndarray] = {}
            losses = np.zeros(4)
            if step == 0:
                state.clear()
                for b in blocks:
                    grad, hess, loss = derivatives(b.score, b.label, self.classes)
                    losses += _losses(loss, b.held)
                    rows = np.flatnonzero(~b.held & drawn(b.key, len(done), self.row_share, self.seed))
                    value = rounded(grad[rows], self.grid) + 1j * rounded(hess[rows], self.grid)
                    state.append(([np.zeros(len(b.label), np.intp) for _ in growing],
                                  [(rows, _lines(b.bins, own, rows), np.ascontiguousarray(value[:, k]))
                                   for k, own in enumerate(features)]))
            trees, slots = [g.tree() for g in growing], self.slots(growing)
            nodes = sum(len(g.active) for g in growing)
            pairs = _Pairs.of(growing, above) if self.grid and step else None
            for own, (at, say) in zip(lined, state, strict=True):
                for k, tree in enumerate(trees):
                    if step:
                        at[k] = tree.below(own, at[k])
                    rows, lines, value = say[k]
                    spot = slots[k].take(at[k].take(rows))
                    live = np.flatnonzero(spot >= 0)
                    # rows of leaves do no harm where few rows are picked below
                    if len(live) < (0.75 if pairs else 1) * len(rows):
                        rows, lines, value, spot = rows[live], lines.take(live, axis=1), value[live], spot[live]
                        say[k] = (rows, lines, value)
                    if pairs:
                        spot = pairs.place.take(spot)  # that of a leaf, -1, is the last one
                        fewer = np.flatnonzero(spot >= 0)
                        _add_sums(out, lines.take(fewer, axis=1), spot[fewer], value[fewer], features[k], len(pairs.small), self.bins)
                    else:
                        _add_sums(out, lines, spot, value, features[k], nodes, self.bins)
            if pairs:
                out = {f: pairs.whole(out.get(f), s, self.bins) for f, s in before.items()}
            before, above = out, [(k, node) for k, g in enumerate(growing) for node in g.active]
            return {-1: losses} | {f: self.cuts(s) for f, s in out.items()}

        def ended(done: list) -> None:
            for b, own, (at, _) in zip(blocks, lined, state, strict=True):
                for k, tree in enumerate(done[-1]):
                    b.score[:, k] += tree.value[tree.below(own, at[k])]

        yield self.run(level, ended)


@dataclass(frozen=True)
class _Pairs:
    """Siblings of a level: only the smaller of two is added up, the other is what is left of their parent."""

    place: np.ndarray
    small: np.ndarray
    large: np.ndarray
    parent: np.ndarray

    @classmethod
    def of(cls, growing: list[_Growing], above: list[tuple[int, int]]) -> _Pairs:
        where, at, small, large, parent = {p: i for i, p in enumerate(above)}, 0, [], [], []
        for k, g in enumerate(growing):
            own = {node[i]: p for p, node in enumerate(g.nodes) if node[0] >= 0 for i in (2, 3)}
            for left, right in zip(g.active[::2], g.active[1::2], strict=True):
                few = g.nodes[right][5] < g.nodes[left][5]
                small.append(at + few)
                large.append(at + 1 - few)
                parent.append(where[k, own[left]])
                at += 2
        place = np.full(at + 1, -1, np.int64)
        place[small] = np.arange(len(small))
        return cls(place, *[np.array(x, np.int64) for x in (small, large, parent)])

    def whole(self, sums: np.ndarray | None, above: np.ndarray, bins: int) -> np.ndarray:
        """Sums of all nodes from those of the smaller ones and of the level above."""
        out = np.zeros((2 * len(self.small), bins), complex)
        if sums is not None:
            out[self.small] = sums.reshape(-1, bins)
        out[self.large] = above.reshape(-1, bins)[self.parent] - out[self.small]
        return out.ravel()


def _across(blocks: RDD, plan: _Plan, table: DataFrame) -> tuple[tuple, tuple]:
    """All rounds over blocks in several partitions, a job for each level."""
    folded, old = 0, None

    def level(growing: list[_Growing], features: tuple, step: int, done: list) -> dict[int, np.ndarray]:
        nonlocal old
        summed: RDD = blocks.mapPartitions(_sums(tuple(done[folded:]), tuple(g.tree() for g in growing), plan.slots(growing), features,
                                                 plan.classes, plan.bins, len(done), plan.row_share, plan.seed, plan.grid))
        if blocks.getNumPartitions() > 1:
            summed = summed.reduceByKey(np.add, min(blocks.getNumPartitions(), plan.columns + 1))
        found = dict(summed.map(lambda kv: (kv[0], kv[1] if kv[0] < 0 else plan.cuts(kv[1]))).collect())
        if old is not None:
            old.unpersist()
            old = None
        return found

    def ended(done: list) -> None:
        nonlocal blocks, folded, old
        if len(done) - folded >= KEEP:
            fresh, folded, old = tuple(done[folded:]), len(done), blocks
            blocks = blocks.map(lambda b, fresh=fresh: _folded(b, fresh)).persist(StorageLevel.MEMORY_AND_DISK)

    try:
        return plan.run(level, ended)
    finally:
        for rdd in (old, blocks):
            if rdd is not None:
                rdd.unpersist()
        unstage(table)


def _folded(block: _Block, fresh: tuple[tuple[Tree, ...], ...]) -> _Block:
    score = block.score.copy()
    _add_rounds(score, block.bins, fresh)
    return _Block(block.bins, block.label, block.held, block.key, score)


def _split(growing: list[_Growing], found: dict[int, np.ndarray], features: tuple[np.ndarray, ...], penalty: float,
           least_gain: float, rate: float, first: bool) -> bool:
    """Split the nodes of this level where that gains; whether any node was."""
    at, any_split = 0, False
    for g, own in zip(growing, features, strict=True):
        active, g.active = g.active, []
        lines = [(f, found[int(f)][at:at + len(active)]) for f in own if int(f) in found]
        for i, node in enumerate(active):
            if not lines:
                continue
            f, line = max(((f, x[i]) for f, x in lines), key=lambda c: (c[1][0], -c[0]))
            gain, cut, left_g, left_h, all_g, all_h = line
            if first:  # the root learns here what is in it
                g.nodes[node][4:6] = [-rate * all_g / (all_h + penalty), all_h]
            if not np.isfinite(gain) or gain <= least_gain or gain <= 1e-12:
                continue
            left = g.add(left_g, left_h, penalty, rate)
            right = g.add(all_g - left_g, all_h - left_h, penalty, rate)
            g.nodes[node][:4] = [int(f), int(cut), left, right]
            g.nodes[node][6] = float(gain)
            g.active += [left, right]
            any_split = True
        at += len(active)
    return any_split
