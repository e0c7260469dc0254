"""Contributions of the inputs to the predictions of tree ensembles, exact for the trees as they are.

A tree's answer for a set of known inputs is the mean over the training rows that reach a leaf when unknown inputs
let every branch pass in proportion to its rows. The contribution of an input is its Shapley value over all orders of
making inputs known. It is found leaf by leaf: along the path each input either lets the row through or not, so rows
fall into few patterns, and the weights of all subsets of a pattern come from one product of polynomials.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcare.plans.boosting import Boosted, Tree, binned_values
from stationcare.plans.forest import Forest
from stationcare.plans.train import Trained

#: inputs on a path up to which all their patterns are in one table, and rows that share the work on a path
FEW_INPUTS, ROWS_AT_ONCE = 12, 50_000


@dataclass(frozen=True)
class Path:
    """A leaf: the inputs on its path, the bins that each lets through, the share of rows each keeps, the value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kept: np.ndarray
    value: np.ndarray


def paths(tree: Tree) -> list[Path]:
    """The leaves of a tree. An input that is cut more than once on a path has one interval and one share."""
    out, open_ = [], [(0, {})] if len(tree.feature) else []
    while open_:
        node, seen = open_.pop()
        f = int(tree.feature[node])
        if f < 0:
            names = sorted(seen)
            low, high, kept = (np.array([seen[x][i] for x in names], float) for i in range(3))
            out.append(Path(np.array(names, np.int64), low, high, kept, np.atleast_1d(tree.value[node])))
            continue
        low, high, kept = seen.get(f, (-1.0, math.inf, 1.0))
        cut, whole = float(tree.cut[node]), max(float(tree.cover[node]), 1e-300)
        for child, bounds in ((tree.left[node], (low, min(high, cut))), (tree.right[node], (max(low, cut), high))):
            open_.append((int(child), seen | {f: (*bounds, kept * float(tree.cover[child]) / whole)}))
    return out


def _weights(n: int) -> np.ndarray:
    """Weight of a subset of s of the n - 1 other inputs."""
    return np.array([math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n) for s in range(n)])


def shares(passed: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """For patterns of inputs that let a row through (patterns x inputs), each input's part of the leaf's weight."""
    n = passed.shape[1]
    out, weights = np.zeros(passed.shape), _weights(n)
    for i in range(n):
        # coefficients of the product over the others of (passed * t + kept)
        poly = np.zeros((len(passed), n))
        poly[:, 0] = 1.0
        for j in range(n):
            if j != i:
                moved = poly[:, :-1] * passed[:, j:j + 1]
                poly = poly * kept[j]
                poly[:, 1:] += moved
        out[:, i] = (poly @ weights) * (passed[:, i] - kept[i])
    return out


def contributions(trees: list[Tree], bins: np.ndarray, columns: int, output: int = 0) -> tuple[np.ndarray, float]:
    """Contributions (rows x columns) to one output of the sum of the trees, and what the trees give with no input known."""
    out, base = np.zeros((columns, len(bins))), 0.0
    by_column = np.ascontiguousarray(bins.T)
    for path in (p for t in trees for p in paths(t)):
        value = float(path.value[min(output, len(path.value) - 1)])
        base += value * float(path.kept.prod())
        n = len(path.features)
        if not n or not len(bins):
            continue
        pattern = np.zeros(len(bins), np.int64 if n > 15 else np.int16)
        for i, (f, low, high) in enumerate(zip(path.features, path.low, path.high, strict=True)):
            own = by_column[f]
            inside = (own > int(low)) if low >= 0 else np.ones(len(own), bool)
            if high < math.inf:
                inside &= own <= int(high)
            pattern |= inside.astype(pattern.dtype) << i
        if n <= FEW_INPUTS:
            # a table of all patterns; only those that occur are worked out
            kinds, spot = np.flatnonzero(np.bincount(pattern, minlength=1 << n)), pattern
            table = np.zeros((1 << n, n))
            table[kinds] = value * shares(_bits(kinds, n), path.kept)
        else:
            kinds, spot = np.unique(pattern, return_inverse=True)
            table = value * shares(_bits(kinds, n), path.kept)
        for i, f in enumerate(path.features):
            out[f] += np.ascontiguousarray(table[:, i])[spot]
    return out.T, base


def _bits(kinds: np.ndarray, n: int) -> np.ndarray:
    return ((kinds.astype(np.int64)[:, None] >> np.arange(n)) & 1).astype(float)


def _parts(model: Boosted | Forest, output: int) -> tuple[list[Tree], float, float, int]:
    """Trees of one output, the factor of their sum, what is added to it, and the place of the output in their values."""
    if isinstance(model, Boosted):
        return [r[output] for r in model.rounds], 1.0, model.base, 0
    return list(model.trees), 1.0 / max(len(model.trees), 1), 0.0, output


def tree_attribution(trained: Trained, df: DataFrame, key: str = "id", of: str | None = None) -> DataFrame:
    """``key, base`` and ``phi_<input>``; ``base`` and all contributions add up to the answer of the model.

    The answer is the prediction of a regressor (before it is floored at zero), the probability of class ``of`` for a
    forest, and its score before the softmax for boosted trees. The trees travel with the tasks; rows stay where they are.
    """
    model, columns = trained.model, list(trained.selection.columns)
    if not isinstance(model, (Boosted, Forest)):
        raise ValueError(f"{trained.name} has no trees")
    if model.classes and of is None:
        raise ValueError("name the class to explain")
    trees, factor, added, place = _parts(model, list(trained.classes).index(of) if model.classes else 0)
    # without a row only the base comes out
    base = contributions(trees, np.zeros((0, len(columns)), np.uint8), len(columns), place)[1] * factor + added

    def told(waiting: list[np.ndarray]) -> pd.Series:
        phi, _ = contributions(trees, np.concatenate(waiting), len(columns), place)
        return pd.Series(list(phi * factor))

    @F.pandas_udf("array<double>")
    def explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        waiting: list[np.ndarray] = []
        for values in batches:
            waiting.append(binned_values(model.cuts, values.to_numpy(float)))
            if sum(map(len, waiting)) >= ROWS_AT_ONCE:
                yield told(waiting)
                waiting = []
        if waiting:
            yield told(waiting)

    filled = trained.selection.transform(df)
    phi = filled.select(key, explained(F.struct(*[F.col(c).cast("double").alias(c) for c in columns])).alias("_phi"))
    return phi.select(key, F.lit(float(base)).alias("base"), *[F.col("_phi")[i].alias(f"phi_{c}") for i, c in enumerate(columns)])
