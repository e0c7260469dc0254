"""Contributions of inputs against all subsets, for small trees."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationcare.operators.select import Selection
from stationcare.plans.attribution import contributions, tree_attribution
from stationcare.plans.boosting import binned_values, fit_boosted
from stationcare.plans.forest import fit_forest
from stationcare.plans.train import Trained

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.integers(0, 12, (800, 4)).astype(float), columns=COLUMNS)
    pdf["r"] = pdf["a"] * pdf["b"] + np.where(pdf["c"] > 6, 20, 0) + rng.normal(0, 1, 800)
    pdf["y"] = (pdf["r"] > 40).astype(float) + (pdf["d"] > 9)
    return spark.createDataFrame(pdf.assign(id=np.arange(800))).repartition(3).persist()


def answer(tree, bins, known, output, node=0):
    """The tree's mean answer where only some inputs are known."""
    f = tree.feature[node]
    if f < 0:
        return float(np.atleast_1d(tree.value[node])[output])
    left, right = tree.left[node], tree.right[node]
    if f in known:
        return answer(tree, bins, known, output, left if bins[f] <= tree.cut[node] else right)
    return sum(answer(tree, bins, known, output, c) * tree.cover[c] for c in (left, right)) / tree.cover[node]


def shapley(trees, bins, output):
    n, out = len(bins), np.zeros(len(bins))
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for s in range(n):
            weight = math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n)
            for known in combinations(others, s):
                out[i] += weight * sum(answer(t, bins, {*known, i}, output) - answer(t, bins, set(known), output) for t in trees)
    return out


def models(table):
    return [(fit_boosted(table, COLUMNS, "r", 0, 4, 4, .3), 0), (fit_boosted(table, COLUMNS, "y", 3, 3, 3, .3), 1),
            (fit_forest(table, COLUMNS, "y", 3, 3, 5, 5), 2), (fit_forest(table, COLUMNS, "r", 0, 3, 6, 5, feature_share=1.0), 0)]


def test_contributions_equal_all_subsets(table):
    rows = table.orderBy("id").limit(12).select(*COLUMNS).toPandas().to_numpy()
    for model, output in models(table):
        boosted = hasattr(model, "rounds")
        trees = [r[output] for r in model.rounds] if boosted else list(model.trees)
        bins = binned_values(model.cuts, rows)
        got, base = contributions(trees, bins, 4, 0 if boosted else output)
        for i, b in enumerate(bins):
            np.testing.assert_allclose(got[i], shapley(trees, b, 0 if boosted else output), atol=1e-9)
            whole = sum(answer(t, b, {0, 1, 2, 3}, 0 if boosted else output) for t in trees)
            assert got[i].sum() + base == pytest.approx(whole, abs=1e-9)


def test_contributions_and_base_give_the_prediction(table):
    for model, output in models(table):
        classes = ("x", "y", "z") if model.classes else ()
        kept = Trained("any", "rul", "-", model, Selection(COLUMNS, {}), classes)
        phi = tree_attribution(kept, table, of=classes[output] if classes else None)
        total = phi.select("id", (sum(F.col(f"phi_{c}") for c in COLUMNS) + F.col("base")).alias("t"))
        scored = model.transform(table).join(total, "id").toPandas()
        if not classes:
            np.testing.assert_allclose(scored["t"], scored["prediction"], atol=1e-9)
        elif not hasattr(model, "rounds"):
            np.testing.assert_allclose(scored["t"], np.vstack(scored["probability"])[:, output], atol=1e-9)
        else:
            p = np.vstack(scored["probability"])
            e = np.log(p[:, output])  # scores differ from log shares by one number per row
            others = [tree_attribution(kept, table, of=c).select("id", (sum(F.col(f"phi_{x}") for x in COLUMNS)
                      + F.col("base")).alias("t")).orderBy("id").toPandas()["t"] for c in classes]
            scores = np.stack(others, axis=1)[scored["id"]]
            np.testing.assert_allclose(e, scores[:, output] - np.log(np.exp(scores).sum(axis=1)), atol=1e-9)


def test_attribution_refuses_what_it_cannot_explain(table):
    model = fit_forest(table, COLUMNS, "y", 3, 1, 2)
    with pytest.raises(ValueError):
        tree_attribution(Trained("f", "classification", "-", model, Selection(COLUMNS, {}), ("x", "y", "z")), table)
    with pytest.raises(ValueError):
        tree_attribution(Trained("l", "rul", "-", object(), Selection(COLUMNS, {})), table)
    got = tree_attribution(Trained("f", "classification", "-", model, Selection(COLUMNS, {}), ("x", "y", "z")), table.limit(0), of="x")
    assert got.collect() == []


def test_patterns_in_a_table_and_sorted_patterns_agree(monkeypatch):
    import numpy as np

    from stationcare.plans import attribution as A
    from stationcare.plans.boosting import Tree

    tree = Tree(np.array([0, 1, -1, -1, 2, -1, -1]), np.array([4, 2, 0, 0, 7, 0, 0]), np.array([1, 2, -1, -1, 5, -1, -1]),
                np.array([4, 3, -1, -1, 6, -1, -1]), np.array([0, 0, 1., 2, 0, 3, 5]), np.array([10, 6, 2., 4, 4, 1, 3]), np.zeros(7))
    bins = np.random.default_rng(1).integers(0, 10, (200, 3)).astype(np.uint8)
    table, base = A.contributions([tree], bins, 3)
    monkeypatch.setattr(A, "FEW_INPUTS", 0)
    np.testing.assert_array_equal(table, A.contributions([tree], bins, 3)[0])
    np.testing.assert_allclose(table.sum(axis=1) + base, tree.value[tree.leaves(bins)])


def test_neighbours_in_many_dimensions_are_exact():
    import numpy as np

    from stationcare.operators.balance import _nearest

    rng = np.random.default_rng(2)
    points = np.round(rng.normal(1e5, 3, (700, 12)), 1)
    points[300:330] = points[0]
    ids = np.arange(700)
    row, gap, near = _nearest(points, ids, points, ids, 5)
    for i in range(0, 700, 7):
        exact = np.zeros(700)
        for d in range(12):
            exact += (points[i, d] - points[:, d]) ** 2
        want = [j for j in np.lexsort((ids, exact)) if j != i][:5]
        assert near[row == i].tolist() == want and (gap[row == i] == exact[want]).all()
