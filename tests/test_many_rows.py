"""What is done otherwise for tables of many rows gives what small tables get."""

import numpy as np
import pandas as pd
import pytest

from stationcare.operators import binning, quantiles
from stationcare.operators.binning import fit_cuts
from stationcare.operators.quantiles import quantile_values
from stationcare.plans import boosting, forest
from stationcare.plans.boosting import fit_boosted
from stationcare.plans.forest import fit_forest

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 4000
    a, b, c = rng.integers(0, 60, n).astype(float), np.round(rng.normal(0, 3, n), 1), rng.integers(0, 3, n).astype(float)
    frame = pd.DataFrame({"a": a, "b": b, "c": c, "y": rng.integers(0, 3, n) * (a > 20), "r": a / 7 + b * b + rng.normal(0, .2, n),
                          "v": rng.random(n) < .2})
    return spark.createDataFrame(frame.astype({"y": float})).repartition(3).persist()


def shape(trees):
    return [(t.feature.tolist(), t.cut.tolist(), t.value.tolist()) for t in trees]


def test_some_million_rows_are_one_part():
    assert boosting._parts(3_000_000, 8) == boosting.few_parts(3_000_000, 8) == 1
    assert boosting._parts(30_000_000, 8) > 8 and boosting.few_parts(30_000_000, 8) > 8


@pytest.mark.parametrize("label, classes", [("r", 0), ("y", 3)])
def test_boosted_trees_are_the_same_however_rows_lie(table, monkeypatch, label, classes):
    monkeypatch.setattr(boosting, "EXACT_ROWS", 100)
    cuts = fit_cuts(table, COLUMNS)
    given = dict(rounds=4, depth=5, row_share=1.0, validation="v", cuts=cuts)
    added = []
    kept = boosting._add_sums
    monkeypatch.setattr(boosting, "_add_sums", lambda out, lines, *rest: (added.append(lines.shape[1]), kept(out, lines, *rest)))
    blocks = [r for part in _blocks(table, label, cuts) for r in part]
    plan = boosting._Plan(3, max(classes, 1), 4, 5, .3, 1.0, 1.0, 1.0, 0.0, 1.0, None, True, classes,
                          max(map(len, cuts.values())) + 1, 42, boosting.sum_grid(4000, 100.0))
    list(plan.inside(iter(blocks)))
    # below the root only the rows of smaller siblings are added up
    seen = sum(int((~b.held).sum()) for b in blocks) * max(classes, 1)
    assert sum(added) < seen * (5 + 4 * 4 / 2 + .1)
    one = fit_boosted(table, COLUMNS, label, classes, **given)
    monkeypatch.setattr(boosting, "SMALL_PART", 500)
    monkeypatch.setattr(boosting, "LARGE_PART", 1500)
    many = fit_boosted(table, COLUMNS, label, classes, **given)
    assert shape(t for r in one.rounds for t in r) == shape(t for r in many.rounds for t in r) and len(one.rounds) > 0
    monkeypatch.setattr(boosting, "EXACT_ROWS", 10**9)
    plain = fit_boosted(table, COLUMNS, label, classes, **given)
    for x, y in zip((t for r in one.rounds for t in r), (t for r in plain.rounds for t in r), strict=True):
        assert x.feature.tolist() == y.feature.tolist() and x.cut.tolist() == y.cut.tolist()
        assert np.allclose(x.value, y.value, atol=1e-9) and np.allclose(x.cover, y.cover)


def _blocks(table, label, cuts):
    rows = table.select(*COLUMNS, label, "v").toPandas()
    bins = boosting.binned_values(tuple(tuple(cuts[c]) for c in COLUMNS), rows[COLUMNS].to_numpy(float))
    outputs = 3 if label == "y" else 1
    made = boosting._blocks(3, outputs, 0.0)
    packed = [(b.tobytes(), y, bool(v), i) for i, (b, y, v) in enumerate(zip(bins, rows[label], rows["v"], strict=True))]
    return [list(made(iter(packed[:1500]))), list(made(iter(packed[1500:])))]


def test_a_forest_adds_up_smaller_siblings_only(table, monkeypatch):
    given = dict(trees=3, depth=5, least_rows=25, feature_share=1.0, cuts=fit_cuts(table, COLUMNS))
    plain = fit_forest(table, COLUMNS, "r", **given)
    monkeypatch.setattr(boosting, "EXACT_ROWS", 100)
    exact = fit_forest(table, COLUMNS, "r", **given)
    for x, y in zip(exact.trees, plain.trees, strict=True):
        assert x.feature.tolist() == y.feature.tolist() and x.cut.tolist() == y.cut.tolist()
        assert np.allclose(x.value, y.value, atol=1e-9) and x.cover.tolist() == y.cover.tolist()
    rng = np.random.default_rng(2)
    spot, lines = np.sort(rng.integers(0, 4, 300)), rng.integers(0, 8, (2, 300)).astype(np.uint8)
    value = np.ones(300) + 1j * rng.integers(-9, 9, 300)
    above = forest._table(value, spot // 2 + 1, lines, 3, 8)
    below = forest._halved(value, spot, lines, np.bincount(spot), np.array([1, 2]), above)
    assert (below == forest._table(value, spot, lines, 4, 8)).all()
    monkeypatch.setattr(boosting, "SMALL_PART", 500)
    monkeypatch.setattr(boosting, "LARGE_PART", 1500)
    parts = fit_forest(table, COLUMNS, "r", **given)
    assert [t.cover[0] > 0 for t in parts.trees] == [True] * 3


def test_cuts_of_many_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 300_000
    many, few = rng.normal(0, 1, n), rng.integers(0, 200, n).astype(float)
    few[:50] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"many": many, "few": few, "one": 1.0})).selectExpr(
        "many", "few", "one", "cast(null AS double) AS none", "CASE WHEN one > 0 THEN -0.0 END AS zero")
    cuts = fit_cuts(df, ["none", "few", "many", "one", "zero"], rows=n)
    assert cuts["few"] == [i + .5 for i in range(199)] and cuts["none"] == cuts["one"] == cuts["zero"] == []
    shares = np.searchsorted(np.sort(many), cuts["many"]) / n
    assert len(cuts["many"]) == 255 and np.abs(shares - np.arange(1, 256) / 256).max() < 2.5e-4


def test_equal_values_in_a_bracket_are_counted_not_listed(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, 250_000).astype(float)
    wide = rng.normal(0, 1, 250_000)
    wide[:3] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"x": x, "wide": wide})).selectExpr("x", "wide", "CASE WHEN x > 0 THEN 5 END AS y").repartition(4)
    listed = quantiles._looked_up(df, ["x"], [("x", 250_000, 1.0, 2.0, 0, .5)])
    assert listed.count() <= 3 * (4 + 250_000 // quantiles.CHUNK + 1)
    assert listed.selectExpr("sum(below)", "sum(inside)", "sum(c)").first()[:] == (int((x == 0).sum()), *[int((x > 0).sum())] * 2)
    for limit in (200_000, 50):  # the second must narrow its brackets
        found = quantile_values(df, ["x", "wide", "y"], [.1, .5, .999], rows=250_000, bracket_limit=limit)
        assert found["x"] == list(np.quantile(x, [.1, .5, .999])) and found["y"] == [5.0] * 3
        assert np.allclose(found["wide"], np.quantile(np.where(np.isnan(wide), np.inf, wide), [.1, .5, .999]), atol=1e-12)
