"""Boosted trees and forests against plain versions that look at all rows at once."""

import numpy as np
import pandas as pd
import pytest

from stationcare import settings as S
from stationcare.operators.binning import fit_cuts
from stationcare.operators.select import Selection
from stationcare.plans import models as M
from stationcare.plans import scoring, train
from stationcare.plans.boosting import Boosted, fit_boosted
from stationcare.plans.forest import Forest, copies, fit_forest

COLUMNS = ["a", "b", "c"]


def frame(n=1000, seed=4):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 60, n).astype(float), np.round(rng.normal(0, 3, n), 1), rng.integers(0, 3, n).astype(float)
    y = ((a > 31) + (b + rng.normal(0, 1, n) > 1.5)).astype(float)
    return pd.DataFrame({"a": a, "b": b, "c": c, "y": y, "r": a / 7 + b * b + rng.normal(0, .2, n), "v": rng.random(n) < .2})


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(frame()).repartition(3).persist()


def test_cuts_stand_between_all_values_or_at_quantiles(spark):
    rng = np.random.default_rng(1)
    many = rng.normal(0, 1, 5000)
    df = spark.createDataFrame(pd.DataFrame({"few": np.r_[np.nan, rng.integers(0, 256, 4999)], "many": many, "one": 1.0}))
    df = df.selectExpr("nullif(few, 7) AS few", "many", "one", "cast(null AS double) AS none")
    cuts = fit_cuts(df, ["none", "few", "many", "one"])
    values = sorted({r[0] for r in df.select("few").distinct().collect() if r[0] is not None and not np.isnan(r[0])})
    assert cuts["few"] == [(a + b) / 2 for a, b in zip(values[:-1], values[1:])] and cuts["none"] == cuts["one"] == []
    shares = [(many < c).mean() for c in cuts["many"]]
    assert len(cuts["many"]) == 255 and np.abs(np.diff([0, *shares, 1]) - 1 / 256).max() < 2e-3
    assert fit_cuts(df.limit(0), ["few"]) == {"few": []} and fit_cuts(df, []) == {}


def plain_boosted(X, y, classes, rounds, depth, rate, penalty=1.0, least=1.0, least_gain=0.0):
    """Margins after the last round, trees grown one node at a time over the rows themselves."""
    base = 0.0 if classes else y.mean()
    score = np.full((len(X), max(classes, 1)), base)

    def grow(rows, g, h, level, out):
        G, H = g[rows].sum(), h[rows].sum()
        best = None
        for f in range(X.shape[1]) if level < depth else ():
            values = np.unique(X[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                left = rows[X[rows, f] < cut]
                GL, HL = g[left].sum(), h[left].sum()
                if HL < least or H - HL < least:
                    continue
                gain = .5 * (GL**2 / (HL + penalty) + (G - GL)**2 / (H - HL + penalty) - G**2 / (H + penalty))
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, cut
        if best is None or best[0] <= max(least_gain, 1e-12):
            out[rows] = -rate * G / (H + penalty)
            return
        grow(rows[X[rows, best[1]] < best[2]], g, h, level + 1, out)
        grow(rows[X[rows, best[1]] >= best[2]], g, h, level + 1, out)

    for _ in range(rounds):
        if classes:
            e = np.exp(score - score.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            G, H = p - np.eye(classes)[y.astype(int)], 2 * p * (1 - p)
        else:
            G, H = score - y[:, None], np.ones((len(X), 1))
        for k in range(score.shape[1]):
            out = np.zeros(len(X))
            grow(np.arange(len(X)), G[:, k], H[:, k], 0, out)
            score[:, k] += out
    return score


def test_boosted_classes_equal_the_plain_version(table):
    pdf = frame()
    want = plain_boosted(pdf[COLUMNS].to_numpy(), pdf["y"].to_numpy(), 3, 4, 3, .3)
    model = fit_boosted(table, COLUMNS, "y", 3, 4, 3, .3)
    got = model.transform(table).select(*COLUMNS, "y", "probability", "prediction").toPandas()
    p = np.vstack(got["probability"])
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-12 and (p.argmax(axis=1) == got["prediction"]).all()
    e = np.exp(want)
    q = e / e.sum(axis=1, keepdims=True)
    loss = -np.log(q[np.arange(len(q)), pdf["y"].astype(int)]).mean()
    assert -np.log(p[np.arange(len(p)), got["y"].astype(int)]).mean() == pytest.approx(loss, abs=1e-9)
    assert model.losses[-1][1] == pytest.approx(loss, abs=1e-9) and len(model.rounds) == 4


def test_boosted_numbers_equal_the_plain_version(table):
    pdf = frame()
    want = plain_boosted(pdf[COLUMNS].to_numpy(), pdf["r"].to_numpy(), 0, 5, 4, .2, least=3, least_gain=.1)[:, 0]
    model = fit_boosted(table, COLUMNS, "r", 0, 5, 4, .2, least_hessian=3, least_gain=.1)
    got = model.transform(table).select("r", "prediction").toPandas()
    assert ((got["prediction"] - got["r"])**2).mean() == pytest.approx(((want - pdf["r"])**2).mean(), abs=1e-9)
    again = Boosted.from_rows(model.to_rows()).transform(table).select("r", "prediction").toPandas()
    assert (again["prediction"] == got["prediction"]).all()


def test_stopping_keeps_the_best_round(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.random(600), "b": rng.random(600), "r": rng.random(600), "v": np.arange(600) % 3 == 0})
    pdf["r"] += pdf["a"]
    df = spark.createDataFrame(pdf)
    model = fit_boosted(df, ["a", "b"], "r", 0, 100, 6, .3, validation="v", patience=10)
    rounds = model.round_table(spark).orderBy("round").toPandas()
    best = int(rounds["round"][rounds["validation_loss"].idxmin()])
    assert len(model.rounds) == best == rounds["kept"].sum() and len(rounds) == best + 10 < 100
    held = pdf[pdf["v"]]
    got = model.transform(spark.createDataFrame(held)).select("r", "prediction").toPandas()
    assert ((got["r"] - got["prediction"])**2).mean() == pytest.approx(rounds["validation_loss"].min(), abs=1e-9)
    whole = fit_boosted(df, ["a", "b"], "r", 0, 12, 6, .3)
    assert len(whole.rounds) == 12 and whole.losses[-1][2] is None


def test_partitions_do_not_change_the_trees(spark, monkeypatch):
    from stationcare.plans import boosting

    df = spark.createDataFrame(frame(3000))
    one = [fit_boosted(df, COLUMNS, "y", 3, 9, 3, .3), fit_forest(df, COLUMNS, "y", 3, 3, 6, bootstrap=False)]
    monkeypatch.setattr(boosting, "SMALL_PART", 500)
    many = [fit_boosted(df, COLUMNS, "y", 3, 9, 3, .3), fit_forest(df, COLUMNS, "y", 3, 3, 6, bootstrap=False)]
    trees = [[t for r in m[0].rounds for t in r] + list(m[1].trees) for m in (one, many)]
    assert len(trees[0]) == len(trees[1]) == 30
    for a, b in zip(*trees):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all()
        np.testing.assert_allclose(a.value, b.value, atol=1e-9)


def plain_tree(X, y, weights, depth, least, split):
    """Class shares per row of one Gini tree over all rows and inputs."""
    out = np.zeros((len(X), len(weights)))

    def purity(rows):
        held = np.bincount(y[rows], minlength=len(weights)) * weights
        return (held**2).sum() / max(held.sum(), 1e-300)

    def grow(rows, level):
        best = None
        for f in range(X.shape[1]) if level < depth and len(rows) >= split else ():
            values = np.unique(X[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                left, right = rows[X[rows, f] < cut], rows[X[rows, f] >= cut]
                if min(len(left), len(right)) < least:
                    continue
                gain = purity(left) + purity(right) - purity(rows)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, left, right
        if best is None or best[0] <= 1e-9:
            held = np.bincount(y[rows], minlength=len(weights)) * weights
            out[rows] = held / held.sum()
        else:
            grow(best[1], level + 1)
            grow(best[2], level + 1)

    grow(np.arange(len(X)), 0)
    return out


def test_a_tree_equals_the_plain_version(spark):
    pdf = frame(400).assign(id=np.arange(400))
    want = plain_tree(pdf[COLUMNS].to_numpy(), pdf["y"].astype(int).to_numpy(), np.array([1., 10., 35.]), 5, 4, 20)
    df = spark.createDataFrame(pdf).repartition(3)
    model = fit_forest(df, COLUMNS, "y", 3, 1, 5, 4, 20, 1.0, False, [1., 10., 35.])
    got = Forest.from_rows(model.to_rows()).transform(df).orderBy("id").select("probability").toPandas()
    np.testing.assert_allclose(np.vstack(got["probability"]), want, atol=1e-9)
    assert sum(model.importances()) == pytest.approx(1.0)


def test_a_forest_learns_and_its_samples_are_poisson(table):
    draws = copies(np.arange(20_000).astype(np.int64), 3, 42)
    assert abs(draws.mean() - 1) < .03 and abs((draws == 0).mean() - np.exp(-1)) < .02
    got = fit_forest(table, COLUMNS, "r", 0, 20, 8, 5, feature_share=1.0).transform(table).select("r", "prediction").toPandas()
    assert ((got["r"] - got["prediction"])**2).mean() < .05 * got["r"].var()
    same = [fit_forest(table, COLUMNS, "y", 3, 3, 4, seed=s).to_rows() for s in (1, 1, 2)]
    assert same[0] == same[1] != same[2]


def test_one_class_one_value_and_no_inputs(spark):
    df = spark.createDataFrame([(1.0, 0.0)] * 5, "a double, y double")
    for model in (fit_boosted(df, ["a"], "y", 1, 3, 3), fit_forest(df, ["a"], "y", 1, 2, 3), fit_boosted(df, ["a"], "y", 0, 3, 3)):
        assert {r["prediction"] for r in model.transform(df).collect()} == {0.0}
    with pytest.raises(ValueError):
        fit_forest(df, [], "y")
    with pytest.raises(ValueError):
        M.linear("no such model")


@pytest.mark.parametrize("name", ["boosted_trees", "random_forest", "decision_tree", "logistic_regression"])
def test_published_models_come_back(spark, table, tmp_path, name):
    few = {"random_forest": {"numTrees": 3}, "boosted_trees": {"maxIter": 3}}.get(name, {})
    rows = table.withColumn(M.LABEL, table["y"])
    model = M.fit_model(name, "classification", rows, COLUMNS, 3, class_weights=[1., 2., 3.], **few)
    kept = train.Trained(name, "classification", "-", model, Selection(COLUMNS, {}), ("x", "y", "z"))
    scoring.save_model(kept, str(tmp_path), "s")
    back = scoring.load_model(spark, str(tmp_path), "s", "classification", "-", name)
    assert back.classes == kept.classes and back.selection.columns == COLUMNS
    a, b = (sorted(r["prediction"] for r in m.model.transform(table).collect()) for m in (kept, back))
    assert a == b
    total = train.importances(back).agg({"importance": "sum"}).first()[0]
    assert total == pytest.approx(1.0) if name != "logistic_regression" else total > 0
    assert train.importances(back, top=2).count() == 2


def test_a_broken_publication_leaves_the_old_model(spark, table, tmp_path, monkeypatch):
    rows = table.withColumn(M.LABEL, table["y"])

    def kept(rounds):
        return train.Trained("boosted_trees", "classification", "-", M.fit_model(
            "boosted_trees", "classification", rows, COLUMNS, 3, maxIter=rounds), Selection(COLUMNS, {}), ("x", "y", "z"))

    def rounds():
        return len(scoring.load_model(spark, str(tmp_path), "s", "classification", "-", "boosted_trees").model.rounds)

    scoring.save_model(kept(1), str(tmp_path), "s")
    with monkeypatch.context() as m:
        m.setattr(scoring, "_content", lambda *_: 1 / 0)  # breaks off after the files, before the row
        with pytest.raises(ZeroDivisionError):
            scoring.save_model(kept(2), str(tmp_path), "s")
    assert rounds() == 1
    path = scoring.save_model(kept(3), str(tmp_path), "s")
    assert rounds() == 3 and S.FALLBACK_MODELS["rul"] == "boosted_trees"
    newest = spark.read.schema(scoring.BUNDLE).json(f"{path}/bundle").orderBy("version").collect()[-1]["folder"]
    spark.read.parquet(newest).limit(1).write.mode("append").parquet(newest)
    with pytest.raises(ValueError):
        rounds()


def test_a_table_of_one_part_is_trained_without_a_job_per_level(spark, table):
    """Boosted trees and forests took a job (or two stages) for each level; now the fit itself is one."""
    sc = spark.sparkContext
    cuts = fit_cuts(table, COLUMNS)
    used = []
    for name, fit in (("boosted", lambda: fit_boosted(table, COLUMNS, "y", 2, 12, 4, .3, cuts=cuts)),
                      ("forest", lambda: fit_forest(table, COLUMNS, "y", 2, 5, 9, cuts=cuts))):
        sc.setJobGroup(f"one-part-{name}", name)
        fit()
        used.append(len(sc.statusTracker().getJobIdsForGroup(f"one-part-{name}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert max(used) < 9


def test_both_ways_to_sum_bins_agree():
    from stationcare.plans.forest import _summed

    rng = np.random.default_rng(3)
    bins = np.asfortranarray(rng.integers(0, 200, (400, 6)).astype(np.uint8))
    rows = np.arange(400)
    for classes in (0, 3):
        label = rng.integers(0, 3, 400) if classes else rng.normal(0, 1, 400)
        times = rng.integers(1, 12, 400).astype(float)
        spot = rng.integers(0, 30, 400)
        own = np.sort(np.argsort(rng.random((30, 6)), axis=1)[:, :2], axis=1)
        few = _summed(label, times, spot, bins, rows, own, 6, 200, classes)
        # a numbering of features that is too wide for a table sorts its keys
        many = _summed(label, times, spot, bins, rows, own, 6, 100_000, classes)
        assert (few[0] // 200 == many[0] // 100_000).all() and (few[0] % 200 == many[0] % 100_000).all()
        np.testing.assert_array_equal(few[1], many[1])


def test_deep_trees_are_saved_as_bytes_and_older_texts_are_read():
    import json

    from stationcare.plans.boosting import _ALL, Tree

    rng = np.random.default_rng(5)
    n = 2000
    tree = Tree(*[rng.integers(0, n, n) for _ in range(4)], rng.random((n, 3)), rng.random(n) * 100, rng.random(n))
    digits = json.dumps({name: getattr(tree, name).tolist() for name in _ALL})
    assert len(tree.to_json()) < .75 * len(digits)
    for text in (tree.to_json(), digits):
        back = Tree.from_json(text)
        for name in _ALL:
            np.testing.assert_array_equal(getattr(back, name), getattr(tree, name))


def test_a_tree_does_not_depend_on_how_its_rows_are_cut_into_blocks():
    from stationcare.plans.boosting import _Block
    from stationcare.plans.forest import _grown

    rng = np.random.default_rng(6)
    bins, label, key = rng.integers(0, 40, (3000, 5)).astype(np.uint8), rng.integers(0, 3, 3000).astype(float), rng.integers(0, 2**60, 3000)
    run = _grown(3, 12, 1, 5, 2, 256, 3, True, 42, np.array([1., 10., 35.]), (1, 2))

    def grown(size):
        cut = [slice(i, i + size) for i in range(0, 3000, size)]
        return list(run(((0, 0), _Block(np.asfortranarray(bins[s]), label[s], np.zeros(len(label[s]), bool), key[s], np.zeros((len(label[s]), 1))))
                        for s in cut))

    for (a, one), (b, many) in zip(grown(3000), grown(700), strict=True):
        assert a == b and len(one.feature) > 500 and (one.feature == many.feature).all() and (one.stats == many.stats).all()


def test_sums_read_feature_by_feature_are_those_read_row_by_row():
    from stationcare.plans.forest import _summed

    rng = np.random.default_rng(7)
    bins, rows = rng.integers(0, 30, (500, 4)).astype(np.uint8), np.flatnonzero(rng.random(500) < .6)
    spot, times = rng.integers(0, 6, len(rows)), rng.integers(1, 5, len(rows)).astype(float)
    own = np.tile(np.arange(4), (6, 1))
    for classes in (0, 3):
        label = rng.integers(0, 3, len(rows)) if classes else rng.normal(0, 1, len(rows))
        plain = _summed(label, times, spot, bins, rows, own, 4, 30, classes)
        lined = _summed(label, times, spot, bins, rows, own, 4, 30, classes, np.ascontiguousarray(bins[rows].T))
        for a, b in zip(plain, lined, strict=True):
            np.testing.assert_array_equal(a, b)


def test_rows_walk_down_without_looking_at_every_node_again():
    from stationcare.plans.boosting import Tree

    tree = Tree(np.array([1, -1, 0, -1, -1]), np.array([5, 0, 9, 0, 0]), np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]),
                *[np.zeros(5)] * 3)
    bins = np.array([[0, 5], [0, 6], [9, 6], [10, 255], [255, 0]], np.uint8)
    assert tree._ways[3] == 2
    for lined in (bins, np.asfortranarray(bins)):
        assert tree.leaves(lined).tolist() == [1, 3, 3, 4, 1]
        assert tree.below(lined, np.array([0, 0, 2, 2, 1])).tolist() == [1, 2, 3, 4, 1]
    alone = Tree(np.array([-1]), np.array([0]), np.array([-1]), np.array([-1]), *[np.zeros(1)] * 3)
    assert alone.leaves(bins).tolist() == [0] * 5
