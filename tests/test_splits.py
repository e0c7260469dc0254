import numpy as np
import pytest
from pyspark.sql import functions as F

from stationcare.operators import balance, split


@pytest.fixture(scope="module")
def rows(spark):
    """One group and one class hold more than a third of the rows."""
    rng = np.random.default_rng(4)
    n = 3000
    group = np.where(rng.random(n) < .35, 0, rng.integers(1, 200, n))
    label = np.where(rng.random(n) < .8, "N", np.where(rng.random(n) < .7, "A", "C"))
    return spark.createDataFrame([(i, int(g), str(c), float(rng.normal()), float(rng.normal()))
                                  for i, (g, c) in enumerate(zip(group, label))],
                                 "id long, g long, c string, x double, y double").persist()


def test_stratified_split_is_exact(rows):
    got = split.stratified_split(rows, "c", "id")
    for r in got.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert abs(r["t"] - .3 * r["n"]) <= 1
    again = split.stratified_split(rows.repartition(7), "c", "id")
    assert got.select("id", "split").exceptAll(again.select("id", "split")).count() == 0


def test_cap_keeps_small_classes_whole(rows):
    sizes = {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()}
    got = {r["c"]: r["count"] for r in split.cap_per_class(rows, "c", "id", 500).groupBy("c").count().collect()}
    assert got == {c: min(n, 500) for c, n in sizes.items()}


def _one_by_one(sizes, k):
    loads, out = [0] * k, []
    for n in sizes:
        f = loads.index(min(loads))
        loads[f] += n
        out.append(f)
    return out


def test_fold_runs_equal_one_by_one():
    rng = np.random.default_rng(8)
    for k in (1, 2, 3, 7):
        for _ in range(40):
            sizes = sorted(((int(n), int(rng.integers(1, 30))) for n in set(rng.integers(1, 300, 12).tolist())),
                           reverse=True)
            want = _one_by_one([n for n, c in sizes for _ in range(c)], k)
            got = [folds[i % len(folds)] for _, _, n, folds in split.fold_runs(sizes, k) for i in range(n)]
            assert got == want


def test_group_folds_of_many_groups(spark):
    """One rule for any number of groups, a null group and a group with half of the rows included."""
    rng = np.random.default_rng(9)
    groups = [None] * 7 + [0] * 6000 + [int(g) for g in rng.integers(1, 2500, 6000)]
    df = spark.createDataFrame([(g,) for g in groups], "g long")
    got = split.group_folds(df, "g", 3)
    sizes = {}
    for g in groups:
        sizes[g] = sizes.get(g, 0) + 1
    order = sorted(sizes, key=lambda g: (-sizes[g], g is not None, g or 0))
    want = dict(zip(order, _one_by_one([sizes[g] for g in order], 3), strict=True))
    assert {r["g"]: r["fold"] for r in got.distinct().collect()} == want and got.count() == len(groups)


def test_folds_of_an_empty_table(rows):
    assert split.group_folds(rows.limit(0), "g", 3).count() == 0
    assert split.stratified_group_folds(rows.limit(0), "g", "c", 3).count() == 0


def test_cap_needs_a_size(rows):
    with pytest.raises(ValueError):
        split.cap_per_class(rows, "c", "id")


def test_group_folds(rows):
    got = split.group_folds(rows, "g", 3)
    assert split.leaking_groups(got, "g").count() == 0
    sizes = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert len(sizes) == 3 and max(sizes) <= 1.15 * rows.where("g = 0").count()


def test_stratified_group_folds(rows):
    got = split.stratified_group_folds(rows, "g", "c", 2)
    assert split.leaking_groups(got, "g").count() == 0
    shares = got.groupBy("fold").agg(F.avg((F.col("c") == "N").cast("double")).alias("p")).collect()
    assert len(shares) == 2 and abs(shares[0]["p"] - shares[1]["p"]) < .06


def test_fold_attachment_does_not_shuffle_rows(rows):
    plan = split.group_folds(rows, "g", 2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(g" not in plan


def test_shared_groups(rows):
    assert split.shared_groups(rows.where("g < 5"), rows.where("g >= 5"), "g").count() == 0


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    p = rng.normal(size=(60, 3))
    p[40:] = p[0]  # a third of the points coincide
    df = spark.createDataFrame([("k", i + 1, 60, [float(v) for v in r]) for i, r in enumerate(p)],
                               "c string, position long, size long, x array<double>").withColumn("id", F.col("position"))
    got = {}
    for r in balance.neighbours(df, "c", "id", 5, tile=16).orderBy("position", "rank").collect():
        got.setdefault(r["position"], []).append(r["neighbour"])
    for i in range(60):
        gap = sorted((float(sum((p[i, d] - p[j, d]) ** 2 for d in range(3))), j + 1) for j in range(60) if j != i)
        assert got[i + 1] == [j for _, j in gap[:5]]


def test_neighbours_over_many_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    p = np.round(rng.normal(size=(500, 2)), 1)
    p[300:] = p[7]  # equal points fill several blocks
    df = spark.createDataFrame([("k", i + 1, 500, [float(v) for v in r]) for i, r in enumerate(p)],
                               "c string, position long, size long, x array<double>").repartition(3)
    got = {}
    for r in balance.neighbours(df, "c", "id", 5, tile=20).orderBy("position", "rank").collect():
        got.setdefault(r["position"], []).append((r["squared_distance"], r["neighbour"]))
    for i in range(500):
        gap = sorted((float((p[i, 0] - p[j, 0]) ** 2 + (p[i, 1] - p[j, 1]) ** 2), j + 1) for j in range(500) if j != i)
        assert got[i + 1] == gap[:5]


def test_blocks_asked_grow_with_the_rows(spark):
    def asked(n, equal=0):
        p = np.random.default_rng(n).random((n, 2))
        p[:equal] = .5
        df = spark.createDataFrame([("k", i + 1, [float(v) for v in r]) for i, r in enumerate(p)],
                                   "c string, position long, x array<double>")
        _, found = balance._first_look(df, "c", 5, 64)
        return found.select("block", F.explode("asked").alias("b")).distinct().count()

    small, large = asked(1500), asked(6000)
    assert large < 6 * small  # all pairs of blocks would be 16 times as many
    assert asked(6000, 2000) < 1.5 * large  # equal points need not meet


def test_far_points_do_not_make_blocks_near_to_all(spark):
    rng = np.random.default_rng(2)
    p = rng.random((4000, 4))
    far = rng.random((4000, 4)) < .02
    p[far] *= 1e9  # a ratio to nothing
    df = spark.createDataFrame([("k", i + 1, [float(v) for v in r]) for i, r in enumerate(p)],
                               "c string, position long, x array<double>")
    _, found = balance._first_look(df, "c", 5, 64)
    assert found.agg(F.avg(F.size("asked"))).first()[0] < 5.5  # of at least 62 blocks


def test_neighbours_only_of_rows_that_ask(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.normal(size=(400, 3)), 1)
    p[200:260] *= 1e8
    df = spark.createDataFrame([("k", i + 1, [float(v) for v in r]) for i, r in enumerate(p)],
                               "c string, position long, x array<double>")
    every = balance.neighbours(df, "c", "id", 5, tile=20)
    some = balance.neighbours(df, "c", "id", 5, tile=20, asks=F.col("position") % 7 == 0)
    want = [tuple(r) for r in every.where("position % 7 = 0").orderBy("position", "rank").collect()]
    assert len(want) == 57 * 5 and [tuple(r) for r in some.orderBy("position", "rank").collect()] == want
    _, found = balance._first_look(df, "c", 5, 20, F.col("position") % 7 == 0)
    assert found.count() == 57


def test_smote_levels_classes_between_neighbours(rows):
    got = balance.smote(rows, "c", "id", ["x", "y"], tile=128)
    sizes = {r["count"] for r in got.groupBy("c").count().collect()}
    assert len(sizes) == 1
    real = rows.where("c = 'C'").agg(F.min("x"), F.max("x")).first()
    made = got.where("c = 'C' and synthetic").agg(F.min("x"), F.max("x")).first()
    assert real[0] <= made[0] and made[1] <= real[1]


def test_smote_leaves_hopeless_input_alone(rows):
    one = rows.where("c = 'N'")
    assert balance.smote(one, "c", "id", ["x"]).count() == one.count()
    tiny = rows.where("c = 'N'").limit(50).union(rows.where("c = 'C'").limit(3))
    assert balance.smote(tiny, "c", "id", ["x"]).where("synthetic").count() == 0
