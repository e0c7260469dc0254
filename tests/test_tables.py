import numpy as np
import pytest
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.operators import clean, profile, select
from stationcare.operators.quantiles import quantile_values, quantiles
from stationcare.roles import detect_roles, detect_sensors, detect_target, detect_timestamp
from stationcare.sources import sinks, tables


def test_quantile_fixture(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    assert quantile_values(df, ["x"], [.25, .1, .5])["x"] == pytest.approx([1.75, 1.3, 3])


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_bracketed_quantiles_are_exact(spark, hot):
    rng = np.random.default_rng(5)
    x = rng.normal(size=20_000)
    x[: int(hot * len(x))] = 0.25  # hot value
    g = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double")
    probs = [0.0, .1, .25, .5, .777, 1.0]
    got = quantiles(df, ["x"], probs, by=["g"], exact_limit=10, bracket_limit=50).collect()
    assert len(got) == 2
    for r in got:
        assert list(r["q"]) == pytest.approx(list(np.quantile(x[g == r["g"]], probs)), abs=1e-12)


def test_timestamps(spark):
    rows = [("2024-05-27T06:00:00",), ("2024-05-27T06:00:00.050000",), ("junk",), (None,)]
    df = spark.createDataFrame(rows, "timestamp string")
    assert clean.parse_timestamps(df).count() == 2
    bad = spark.createDataFrame([("2024-05-27T06:00:00",)] + [("junk",)] * 19, "timestamp string")
    with pytest.raises(clean.BadTimestamps):
        clean.parse_timestamps(bad)


def test_ceiling(spark):
    df = spark.createDataFrame([(20.0,), (15.0,), (None,)], "r double")
    assert [r[0] for r in df.select(clean.rul_ceiling(F.col("r"))).collect()] == [15, 15, None]
    assert [r[0] for r in clean.valid_rul(df, "r").collect()] == [15, 15]


def test_constant_column(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert profile.correlations(df, ["x", "y"]).first()["r"] is None
    assert not select.keep_varying(df, ["x"]).first()["kept"]
    wide = df.select("y", *[F.lit(float(i)).alias(f"c{i}") for i in range(13)])
    assert profile.correlations(wide, wide.columns).where("r is not null").count() == 0


def test_matrix_and_direct_correlation_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 14)) + 1000
    x[rng.random(x.shape) < .1] = np.nan
    df = clean.nan_to_null(spark.createDataFrame([tuple(map(float, r)) for r in x], [f"c{i:02d}" for i in range(14)]))
    both = profile.correlations(df, df.columns).join(
        profile.correlations(df, df.columns[:5]).select("a", "b", F.col("r").alias("q")), ["a", "b"])
    assert both.count() == 10
    assert both.agg(F.max(F.abs(F.col("r") - F.col("q")))).first()[0] < 1e-9


def test_roles(fleet, spark):
    roles = detect_roles(fleet)
    assert roles.timestamp == "timestamp" and roles.target == "estado_sistema"
    assert list(roles.sensors) == S.SENSORS and set(roles.rul_targets) == {"aceite", "frenos", "refrigerante"}
    odd = spark.createDataFrame([("2024-01-01T00:00:00", "x", 1.0), ("2024-01-02T00:00:00", "y", 2.0)],
                                "when_ string, kind string, pressure_1 double")
    assert detect_timestamp(odd) == "when_" and detect_target(odd, "when_") == "kind"
    assert detect_sensors(odd) == ["pressure_1"]


def test_leaky_names(fleet):
    kept, dropped, suspicious = clean.drop_leaky_names(fleet)
    assert "rul_dias_aceite" in dropped and "volumen_real_frenos_ml" in dropped and not suspicious
    assert clean.rul_inputs(["a", "ciclo_id", "horas_operacion_comp_aceite"]) == ["a"]
    with pytest.raises(ValueError):
        clean.split_inputs(fleet, "no_such")
    x, y, t = clean.split_inputs(fleet, "rul_dias_aceite")
    assert "rul_dias_frenos" not in x.columns and y.columns == ["rul_dias_aceite"] and t.columns == ["timestamp"]


def test_domain_quotas():
    names = [f"s{i}_deg_x" for i in range(60)] + [f"q{i}" for i in range(40)]
    assert len(clean.prioritise_by_domain(names, S.DOMAIN_LIMIT)) == 55
    assert clean.prioritise_by_domain(names[:80], S.DOMAIN_LIMIT) == names[:80]
    assert clean.prioritise_by_domain(names) == names


def test_profile_of_the_fleet(fleet):
    from stationcare.plans.preprocess import clean_readings

    df, roles = clean_readings(fleet)
    got = profile.time_profile(df, "timestamp", ["timestamp", "id"]).first()
    assert got["median_seconds"] == pytest.approx(.05) and got["frequency_hz"] == pytest.approx(20)
    assert got["large_gaps"] == 0 and got["max_gap_seconds"] is None
    assert profile.duplicate_rows(df.union(df.limit(5))).first()[0] == 5
    assert profile.class_share(df, roles.target, top=1).count() == 2
    assert profile.schema_report(df).count() == len(df.columns)


def test_selection_keeps_order_and_reports(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 600)
    data = [(int(c), float(c + rng.normal()), float(rng.normal()), 1.0, float(c * 5 + rng.normal()), None)
            for c in y]
    df = spark.createDataFrame(data, "y int, a double, b double, flat double, d double, none double")
    got = select.fit_selection(df, ["a", "b", "flat", "d", "none"], "y", k=2)
    assert got.columns == ["a", "d"]
    assert got.removed["variance"] == ["flat"] and got.removed["all_missing"] == ["none"]
    assert got.report(df).where("kind = 'score'").first()["name"] == "d"
    scores = {"a": 1.0, "b": 5.0, "d": 3.0}
    ranked = spark.createDataFrame(list(scores.items()), "feature string, f_score double")
    assert select.k_best(ranked, ["a", "b", "d"], 2) == ["b", "d"]


def test_sources(spark, fleet, tmp_path):
    pq, csv = str(tmp_path / "r.parquet"), str(tmp_path / "r.csv")
    sinks.export_parquet(fleet, pq)
    fleet.write.option("header", True).csv(csv)
    for path in (pq, csv):
        df = tables.read_table(spark, path, schema=tables.READINGS)
        assert df.count() == 3000 and df.schema["rul_dias_aceite"].dataType.simpleString() == "double"
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xyz")
    assert tables.source_format("a/b.db") == "jdbc"
    assert tables.numeric_text(fleet, "rul_dias_aceite") and not tables.numeric_text(fleet, "estado_sistema")
    got = tables.run_query(fleet, "SELECT count(*) AS n FROM datos_estacion WHERE id <= ?", [10])
    assert got.first()["n"] == 10
    assert tables.sensor_data(fleet, limit=7).count() == 7
    assert clean.sample_rows(fleet, "id", 50).count() == 50 and clean.sample_rows(fleet, "id", 9999).count() == 3000
    with pytest.raises(ValueError):
        tables.require_columns(fleet, ["zzz"])


def test_filters_reach_the_scan(spark, fleet, tmp_path):
    path = str(tmp_path / "r.parquet")
    sinks.export_parquet(fleet, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    df = tables.read_table(spark, path, schema=tables.READINGS,
                           where=tables.in_state("RUL_Critico", (1.0, 2.0))).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(estado_sistema,RUL_Critico)" in plan and "GreaterThanOrEqual(rul_dias_aceite,1.0)" in plan
    assert "sensor_presion" not in plan.split("ReadSchema")[1]


def test_checkpoints_and_manifest(spark, tmp_path):
    root = str(tmp_path)
    points, calls = sinks.Checkpoints(spark, root, "s1"), []

    def build():
        calls.append(1)
        return spark.range(5)

    assert not points.has("features")
    assert points.stage("features", build).count() == 5
    points.stage("features", build)
    assert len(calls) == 1
    points.stage("features", build, force="rul")
    assert len(calls) == 1
    points.stage("features", build, force="all")
    assert len(calls) == 2
    points.clear("features")
    assert not points.has("features")
    first = sinks.manifest_row(spark, 1, "2024-01-01", "v1", 10, {"hours": 10}, {"a": 1.5})
    second = sinks.manifest_row(spark, 2, "2024-01-02", "v2", 10, {}, {}, True, {"x": 1})
    got = sinks.latest_run(first.unionByName(second)).first()
    assert got["version"] == "v2" and got["es_enriquecido"]
    assert first.first()["configuracion_json"] == '{"hours":10}'


def test_prediction_and_metric_sinks(spark, tmp_path):
    preds = spark.createDataFrame([(1, 2.0, 2.5)], "id long, y_true double, y_pred double")
    sinks.save_predictions(preds, str(tmp_path), "rul", "m", "s")
    assert sinks.load_predictions(spark, str(tmp_path), "rul", "m", "s").count() == 1
    m = sinks.metrics_table(spark.createDataFrame([("MAE", 1.0), ("R2", .5)], "metric string, value double"),
                            "s", "rul", "aceite", "m")
    got = sinks.metrics_view(m, ["MAE", "R2"]).first()
    assert got["MAE"] == 1.0 and got["R2"] == .5
    listed = sinks.sessions(m.union(m.withColumn("session", F.lit("t")))).first()
    assert listed["sessions"] == ["t", "s"] and listed["latest"] == "t"


def test_quantiles_of_whole_columns_list_only_values_in_brackets(spark):
    rng = np.random.default_rng(8)
    n = 5000
    rows = [(float(v), float(i % 3), None if i % 2 else float("nan") if i % 10 == 0 else float(i), None)
            for i, v in enumerate(np.sort(rng.normal(size=n)) * 1e6)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").coalesce(3)
    probs = [0.0, .05, .5, .75, 1.0]
    got = {r["column"]: r for r in quantiles(df, ["a", "b", "c", "d"], probs, exact_limit=10, bracket_limit=50).collect()}
    want = {r["column"]: r for r in quantiles(df, ["a", "b", "c", "d"], probs).collect()}
    assert sorted(got) == sorted(want) == ["a", "b", "c"]
    for c in want:
        assert got[c]["n"] == want[c]["n"]
        assert np.allclose(got[c]["q"], want[c]["q"], rtol=1e-12, equal_nan=True)
    plan = quantiles(df, ["a"], [.5], exact_limit=10)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
