import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationcare import settings as S
from stationcare.operators.ordered import INDEX
from stationcare.plans import features, maintenance, preprocess, report, scoring, session_run, split_job, train
from stationcare.roles import detect_roles
from stationcare.session import shared_dir
from stationcare.streaming import plan as streaming

HZ = 0.02  # windows of 72 / 432 / 1,728 rows on 3,000 rows


@pytest.fixture(scope="module")
def prepared(fleet):
    return preprocess.preprocess(fleet, sampling_hz=HZ)


def test_full_feature_set(fleet, prepared):
    new = features.new_columns(fleet, prepared.df)
    # 53 engineered columns and the grouped state
    assert len(new) == 54 and S.GROUPED_STATE in new and "eficiencia_relativa" in new
    assert features.preview(preprocess.clean_readings(fleet)[0], prepared.roles, sampling_hz=HZ, rows=3000) == [
        c for c in new if c != S.GROUPED_STATE]
    assert prepared.df.count() == 3000 and INDEX not in prepared.df.columns


def test_features_equal_pandas(fleet, prepared):
    got = prepared.df.orderBy("id").toPandas()
    s = got["sensor_presion_aceite_bar"]
    n = len(got)
    pairs = {
        "sensor_presion_aceite_bar_ma_1h": s.rolling(72, min_periods=18).mean(),
        "sensor_presion_aceite_bar_ma_6h": s.rolling(432, min_periods=108).mean(),
        "sensor_presion_aceite_bar_ma_24h": s.rolling(1728, min_periods=100).mean(),
        "sensor_presion_aceite_bar_deg_ratio_1h": s / s.iloc[:min(1728, n // 4)].mean(),
        "sensor_presion_aceite_bar_spectral_energy": s.rolling(150, min_periods=75).var().fillna(0)}
    trend = pairs["sensor_presion_aceite_bar_ma_24h"].diff().fillna(0)
    pairs["sensor_presion_aceite_bar_trend_velocity"] = trend
    pairs["sensor_presion_aceite_bar_trend_acceleration"] = trend.diff().fillna(0)
    kind = got["tipo_vehiculo"]
    cycle = (kind != kind.shift()).cumsum()
    size = cycle.map(cycle.value_counts())
    pairs["ciclo_id"], pairs["num_muestras"] = cycle, size
    pairs["posicion_en_ciclo"] = got.groupby(cycle).cumcount() / size
    span = got.groupby(cycle)["timestamp"].agg(lambda t: (t.max() - t.min()).total_seconds())
    pairs["eficiencia_relativa"] = span.quantile(.1) / cycle.map(span).replace(0, 1)
    pairs["tiempo_operacion_horas"] = (got["timestamp"] - got["timestamp"].iloc[0]).dt.total_seconds() / 3600
    for name, want in pairs.items():
        np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(float), atol=1e-9, err_msg=name)


def test_frozen_state_is_used_on_new_rows(fleet, prepared):
    cleaned, roles = preprocess.clean_readings(fleet.where("id > 1500"))
    again = features.FeatureState.from_json(prepared.state.to_json())
    assert again == prepared.state
    out, _ = features.engineer(cleaned, roles, "full", again)
    got = out.where("id = 2000").first()
    s = "sensor_presion_aceite_bar"
    assert got[f"{s}_deg_ratio_1h"] == pytest.approx(got[s] / prepared.state.baselines[s])


def test_long_sampling_windows_and_short_tables(fleet):
    cleaned, roles = preprocess.clean_readings(fleet)
    out, state = features.engineer(cleaned, roles)  # 20 Hz: the day window is longer than the table
    got = out.orderBy("id").select("sensor_presion_aceite_bar", "sensor_presion_aceite_bar_ma_24h").toPandas()
    want = got.iloc[:, 0].rolling(1_728_000, min_periods=100).mean()
    np.testing.assert_allclose(got.iloc[:, 1].to_numpy(float), want.to_numpy(), atol=1e-9)
    few, _ = features.engineer(cleaned.where("id <= 5"), roles)
    assert few.count() == 5 and "sensor_presion_aceite_bar_ma_1h" not in few.columns


def test_clean_sensors_option(fleet):
    cleaned, roles = preprocess.clean_readings(fleet)
    spoilt = cleaned.withColumn("sensor_presion_aceite_bar", F.when(F.col("id") == 700, 99.0).otherwise(
        F.col("sensor_presion_aceite_bar")))
    out, _ = features.engineer(spoilt, roles, "optimized", clean_sensors=True, sampling_hz=HZ)
    rows = {r["id"]: r for r in out.where("id between 699 and 701").collect()}
    name = "sensor_presion_aceite_bar_limpio"
    assert rows[700][name] == pytest.approx((rows[699][name] + rows[701][name]) / 2)


def test_no_full_table_in_one_partition(prepared):
    plan = prepared.df._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("SinglePartition")[1:]:
        assert part.split("\n")[1].strip().lstrip(":+- ").startswith("HashAggregate")


def test_basic_preparation(fleet):
    got = preprocess.prepare_basic(fleet, share=.25)
    assert {"es_horario_laboral", "minuto_hora", "segundo_minuto"} <= set(got.df.columns)
    assert got.df.select("vehiculo_id").distinct().count() == fleet.select("vehiculo_id").distinct().count() // 4
    assert "temperatura_ambiente_celsius" in got.sensors


def test_split_job(spark, fleet, tmp_path):
    rows, shares = split_job.split_readings(fleet, path=str(tmp_path / "split"))
    assert sorted(os.listdir(tmp_path / "split"))[-2:] == ["split=test", "split=train"]
    assert rows.count() == 3000 and shares.groupBy("split").agg(F.sum("n")).count() == 2


SMALL = {"classification": {"random_forest": {"numTrees": 5, "maxDepth": 4}},
         "rul": {"boosted_trees": {"maxIter": 3, "maxDepth": 3}}}


@pytest.fixture(scope="module")
def session(fleet, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("runs"))
    best = session_run.train_session(
        fleet, root, "s1", HZ, test=fleet.where("id > 1000"), classifiers=["random_forest"],
        regressors=["linear_regression", "boosted_trees"], options=SMALL, k_best=8)
    return root, {r["task"]: r["model"] for r in best.collect()}


def test_training_session(spark, session):
    root, best = session
    assert best["classification"] == "random_forest" and best["rul"] in ("linear_regression", "boosted_trees")
    metrics = spark.read.parquet(f"{root}/metrics")
    f1 = metrics.where("metric = 'f1_macro'").agg(F.avg("value")).first()[0]
    assert f1 > .5
    assert metrics.where("task = 'rul'").select("component").distinct().count() == 3
    held = spark.read.parquet(f"{root}/holdout")
    assert held.where("metric in ('MAE', 'accuracy')").count() == 4


def test_session_reuse_and_force(spark, fleet, session):
    root, best = session
    args = dict(classifiers=["random_forest"], regressors=["linear_regression", "boosted_trees"], options=SMALL, k_best=8)

    def written(what):
        return {r["f"] for r in spark.read.parquet(f"{root}/{what}").selectExpr("_metadata.file_path AS f").distinct().collect()}

    before = {w: written(f"metrics/session=s1/task={w}") for w in ("classification", "rul")}
    rows = spark.read.parquet(f"{root}/metrics").count()
    again = session_run.train_session(fleet, root, "s1", HZ, force="classification", **args)
    assert {r["task"]: r["model"] for r in again.collect()}["rul"] == best["rul"]
    assert written("metrics/session=s1/task=classification") != before["classification"]
    assert written("metrics/session=s1/task=rul") == before["rul"]
    assert spark.read.parquet(f"{root}/metrics").count() == rows, "metrics of one training only"
    with pytest.raises(ValueError):
        session_run.train_session(fleet, root, "s1", HZ / 2, **args)
    with pytest.raises(ValueError):
        session_run.train_session(fleet, root, "s1", HZ, force="nothing", **args)


@pytest.mark.parametrize("slice_", ["id = 3000", "id > 2700", "id > 1500"])
def test_frozen_features_do_not_follow_the_table(fleet, slice_):
    cleaned, roles = session_run.clean_readings(fleet, None)
    whole, state = features.engineer(cleaned, roles, "full", None, HZ)
    part, _ = features.engineer(cleaned.where(slice_), roles, "full", state)
    assert part.columns == whole.columns and part.dtypes == whole.dtypes
    if slice_ == "id > 1500":
        names = [c for c in whole.columns if "_ma_" in c or "spectral" in c]
        names = [c for c in names if "24h" not in c]  # looks back over the whole slice
        late = "id > 2400"
        a = whole.where(late).select("id", *[F.round(c, 9).alias(c) for c in names])
        b = part.where(late).select("id", *[F.round(c, 9).alias(c) for c in names])
        assert a.exceptAll(b).count() == 0


def test_scoring_session(spark, fleet, session):
    root, _ = session
    plan = session_run.score_session(fleet.where("id <= 800"), root, "s1")
    assert plan.count() == 800
    assert {"predicted_estado", "predicted_rul_aceite", "prioridad", "accion_recomendada"} <= set(plan.columns)
    assert plan.where("predicted_rul_aceite < 0 or predicted_estado is null").count() == 0
    # original inputs come through untouched
    assert plan.select("id", "sensor_presion_aceite_bar").exceptAll(
        fleet.select("id", "sensor_presion_aceite_bar")).count() == 0
    kpis = maintenance.fleet_kpis(plan, "vehiculo_id").first()
    assert kpis["alta_rows"] + kpis["media_rows"] <= 800
    with pytest.raises(FileNotFoundError):
        session_run.score_session(fleet, root, "no-such-session")


def test_missing_models_keep_the_schema(fleet):
    got = scoring.score_fleet(fleet, None, {c: None for c in S.RUL_TARGETS})
    assert got.where("predicted_estado = 'N/A' and predicted_rul_aceite is null and prioridad = 'BAJA'").count() == 3000
    assert scoring.model_choice(None, {"rul": ["boosted_trees"]}) == {"classification": None, "rul": "boosted_trees"}


def test_explanations(spark, fleet, session):
    root, _ = session
    df = spark.read.parquet(f"{root}/checkpoints/session=s1/phase=features")
    linear = scoring.load_model(spark, f"{root}/models", "s1", "rul", "aceite", "linear_regression")
    phi = train.linear_attribution(linear, df)
    names = [c for c in phi.columns if c.startswith("phi_")]
    total = phi.select("id", sum([F.col(c) for c in names[1:]], F.col(names[0])).alias("t"))
    scored = linear.model.transform(linear.selection.transform(df)).select("id", "prediction")
    gap = total.join(scored, "id").select((F.col("prediction") - F.col("t")).alias("d"))
    lo, hi = gap.agg(F.min("d"), F.max("d")).first()
    assert hi - lo < 1e-6  # contributions plus one constant give the prediction
    forest = scoring.load_model(spark, f"{root}/models", "s1", "classification", "-", "random_forest")
    assert train.importances(forest).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    shuffled = train.permutation_importance(linear, df, "rul_dias_aceite")
    assert shuffled.count() == len(linear.selection.columns)
    assert shuffled.agg(F.max("importance")).first()[0] > 0


def test_stream_equals_batch(spark, fleet, prepared, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    cleaned, roles = preprocess.clean_readings(fleet)
    cleaned = cleaned.drop(S.GROUPED_STATE)
    cleaned.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(cleaned.schema).parquet(src)

    def rich(df):
        return streaming.planned(streaming.enriched(df, list(roles.sensors), prepared.state).withColumns(
            {"predicted_estado": F.col(S.GROUPED_STATE), "predicted_rul_aceite": F.col("rul_dias_aceite")}))

    query = streaming.write_available(rich(stream), out, str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    got, want = spark.read.parquet(out), rich(cleaned)
    cols = ["id", "prioridad", "accion_recomendada", "sensor_skew", "semana_operacion"]
    assert got.count() == 3000 and got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_shared_dir_prefers_the_session_setting():
    class Conf:
        def get(self, name, default=None):
            return "/shared/folder/" if name == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert shared_dir(Session()) == "/shared/folder"


def test_last_rows_are_looked_up_late(spark, fleet):
    import re

    wide = fleet.select("vehiculo_id", "timestamp", "id", "estado_sistema", "sensor_presion_aceite_bar")
    none = spark.createDataFrame([(None, None, 1, "a", 1.0), (None, "t", 2, "b", 2.0), (None, "t", 2, "b", 2.0)], wide.schema)
    both = wide.unionByName(none)
    got = maintenance.latest_per_machine(both, "vehiculo_id", ["timestamp", "id"])
    want = both.toPandas().sort_values(["timestamp", "id"], na_position="first").groupby("vehiculo_id", dropna=False).tail(1)
    assert sorted(r["id"] for r in got.collect()) == sorted(want["id"])
    assert got.where("vehiculo_id is null").first()["estado_sistema"] == "b"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("estado_sistema" in line for line in plan.split("\n") if re.search("SortAggregate|ObjectHashAggregate", line))


def test_a_write_reports_on_itself(spark, fleet, tmp_path):
    after = fleet.withColumns({"a": F.when(F.col("id") % 3 == 0, 1), "b": F.lit("x")})
    got = {(r["kind"], r["name"]): r["value"] for r in report.write_reported(
        fleet, after, str(tmp_path / "t"), str(tmp_path / "m")).collect()}
    assert got["rows", ""] == 3000 and got["nulls", "a"] == 2000 and got["nulls", "b"] == 0
    assert got["columns_added", ""] == 2 and got["columns", ""] == len(fleet.columns) + 2 and got["bytes", ""] > 1000
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3000
    assert spark.read.parquet(str(tmp_path / "m")).where("kind = 'rows'").first()["path"] == str(tmp_path / "t")
