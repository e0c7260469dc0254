import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[4]").appName("stationcare-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="stationcare-shared-"))
               .config("spark.sql.warehouse.dir", "/tmp/stationcare-warehouse").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fleet(spark):
    """Readings in the station's own schema: 3,000 rows at 20 Hz, five machines, wear and faults."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 3000
    t = pd.Timestamp("2024-05-27T21:58:00") + pd.to_timedelta(np.arange(n) * 50, unit="ms")
    wear = np.linspace(0, 1, n)
    machine = rng.integers(1, 41, n // 20).repeat(20)
    rul = {c: np.clip(25 * (1 - wear) + rng.normal(0, 1, n), 0.5, 25) for c in ("aceite", "frenos", "refrigerante")}
    low = np.minimum.reduce(list(rul.values()))
    state = np.where(low <= 3, "RUL_Critico", np.where(low <= 12, "Degradacion_Moderada", "Normal_Operacion"))
    data = {
        "id": np.arange(1, n + 1), "timestamp": [x.isoformat() for x in t], "bloque_productivo": 1,
        "vehiculo_id": machine, "tipo_vehiculo": np.where(machine % 3 == 0, "SUV", "Sedan"),
        "estado_sistema": state,
        "sensor_presion_aceite_bar": 2.75 + wear + rng.normal(0, .05, n),
        "sensor_presion_frenos_bar": 2.5 + wear + rng.normal(0, .05, n),
        "sensor_presion_refrigerante_bar": 2.0 + wear + rng.normal(0, .05, n),
        "temperatura_ambiente_celsius": 22 + rng.normal(0, 1.5, n)}
    for c, target in (("aceite", 4500), ("frenos", 800), ("refrigerante", 10000)):
        data[f"volumen_real_{c}_ml"] = (target * rng.normal(1, .05, n)).astype(int)
        data[f"volumen_objetivo_{c}_ml"] = target
    data["horas_operacion_acumuladas_maquina"] = np.arange(n) * .05 / 3600
    for c in rul:
        data[f"horas_operacion_comp_{c}"] = wear * 1000
    for c, v in rul.items():
        data[f"rul_dias_{c}"] = v
    data["timestamp_unix"] = (t.astype("int64") // 10**9)
    data["semana_del_mes"] = 4
    from stationcare.sources.tables import READINGS

    frame = pd.DataFrame(data)[READINGS.names]
    return spark.createDataFrame(frame, READINGS).sample(1.0, seed=1).repartition(3).persist()
