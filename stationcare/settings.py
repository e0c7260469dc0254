"""Names, thresholds, weights and costs the results depend on."""

SEED = 42

# --- fixed values: roles -------------------------------------------------
TIMESTAMP = "timestamp"
MACHINE_ID = "vehiculo_id"
RAW_STATE = "estado_sistema"
GROUPED_STATE = "estado_agrupado"
VEHICLE_TYPE = "tipo_vehiculo"
RUL_TARGETS = {
    "aceite": "rul_dias_aceite",
    "frenos": "rul_dias_frenos",
    "refrigerante": "rul_dias_refrigerante",
}
SENSORS = [
    "sensor_presion_aceite_bar",
    "sensor_presion_frenos_bar",
    "sensor_presion_refrigerante_bar",
]
MACHINE_HOURS = "horas_operacion_acumuladas_maquina"

# --- fixed values: column detection --------------------------------------
TIMESTAMP_NAMES = ["timestamp", "time", "fecha", "date", "datetime", "fecha_hora",
                   "time_stamp", "ts", "created_at"]
TIMESTAMP_PARTS = ["time", "fecha", "date"]
TARGET_NAMES = ["estado_sistema", "estado", "status", "state", "target", "label",
                "class", "classification", "fallo", "failure"]
TARGET_PARTS = ["estado", "status", "target", "label"]
SENSOR_PARTS = ["sensor", "presion", "pressure", "temperatura", "temp"]
QUALITY_SENSOR_PARTS = ["sensor", "presion", "pressure"]

# --- fixed values: state groups -------------------------------------------
NORMAL, WARNING, CRITICAL = "Normal", "Advertencia", "Critico"
NORMAL_PART = "Normal"
CRITICAL_PARTS = ["Inminente", "Critico", "Severa", "Falla", "Error", "Perdida"]
CRITICAL_CLASSES = ["Critico"]
CRITICAL_KEYWORDS = ["Fuga", "Obstruccion", "Sobrepresion", "Degradacion"]

# --- fixed values: leakage -------------------------------------------------
CLASSIFIER_LEAKS = ["id", "vehiculo_id", "timestamp_unix", "bloque_productivo",
                    "semana_del_mes", "ciclo_id", "posicion_en_ciclo",
                    "num_muestras", "duracion_segundos"]
RUL_LEAKS = ["id", "timestamp_unix", "horas_operacion_acumuladas_maquina", "ciclo_id",
             "posicion_en_ciclo", "num_muestras", "duracion_segundos", "vehiculo_id",
             "bloque_productivo", "semana_del_mes"]
RUL_LEAK_PART = "horas_operacion_comp_"
NAME_LEAKS = ["rul", "volumen_real_", "futuro", "siguiente", "proximo", "predicho"]
SUSPICIOUS_NAMES = "(?i)(futuro|siguiente|proximo|predicho|rul)"

# --- fixed values: features ------------------------------------------------
SAMPLING_HZ = 20.0
WINDOW_HOURS = [1, 6]
TREND_HOURS = 24
TREND_MIN_PERIODS = 100
IQR_FACTOR = 1.5
EPSILON = 1e-8

# --- fixed values: selection -----------------------------------------------
VARIANCE_THRESHOLD = 0.0
CORRELATION_THRESHOLD = 1.0
K_BEST = 40
IMPORTANCE_SAMPLE = 200_000
DOMAIN_PARTS = {
    "high": ["_deg_", "degradation", "trend", "failure"],
    "medium": ["operational", "stress", "cycle", "efficiency"],
    "low": ["spectral", "fft", "variability"],
}
DOMAIN_QUOTAS = {"high": 40, "medium": 25, "low": 15, "other": 15}
DOMAIN_LIMIT = 80

# --- fixed values: models ----------------------------------------------------
CLASS_WEIGHTS = {"Normal": 1.0, "Advertencia": 10.0, "Critico": 35.0}
CRITICAL_PROBABILITY = 0.35
UNDERSAMPLE_CAP = 150_000
SMOTE_NEIGHBOURS = 5
FOLDS = 2
TEST_SHARE = 0.3
FOREST_CLASSIFIER = {"numTrees": 200, "maxDepth": 20, "minInstancesPerNode": 8, "minSplit": 15}
BOOSTED_CLASSIFIER = {"maxIter": 50, "maxDepth": 5, "stepSize": 0.1,
                      "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
FOREST_REGRESSOR = {"numTrees": 50, "maxDepth": 10, "minInstancesPerNode": 10, "minSplit": 20,
                    "featureSubsetStrategy": 1.0}
DECISION_TREE = {"numTrees": 1, "maxDepth": 10, "minSplit": 100, "featureSubsetStrategy": 1.0, "bootstrap": False}
LOGISTIC = {"maxIter": 1000}
BOOSTED_REGRESSOR = {"maxIter": 200, "maxDepth": 8, "stepSize": 0.05,
                     "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
                     "minInstancesPerNode": 3, "minInfoGain": 0.1, "patience": 10}
FALLBACK_MODELS = {"classification": "random_forest", "rul": "boosted_trees"}

# --- fixed values: evaluation ------------------------------------------------
RUL_CEILING = 15.0
ACCURACY_BANDS = [1, 3, 7]
HORIZON_DAYS = 10.0
ALPHA, LAMBDA_DAYS = 0.5, 5.0
MAE_BANDS = [(0.0, 2.0, "0-2d"), (2.0, 5.0, "2-5d"), (5.0, 10.0, "5-10d"), (10.0, None, ">10d")]
TOP_K = [5, 10]
FALSE_NEGATIVE_COST, FALSE_POSITIVE_COST, MONITORING_PER_DAY = 1000.0, 50.0, 5.0
MONITORING_DAYS = 30
TARGET_F1 = 0.70

# --- fixed values: business case ---------------------------------------------
ANNUAL_MAINTENANCE, ANNUAL_DOWNTIME, INVENTORY_SHARE = 100_000.0, 50_000.0, 0.2
PLANNED_SAVINGS, INVENTORY_SAVINGS, DOWNTIME_SAVINGS = 0.15, 0.20, 0.25
DEVELOPMENT_COST, INTEGRATION_COST, TRAINING_COST, UPKEEP_COST = 25_000.0, 15_000.0, 5_000.0, 8_000.0

# --- fixed values: maintenance plan ------------------------------------------
URGENT_DAYS, SOON_DAYS = 3.0, 7.0
ACTION_STANDARD = "Seguimiento estándar"
ACTION_GENERIC = "FALLO GENERAL CRÍTICO - INSPECCIONAR"

# --- fixed values: station physics --------------------------------------------
# component: (base life hours, stress sensitivity)
COMPONENT_LIFE = {"bomba_aceite": (1800.0, 1.4), "filtro_frenos": (1200.0, 1.8),
                  "valvula_refrigerante": (2200.0, 1.0)}
SENSOR_BASE = {"aceite": 2.75, "frenos": 2.5, "refrigerante": 2.0}
VOLUME_TARGETS = {"aceite": 4500, "frenos": 800, "refrigerante": 10000}
