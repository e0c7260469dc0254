import math

import pytest
from pyspark.sql import functions as F

from stationcare.functions import clock, hashing, physics, rows, states


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_states(spark):
    raw = ["Normal_Operacion", "Fallo_Inminente_Bomba_Aceite", "RUL_Critico", "Degradacion_Severa",
           "Fuga_Menor", "INACTIVO", None]
    df = spark.createDataFrame([(s,) for s in raw], "s string")
    got = [r[0] for r in df.select(states.grouped_state(F.col("s"))).collect()]
    assert got == ["Normal", "Critico", "Critico", "Critico", "Advertencia", "Advertencia", None]
    idle = [r[0] for r in df.select(states.grouped_state(F.col("s"), idle_as="Normal")).collect()]
    assert idle[5] == "Normal"


def test_row_stats(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (2.0, 2.0, 2.0), (1.0, 1.0, 5.0), (1.0, None, 4.0)],
                               "a double, b double, c double")
    stats = rows.sensor_features([F.col(c) for c in "abc"])
    got = df.select(*[c.alias(n) for n, c in stats.items()]).collect()
    assert [r["sensor_skew"] for r in got[:3]] == pytest.approx([0.935219529582825, 0, 1.7320508075688772])
    assert [r["sensor_median"] for r in got[:3]] == [2, 2, 1]
    for name in ("sensor_mean", "sensor_std", "sensor_max", "sensor_min", "sensor_median"):
        assert got[3][name] is None
    assert got[0]["sensor_ratio_02"] == pytest.approx(0.25)


def test_calendar(spark):
    df = spark.createDataFrame([("2024-06-01 23:10:05",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    got = df.select(*[c.alias(n) for n, c in clock.calendar_features(F.col("t"), F.lit(20)).items()]).first()
    assert (got["hora_dia"], got["dia_semana"], got["es_fin_semana"], got["es_horario_nocturno"]) == (23, 5, 1, 1)
    assert got["semana_operacion"] == 3
    assert got["hora_sin"] == pytest.approx(math.sin(2 * math.pi * 23 / 24))
    assert df.select(clock.productive_shift(F.col("t"))).first()[0] is False


def test_priority_and_action(spark):
    data = [("Critico", 20.0, 20.0, 20.0), ("Normal", 2.0, 9.0, 9.0), ("Normal", 6.0, 9.0, 9.0),
            ("Normal", 9.0, 9.0, 9.0), ("Normal", None, 9.0, 9.0)]
    df = spark.createDataFrame(data, "s string, a double, b double, c double")
    ruls = [F.col(c) for c in "abc"]
    got = [r[0] for r in df.select(states.priority(F.col("s"), ruls)).collect()]
    assert got == ["ALTA", "ALTA", "MEDIA", "BAJA", "BAJA"]
    named = {"aceite": F.lit(2.0), "frenos": F.lit(2.0), "refrigerante": F.lit(9.0)}
    assert one(spark, states.action(F.lit("ALTA"), named)) == ["INSPECCIONAR ACEITE URGENTE"]
    assert one(spark, states.action(F.lit("ALTA"), {})) == ["FALLO GENERAL CRÍTICO - INSPECCIONAR"]
    assert one(spark, states.action(F.lit("BAJA"), named)) == ["Seguimiento estándar"]


def test_lowest_skips_nulls(spark):
    none = F.lit(None).cast("double")
    assert one(spark, states.lowest({"a": none, "b": F.lit(3.0), "c": F.lit(2.0)})) == ["c"]
    assert one(spark, states.lowest({"a": none, "b": none})) == [None]


def test_critical_by_list_or_keyword(spark):
    assert one(spark, states.is_critical(F.lit("Critico")), states.is_critical(F.lit("Fuga_Menor")),
               states.is_critical(F.lit("Fuga_Menor"), keywords=True),
               states.is_critical(F.lit(None).cast("string"))) == [True, False, True, False]


def test_override_is_strict(spark):
    assert one(spark, states.critical_override(F.lit("Normal"), F.lit(0.35)),
               states.critical_override(F.lit("Normal"), F.lit(0.36))) == ["Normal", "Critico"]


def test_expected_rul_matches_the_formula(spark):
    def plain(hours, temp, load, health, life, sens):
        stress = sens * (.35 * min(2.5, max(.4, (temp - 15) / 15)) + .35 * 1 + .3 * min(1.6, max(.7, load)))
        days = max(0, life * health / stress - 1.1 * hours) / 24
        if hours / life > .7:
            days *= max(.1, 1 - (hours / life - .7) * 2)
        return min(25, max(.5, days))

    for hours, temp, load, health in [(100, 22, 1.0, .9), (1500, 30, 1.0, .5), (900, 10, .2, 1.0)]:
        got = one(spark, physics.expected_rul(F.lit(float(hours)), F.lit(float(temp)), F.lit(load),
                                              F.lit(health), "bomba_aceite"))[0]
        assert got == pytest.approx(plain(hours, temp, load, health, 1800, 1.4))


def test_rule_state(spark):
    ruls = {"bomba_aceite": F.lit(0.8), "filtro_frenos": F.lit(0.8)}
    assert one(spark, physics.rule_state(ruls, [F.lit(1.0)])) == ["Fallo_Inminente_Bomba_Aceite"]
    assert one(spark, physics.rule_state({"x": F.lit(20.0)}, [F.lit(0.6)], F.lit(False))) == ["INACTIVO"]


def test_stable_hash_is_uniform_and_repeatable(spark):
    df = spark.range(4000).select(hashing.stable_uniform(F.col("id")).alias("u"))
    got = df.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(got[0] - .5) < .02 and 0 <= got[1] and got[2] < 1
    assert df.exceptAll(df).count() == 0
