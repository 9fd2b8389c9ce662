"""KPIs, rollups, segments and pivots on tiny inline frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from retenta.operators import kpis, monthly, rollups, segments

KPI_SCHEMA = "mes date, monto_total double, num_inputs long, nuevos_churn long, num_transacciones long"


def m(y, mo):
    return dt.date(y, mo, 1)


@pytest.fixture
def kpi(spark):
    return spark.createDataFrame(
        [
            (m(2025, 1), 100.0, 10, 4, 20),
            (m(2025, 2), 150.0, 5, 2, 20),
            (m(2025, 2), 50.0, 5, 0, 0),  # second row of the same month: summed
            (m(2025, 4), 10.0, 0, 1, 1),  # gap: March missing
        ],
        KPI_SCHEMA,
    )


def test_global_kpis(kpi):
    out = {r.kpi: r for r in kpis.global_kpis(kpi, "2025-02").collect()}
    assert out["monto_total"].valor == 200.0 and out["monto_total"].porcentaje == 100.0 and out["monto_total"].es_bueno
    assert out["num_inputs"].porcentaje == 0.0 and out["num_inputs"].es_bueno
    assert out["nuevos_churns"].porcentaje == -50.0 and out["nuevos_churns"].es_bueno  # inverted: fewer is good
    assert out["num_transacciones"].valor == 20.0


def test_global_kpis_empty_and_previous_missing(kpi):
    out = {r.kpi: r for r in kpis.global_kpis(kpi, "2025-04").collect()}
    assert out["monto_total"].previo == 0.0 and out["monto_total"].porcentaje == 100.0
    assert out["num_inputs"].valor == 0.0 and out["num_inputs"].porcentaje == 0.0
    empty = {r.kpi: r for r in kpis.global_kpis(kpi, "2030-01").collect()}
    assert all(r.valor == 0.0 and r.porcentaje == 0.0 for r in empty.values())


@pytest.mark.parametrize("bad", ["2025-13", "2025/01", "abc", "", "25-01"])
def test_global_kpis_rejects_malformed_month(kpi, bad):
    with pytest.raises(ValueError):
        kpis.global_kpis(kpi, bad)


def test_kpi_changes_gap_reads_zero(kpi):
    out = {(r.mes, r.kpi): r for r in kpis.kpi_changes(kpi).collect()}
    # April's previous month (March) is missing: previous 0, not February's value
    assert out[("2025-04", "monto_total")].previo == 0.0
    assert out[("2025-02", "monto_total")].previo == 100.0
    assert len(out) == 12


def test_months_newest_first(kpi):
    assert [(r.mes, r.etiqueta) for r in kpis.months(kpi).collect()] == [
        ("2025-04", "abril de 2025"), ("2025-02", "febrero de 2025"), ("2025-01", "enero de 2025")]


def test_churn_timeline_coerces_and_lowercases(spark):
    df = spark.createDataFrame([("2025-02-01", 3), ("garbage", 9), ("2025-01-15", 1)], "MES string, Count long")
    out = kpis.churn_timeline(df).collect()
    assert [(r.mes, r["count"]) for r in out] == [("2025-01", 1), ("2025-02", 3)]
    no_mes = spark.createDataFrame([("CHURN", 3)], "UsuarioChurn string, count long")
    assert kpis.churn_timeline(no_mes).columns == ["usuariochurn", "count"]


def test_monthly_kpis_rollup(spark):
    tx = spark.createDataFrame(
        [(1, 10.10, dt.datetime(2024, 1, 5)), (1, 0.2, dt.datetime(2024, 1, 6)), (2, 5.0, dt.datetime(2024, 9, 1))],
        "user_id long, monto double, fecha_hora timestamp_ntz",
    )
    conv = spark.createDataFrame([(1, dt.datetime(2024, 3, 1), "hola")], "user_id long, date timestamp_ntz, input string")
    out = {r.mes: r for r in rollups.monthly_kpis(tx, conv).collect()}
    assert out[dt.date(2024, 1, 1)].monto_total == 10.3 and out[dt.date(2024, 1, 1)].num_transacciones == 2
    assert out[dt.date(2024, 3, 1)].num_inputs == 1 and out[dt.date(2024, 3, 1)].monto_total == 0.0
    # client 1: last tx Jan 6 + 181 days = Jul 5 <= Sep 1: churned in July
    assert out[dt.date(2024, 7, 1)].nuevos_churn == 1
    assert sum(r.nuevos_churn for r in out.values()) == 1


def test_top_per_month_ties_to_smaller_key(spark):
    ev = spark.createDataFrame(
        [(dt.datetime(2024, 1, d), k) for d, k in [(1, "b"), (2, "a"), (3, "c"), (4, "d"), (5, "d")]],
        "fecha timestamp_ntz, input string",
    )
    out = rollups.top_inputs_by_month(ev, k=3).collect()
    assert [(r.input, r["count"]) for r in sorted(out, key=lambda r: (-r["count"], r.input))] == [("d", 2), ("a", 1), ("b", 1)]


def test_churn_totals_both_labels_present(spark):
    df = spark.createDataFrame([("NO CHURN",), (" no churn ",)], "UsuarioChurn string")
    assert dict((r.status, r.cantidad) for r in segments.churn_totals(df).collect()) == {"Churn": 0, "No Churn": 2}
    counts = spark.createDataFrame([(" churn", 3), ("No Churn", 4), ("CHURN", 1)], "UsuarioChurn string, count long")
    assert [tuple(r) for r in segments.churn_totals_from_counts(counts).collect()] == [("Churn", 4), ("No Churn", 4)]


def test_state_map_drops_null_state(spark):
    df = spark.createDataFrame(
        [(1, "A", "CHURN"), (2, "A", "NO CHURN"), (3, "A", "NO CHURN"), (4, None, "CHURN"), (None, "B", "CHURN")],
        "user_id long, estado string, UsuarioChurn string",
    )
    out = {r.nombre: r for r in segments.state_map(df).collect()}
    assert set(out) == {"A", "B"}
    assert out["A"].clientes == 3 and out["A"].churn_pct == 33.3 and out["A"].severidad == "Medio"
    assert out["B"].clientes == 0 and out["B"].churn_pct is None  # zero divisor guarded


def test_age_profile_only_occupied_bands(spark):
    df = spark.createDataFrame(
        [(1, 20, 100.0, "CHURN"), (2, 25, None, "NO CHURN"), (3, 70, 300.5, "NO CHURN"), (4, 10, 5.0, "CHURN"), (5, 30, None, "CHURN")],
        "user_id long, edad long, ingreso_mensual_mxn double, UsuarioChurn string",
    )
    out = {r.rango_edad: r for r in segments.age_profile(df).collect()}
    assert set(out) == {"18–25", "26–35", "65+"}
    assert out["18–25"].ingreso_promedio == 100 and out["18–25"].churn_pct == 50.0 and out["18–25"].total == 2
    assert out["65+"].ingreso_promedio == 300  # 300.5 rounds half to even
    assert out["26–35"].ingreso_promedio is None  # band without income


def test_top_products_column_detection(spark):
    t = spark.createDataFrame([("x", 5, 12.345), ("y", 9, None), ("z", 9, 1.0)], "Nombre_Producto string, total_usos long, pct_churn double")
    out = [tuple(r) for r in segments.top_products(t, n=2).collect()]
    assert out == [("y", 9, 0.0, 100.0), ("z", 9, 1.0, 100.0)]
    positional = spark.createDataFrame([("a", 3.9)], "col1 string, col2 double")
    assert [tuple(r) for r in segments.top_products(positional).collect()] == [("a", 3, 0.0, 100.0)]


def test_seeded_sample_size_and_repeatability(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "user_id long")
    a = [r.user_id for r in segments.seeded_sample(df, 10, 42).collect()]
    b = [r.user_id for r in segments.seeded_sample(df.repartition(7), 10, 42).collect()]
    assert len(a) == 10 and a == b
    assert segments.seeded_sample(df, 800, 42).count() == 50


def test_region_match_aliases_and_first_match(spark):
    states = spark.createDataFrame(
        [("CDMX", 10, 12.0), ("Estado de México", 20, 9.0), ("Jalisco", 5, 15.0), ("Baja California Sur", 1, 1.0), ("Baja California", 2, 2.0)],
        "nombre string, clientes long, churn_pct double",
    )
    layer = spark.createDataFrame(
        [(1, "Distrito Federal"), (2, "México"), (3, "Jalisco"), (4, "Baja California"), (5, "Sonora")],
        "map_order long, map_name string",
    )
    out = {r.map_order: (r.nombre, r.nivel) for r in segments.region_match(layer, states).collect()}
    assert out[1] == ("CDMX", 3)
    assert out[2] == ("Estado de México", 1)
    assert out[3] == ("Jalisco", 4)
    assert out[4][0] == "Baja California"  # both contain it: first in name order
    assert out[5] == (None, None)


def test_lookup_states_last_wins(spark):
    states = spark.createDataFrame([("A", 1, 5.0, 1), ("A", 2, 7.0, 2), ("B", 3, 1.0, 1)], "nombre string, clientes long, churn_pct double, orden long")
    layer = spark.createDataFrame([(1, "A"), (2, "C")], "map_order long, map_name string")
    out = {r.map_order: (r.clientes, r.churn_pct) for r in segments.lookup_states(layer, states).collect()}
    assert out == {1: (2, 7.0), 2: (None, None)}


def test_pivots(spark):
    top = spark.createDataFrame(
        [(m(2025, 1), "a", 3), (m(2025, 1), "b", 1), (m(2024, 12), "b", 2)], "month date, input string, count long"
    )
    out = [tuple(r) for r in monthly.inputs_pivot(top, ["a", "b", "c"]).collect()]
    assert out == [("2024-12", "Dic 2024", 0, 2, 0, 0), ("2025-01", "Ene 2025", 3, 1, 0, 0)]
    assert [tuple(r) for r in monthly.inputs_pivot(top, ["a"]).collect()] == [("2024-12", "Dic 2024", 0, 2), ("2025-01", "Ene 2025", 3, 1)]
    assert monthly.inputs_pivot(top).columns == ["mes_clave", "mes", "a", "b", "otros"]
    ops = spark.createDataFrame(
        [(m(2025, 1), "x", 1_234_567.0), (m(2025, 1), "y", 2_000_000.0)], "month date, tipo_operacion string, monto double"
    )
    r = monthly.operations_pivot(ops, ["x", "y", "z"]).first()
    assert (r.x, r.y, r.z, r.otros, r.total) == (1.23, 2.0, 0.0, 0.0, 3.23)
    r = monthly.operations_pivot(ops, ["x"]).first()  # an unlisted value stays in the total
    assert (r.x, r.otros, r.total) == (1.23, 2.0, 3.23)
    assert monthly.operations_pivot(ops).columns == ["mes_clave", "mes", "x", "y", "otros", "total"]


def test_income_sample_and_split(spark):
    df = spark.createDataFrame(
        [(i, 20 + i, 100.0 * i, "CHURN" if i % 3 == 0 else ("1" if i % 3 == 1 else "churn")) for i in range(30)],
        "user_id long, edad long, ingreso_mensual_mxn double, UsuarioChurn string",
    )
    sample = segments.income_sample(df, n=12, seed=42)
    assert sample.columns == ["edad", "ingreso", "status"] and sample.count() == 12
    churn, no_churn = segments.split_by_status(segments.income_sample(df, n=30))
    # "churn" (lower case) is not an exact code: NO CHURN
    assert churn.count() == 20 and no_churn.count() == 10


def test_top_n_by_partition_groups_is_exact(spark):
    df = spark.range(0, 6000, numPartitions=600).withColumn("h", F.md5(F.col("id").cast("string")))
    want = [r.id for r in df.orderBy("h", "id").limit(150).collect()]
    got = segments.top_n(df, 150, [F.col("h"), F.col("id")], group=256)
    assert [r.id for r in got.collect()] == want
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_region_match_has_no_limit_on_the_state_list(spark):
    states = spark.range(20_000).selectExpr("concat('S', id) AS nombre", "id AS clientes", "1.0D AS churn_pct")
    layer = spark.createDataFrame([(1, "s19999"), (2, "zona s7"), (3, None), (4, "x"), (5, "S")], "map_order long, map_name string")
    out = {r.map_order: r.nombre for r in segments.region_match(layer, states).collect()}
    assert out == {1: "S1", 2: "S7", 3: None, 4: None, 5: "S0"}


@pytest.mark.parametrize("kind", ["timestamp_ntz", "string"])
def test_global_kpis_accepts_timestamp_or_text_months(spark, kpi, kind):
    other = kpi.withColumn("mes", F.col("mes").cast(kind))
    want = sorted(map(tuple, kpis.global_kpis(kpi, "2025-02").collect()))
    assert sorted(map(tuple, kpis.global_kpis(other, "2025-02").collect())) == want
    assert sorted(map(tuple, kpis.kpi_changes(other).collect())) == sorted(map(tuple, kpis.kpi_changes(kpi).collect()))
