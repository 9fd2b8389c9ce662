"""Every operator accepts empty inputs and returns a well-formed (usually empty) frame."""

from pyspark.sql import functions as F

from retenta.operators import actions, features, kpis, lookup, model, monthly, rollups, scoring, segments

CLIENTS = (
    "user_id long, estado string, ciudad string, edad long, ingreso_mensual_mxn double, "
    "dias_desde_ultimo_login long, satisfaccion_1_10 double, num_productos_activos long, "
    "es_hey_pro boolean, UsuarioChurn string"
)
TX = "user_id long, monto double, fecha_hora timestamp_ntz, tipo_operacion string"
PRODUCTS = "user_id long, producto string, fecha_apertura timestamp_ntz"
CONV = "user_id long, date timestamp_ntz, input string"
KPI = "mes date, monto_total double, num_inputs long, nuevos_churn long, num_transacciones long"


def test_empty_everything(spark):
    c = spark.createDataFrame([], CLIENTS)
    t = spark.createDataFrame([], TX)
    p = spark.createDataFrame([], PRODUCTS)
    v = spark.createDataFrame([], CONV)
    k = spark.createDataFrame([], KPI)

    scored = scoring.churn_scores(c, t)
    assert scored.count() == 0
    assert scoring.high_risk_top(c, t).count() == 0
    assert lookup.high_risk_page(scored).count() == 0
    assert lookup.transaction_pages(t).count() == 0
    assert lookup.conversation_histories(v).count() == 0
    assert rollups.monthly_kpis(t, v).count() == 0
    assert rollups.top_operations_by_month(t).count() == 0
    assert rollups.product_usage(p, c).count() == 0
    assert kpis.months(k).count() == 0
    assert kpis.kpi_changes(k).count() == 0
    assert {r.kpi: r.valor for r in kpis.global_kpis(k, "2025-01").collect()} == {
        "monto_total": 0.0, "num_inputs": 0.0, "nuevos_churns": 0.0, "num_transacciones": 0.0}
    assert [tuple(r) for r in segments.churn_totals(c).collect()] == [("No Churn", 0), ("Churn", 0)]
    assert segments.state_map(c).count() == 0
    assert segments.age_profile(c).count() == 0
    assert segments.income_sample(c).count() == 0
    usage = spark.createDataFrame([], "producto string, usos long, churn_pct double")
    assert segments.top_products(usage).count() == 0
    assert monthly.operations_pivot(rollups.top_operations_by_month(t), ["a"]).count() == 0
    assert actions.retention_actions(scoring.high_risk_list(c, t)).count() == 0
    ft = features.feature_table(
        c, t.withColumn("operacion", F.lit("compra")), p.withColumns({"contrato": F.lit("x"), "activo": F.lit(True)}),
        v.withColumn("props", F.lit("{}")), ["x"], ["y"],
    )
    assert ft.count() == 0
    up = model.scored_upload(ft, model.rule_scorer)
    assert up.count() == 0
    s = model.report_summary(up).first()
    assert s.total_registros == 0 and s.promedio_churn is None
