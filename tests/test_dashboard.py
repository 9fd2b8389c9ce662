"""Dashboard tables written once, served from Parquet, equal to the direct computation."""

from retenta.operators import kpis, lookup, segments
from retenta.plans import catalog, dashboard
from retenta.plans import params as P

SF = "/root/testdata/sf0.001"


def test_build_and_serve(spark, tmp_path):
    out = str(tmp_path / "dash")
    paths = dashboard.build_tables(spark, SF, out)
    assert set(paths) == set(dashboard.TABLES)
    t = dashboard.open_tables(spark, [str(tmp_path / "nowhere"), out])
    served = sorted(map(tuple, kpis.global_kpis(t["monthly_kpis"], "1998-03").collect()))
    direct = sorted(map(tuple, catalog.q_global_kpis(spark, SF).collect()))
    assert served == direct
    page = lookup.high_risk_page(t["scored_clients"], **P.HIGH_RISK_PAGE).collect()
    assert [r.user_id for r in page] == [r.user_id for r in catalog.q_high_risk_page(spark, SF).collect()]
    counts = sorted(map(tuple, segments.churn_totals_from_counts(t["churn_label_counts"]).collect()))
    assert counts == sorted(map(tuple, catalog.q_churn_counts(spark, SF).collect()))


def test_missing_tables_follow_policy(spark, tmp_path):
    t = dashboard.open_tables(spark, [str(tmp_path / "empty")])
    assert t["scored_clients"] is None
    assert t["monthly_kpis"].count() == 0
    assert [r.kpi for r in kpis.global_kpis(t["monthly_kpis"], "2025-01").collect()] == [
        "monto_total", "num_inputs", "nuevos_churns", "num_transacciones"]


def test_default_folder_is_the_checkpoint_dir(spark):
    paths = dashboard.build_tables(spark, SF)
    assert all(p.startswith(spark.conf.get("spark.checkpoint.dir")) for p in paths.values())


def test_upload_file_report_equals_dataframe_report(spark, tmp_path):
    from retenta.operators import model

    table = catalog.customer_features(spark, SF)
    cols = ["user_id", "edad", "estado", "ciudad", "dias_desde_ultimo_login", "satisfaccion_1_10",
            "num_productos_activos", "dias_sin_tx"]
    path = str(tmp_path / "upload_csv")
    table.select(*cols).coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    from_file = dashboard.score_upload_file(spark, path)
    direct = model.batch_report(table.select(*cols))
    for part in ("table", "cities", "summary", "scatter"):
        assert sorted(map(tuple, from_file[part].collect())) == sorted(map(tuple, direct[part].collect())), part
    assert from_file["summary"].first().total_registros == table.count()


def test_command_line(spark, tmp_path, capsys):
    from retenta.__main__ import main

    assert main(["list"]) == 0
    assert "churn_scores" in capsys.readouterr().out.split()
    out = str(tmp_path / "state_map")
    assert main(["run", "state_map", "--sf", SF, "--out", out, "--format", "json"]) == 0
    back = spark.read.json(out)
    assert back.count() == spark.read.parquet(f"{SF}/nation.parquet").count()


def test_high_risk_screens_read_only_their_band(spark, tmp_path):
    out = str(tmp_path / "dash_band")
    dashboard.build_tables(spark, SF, out)
    scored = dashboard.open_tables(spark, [out], ["scored_clients"])["scored_clients"]
    page = lookup.high_risk_page(scored, **P.HIGH_RISK_PAGE)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = page._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    import re

    scans = re.findall(r"PartitionFilters: \[[^\]]*\]", plan)
    assert scans and all(re.search(r"\(riesgo#\d+ = Alto\)", f) for f in scans), scans
    assert [r.user_id for r in page.collect()] == [r.user_id for r in catalog.q_high_risk_page(spark, SF).collect()]
    # null bands survive the round trip
    assert scored.count() == catalog.q_churn_scores(spark, SF).count()
