"""Retention actions, feature alignment and scoring, readers."""


import pytest
from pyspark.sql import functions as F

from retenta.operators import actions, model
from retenta.sources import readers

HR_SCHEMA = (
    "user_id long, estado string, churn_score double, satisfaccion_1_10 double, "
    "dias_desde_ultimo_login long, total_tx long, ingreso_mensual_mxn double"
)


def test_action_rules_and_precedence(spark):
    df = spark.createDataFrame(
        [
            (1, "Jalisco", 95.0, 3.0, 40, 0, 12_500.0),   # sat <= 5 wins over login and txs
            (2, "Jalisco", 95.0, 8.0, 40, 0, 1_000.0),    # login > 15
            (3, "Jalisco", 95.0, 8.0, 15, 3, 1_000.0),    # txs <= 3
            (4, "Jalisco", 95.0, 8.0, 15, 4, 1_000.0),    # proactive
            (5, None, 95.0, None, None, None, None),      # nulls read as 0 -> sat <= 5
            (6, "Yucatán", 20.0, 5.5, 16, 9, 1_000.0),    # sat 5.5 > 5 -> login
        ],
        HR_SCHEMA,
    )
    out = {r.user_id: r for r in actions.retention_actions(df).collect()}
    assert out[1].motivo == "Insatisfacción Crítica"
    assert out[2].motivo == "Inactividad Prolongada"
    assert out[3].motivo == "Baja Transaccionalidad"
    assert out[4].motivo == "Retención Proactiva"
    assert out[5].motivo == "Insatisfacción Crítica"
    assert out[6].motivo == "Inactividad Prolongada"
    assert "fue de 3/10." in out[1].mensaje_2
    assert "fue de 0/10." in out[5].mensaje_2
    assert "llevas 40 días" in out[2].mensaje_2 and "en Jalisco," in out[2].mensaje_2
    assert "llevas 16 días" in out[6].mensaje_2 and "en Yucatán," in out[6].mensaje_2
    assert out[1].ingreso_k == "$13k" and out[1].nivel_score == "alto" and out[1].satisfaccion_baja
    assert out[6].sugerencia == "Monitoreo estándar"


def test_action_brand_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "X", 95.0, 1.0, 0, 0, 0.0)], HR_SCHEMA)
    r = actions.retention_actions(df, actions.Brand(assistant="Ana", bank="Banco Uno")).first()
    assert r.mensaje_1 == "Hola, soy Ana de Banco Uno. 👋"


def test_action_messages_explode_in_order(spark):
    df = spark.createDataFrame([(1, "X", 95.0, 1.0, 0, 0, 0.0)], HR_SCHEMA)
    msgs = actions.action_messages(actions.retention_actions(df)).collect()
    assert [r.orden for r in msgs] == [1, 2, 3] and msgs[2].mensaje.startswith("Queremos compensarte.")


def test_align_features_imputes(spark):
    up = spark.createDataFrame([("U1", "Jalisco", 45, 3, 1500)], "user_id string, estado string, dias_desde_ultimo_login long, satisfaccion_1_10 long, saldo_actual long")
    out = model.align_features(up, keep=["user_id"])
    assert out.columns == ["user_id"] + [n for n, _ in model.FEATURES]
    r = out.first()
    assert r.estado == "Jalisco" and r.ciudad == "SIN REGISTRO" and r.sexo == "SIN REGISTRO"
    assert r.satisfaccion_1_10 == 3.0 and r.edad == 0 and r.credito_auto is False and r.monto_min == 0.0
    assert dict(out.dtypes)["es_hey_pro"] == "boolean"


def test_uploads_keep_their_numbers_and_survive_bad_cells(spark):
    up = spark.createDataFrame(
        [("a", "1500.75", "45", "3"), ("b", "12x", "?", "")],
        "user_id string, ingreso_mensual_mxn string, dias_desde_ultimo_login string, satisfaccion_1_10 string",
    )
    out = model.scored_upload(up, model.rule_scorer).orderBy("user_id").collect()
    assert [r.ingreso_mensual_mxn for r in out] == ["1500.75", "12x"]
    # b: no login days (0), satisfaction 5, no products, 90 days: 13.9 + 20 + 20
    assert [r.prob_churn for r in out] == [76, 53]
    nums, _, _ = model.model_inputs(up, [("ingreso_mensual_mxn", "int64")])
    assert [r.ingreso_mensual_mxn for r in nums.orderBy("user_id").collect()] == [1500.75, 0.0]


def test_row_index_is_contiguous_across_partitions(spark):
    df = spark.range(0, 103, numPartitions=7).withColumnRenamed("id", "v")
    idx = model.with_row_index(df, "i").collect()
    assert sorted(r.i for r in idx) == list(range(103))
    assert all(r.i == r.v for r in idx)  # input order kept


def test_scored_upload_without_ids(spark):
    up = spark.createDataFrame([(30, 45, 3.0, 0), (40, 0, 10.0, 5)], "edad long, dias_desde_ultimo_login long, satisfaccion_1_10 double, num_productos_activos long")
    out = model.scored_upload(up, model.rule_scorer).orderBy("user_id").collect()
    assert [r.user_id for r in out] == ["N-0", "N-1"]
    # 45 days, sat 3, 0 products, no tx column (90 days): 76.9 -> 76 %
    assert out[0].prob_churn == 76 and out[0].pred_churn == 1 and out[0].ciudad == "SIN REGISTRO"
    assert out[1].prob_churn == 20 and out[1].pred_churn == 0


def test_report_parts(spark):
    scored = spark.createDataFrame(
        [("a", 10, "X"), ("b", 90, "Y"), ("c", 50, "X"), ("d", 90, "Z")], "user_id string, prob_churn int, ciudad string"
    ).withColumn("ingreso_mensual_mxn", F.lit(1))
    assert [r.user_id for r in model.report_table(scored, 2).collect()] == ["b", "d"]
    assert [(r.ciudad, r.prob_churn) for r in model.report_cities(scored, 2).collect()] == [("Y", 90.0), ("Z", 90.0)]
    s = model.report_summary(scored).first()
    assert (s.total_registros, s.promedio_churn, s.promedio_retencion) == (4, 60.0, 40.0)


def test_ml_pipeline_trains_and_scores(spark):
    rows = [(i, "A" if i % 3 else "B", float(i % 10), i % 2 == 0, "CHURN" if i % 10 > 5 else "NO CHURN") for i in range(120)]
    table = spark.createDataFrame(rows, "user_id long, ciudad string, satisfaccion_1_10 double, es_hey_pro boolean, UsuarioChurn string")
    feats = model.table_features(table, exclude=["user_id", "UsuarioChurn"])
    assert feats == [("ciudad", "string"), ("satisfaccion_1_10", "float64"), ("es_hey_pro", "bool")]
    fitted, feats = model.train_churn_model(table, feats, max_iter=5)
    assert model.evaluate_auc(fitted, table, feats) > 0.9
    scored = model.ml_scorer(fitted, feats)(table)
    probs = [r.proba for r in scored.collect()]
    assert len(probs) == 120 and all(0.0 <= p <= 1.0 for p in probs)


def test_model_round_trip(spark, tmp_path):
    rows = [(i, "A" if i % 3 else "B", float(i % 10), "CHURN" if i % 10 > 5 else "NO CHURN") for i in range(80)]
    table = spark.createDataFrame(rows, "user_id long, ciudad string, satisfaccion_1_10 double, UsuarioChurn string")
    feats = model.table_features(table, exclude=["user_id", "UsuarioChurn"])
    fitted, feats = model.train_churn_model(table, feats, max_iter=3)
    path = str(tmp_path / "churn_model")
    model.save_churn_model(fitted, feats, path)
    loaded, loaded_feats = model.load_churn_model(path)
    assert loaded_feats == feats
    a = sorted((r.user_id, r.proba) for r in model.ml_scorer(fitted, feats)(table).collect())
    b = sorted((r.user_id, r.proba) for r in model.ml_scorer(loaded, loaded_feats)(table).collect())
    assert a == b


def test_read_first_existing_policies(spark, tmp_path):
    missing = str(tmp_path / "nope.parquet")
    assert readers.read_first_existing(spark, [missing]) is None
    empty = readers.read_first_existing(spark, [missing], on_missing="empty", empty_schema="a long")
    assert empty.count() == 0 and empty.columns == ["a"]
    with pytest.raises(readers.SourceMissing):
        readers.read_first_existing(spark, [missing], on_missing="error")
    good = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(good)
    assert readers.read_first_existing(spark, [missing, good]).count() == 3


@pytest.mark.parametrize("sep", [",", ";"])
def test_upload_csv_separator_from_header(spark, tmp_path, sep):
    path = tmp_path / f"up{'c' if sep == ',' else 's'}.csv"
    lines = [sep.join(["user_id", "estado", "dias_desde_ultimo_login", "satisfaccion_1_10"]),
             sep.join(["U1", "Nuevo León", "45", "3"]), sep.join(["U2", "Yucatán", "2", "9"])]
    path.write_text("\n".join(lines), encoding="utf-8")
    df = readers.read_upload_csv(spark, str(path))
    assert df.columns == ["user_id", "estado", "dias_desde_ultimo_login", "satisfaccion_1_10"]
    assert [tuple(r) for r in df.collect()] == [("U1", "Nuevo León", 45, 3), ("U2", "Yucatán", 2, 9)]
    typed = readers.read_upload_csv(
        spark, str(path), schema="user_id string, estado string, dias_desde_ultimo_login long, satisfaccion_1_10 double"
    )
    assert [tuple(r) for r in typed.collect()] == [("U1", "Nuevo León", 45, 3.0), ("U2", "Yucatán", 2, 9.0)]


def test_read_table_projects(spark):
    df = readers.read_table(spark, "/root/testdata/sf0.001/customer.parquet", ["c_custkey", "c_acctbal"])
    assert df.columns == ["c_custkey", "c_acctbal"] and df.count() > 0


def test_detect_separator():
    assert readers.detect_separator("a;b;c") == ";"
    assert readers.detect_separator("a,b") == ","
    assert readers.detect_separator(None) == ","


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, "x")], "ProductoNombre long, USOS string")
    assert readers.lower_columns(df).columns == ["productonombre", "usos"]
    assert readers.find_column(df.columns, ["uso"]) == "USOS"
    assert readers.find_column(df.columns, ["zzz"], fallback=0) == "ProductoNombre"
    assert readers.find_column(df.columns, ["zzz"]) is None
    rep = readers.schema_report(spark, {"t": df}).collect()
    assert [tuple(r) for r in rep] == [("t", 1, "ProductoNombre", "bigint"), ("t", 2, "USOS", "string")]


def test_coerce_months_and_count(spark):
    df = spark.createDataFrame([("2025-01-01",), ("x",), (None,)], "mes string")
    assert readers.coerce_months(df).count() == 1
    assert readers.count_unparseable(df).first().filas_descartadas == 2


def test_write_records_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    out = str(tmp_path / "rec")
    readers.write_records(df, out, fmt="json")
    back = spark.read.schema("a long, b string").json(out).collect()
    assert [tuple(r) for r in back] == [(1, None)]


def test_materialize_checkpoint_uses_configured_dir(spark):
    from retenta.session import checkpoint_dir, materialize

    configured = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == configured
    df = materialize(spark.range(5), "checkpoint")
    assert df.count() == 5
    assert materialize(spark.range(3)).count() == 3


def test_checkpoint_dir_when_unset():
    from retenta.session import checkpoint_dir

    class Ctx:
        dir = None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, path):
            self.dir = path

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Ctx()
        conf = Conf()

    s = Session()
    path = checkpoint_dir(s)
    assert "retenta-ckpt-" in path and s.sparkContext.dir == path
    assert checkpoint_dir(s) == path


def test_a_cluster_must_name_its_checkpoint_dir():
    from types import SimpleNamespace

    from retenta.session import checkpoint_dir

    conf = SimpleNamespace(get=lambda key, default=None: "yarn" if key == "spark.master" else default)
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None), conf=conf))
