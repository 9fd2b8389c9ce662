"""The driver-table mapping produces the documented domain tables."""

from retenta.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_clients_mapping(spark):
    c = fx.clients(spark, SF)
    assert dict(c.dtypes) == {
        "user_id": "bigint", "estado": "string", "ciudad": "string", "edad": "bigint",
        "ingreso_mensual_mxn": "double", "dias_desde_ultimo_login": "bigint", "satisfaccion_1_10": "double",
        "num_productos_activos": "bigint", "es_hey_pro": "boolean", "UsuarioChurn": "string",
    }
    customers = spark.read.parquet(f"{SF}/customer.parquet").count()
    rows = c.collect()
    assert len(rows) == customers == len({r.user_id for r in rows})
    for r in rows:
        assert (r.dias_desde_ultimo_login is None) == (r.user_id % 13 == 0)
        assert (r.satisfaccion_1_10 is None) == (r.user_id % 11 == 0)
        assert 14 <= r.edad <= 123 and r.num_productos_activos >= 0
        assert r.UsuarioChurn in ("CHURN", "NO CHURN") and r.ciudad.startswith(r.estado + "-")
    labels = {r.UsuarioChurn for r in rows}
    assert labels == {"CHURN", "NO CHURN"}


def test_transactions_are_all_orders(spark):
    tx = fx.transactions(spark, SF)
    assert tx.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert tx.columns == ["user_id", "monto", "fecha_hora", "tipo_operacion"]


def test_products_and_inputs_cover_every_line(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert fx.products(spark, SF).count() == lines
    assert fx.inputs(spark, SF).count() == lines


def test_region_layer_spellings(spark):
    got = {r.map_order: r.map_name for r in fx.region_names(spark, SF).collect()}
    assert got[2] == "nation_2" and got[3] == "estado nation_3" and len(got) == 25
