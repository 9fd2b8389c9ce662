"""Domain tables derived from the TPC-H-like driver tables.

This is the only module that knows the driver schema. Every operator works on the
domain tables below, so pointing the library at real client, transaction, product
and conversation tables means replacing this module only.

| domain table  | columns                                                              |
|---------------|----------------------------------------------------------------------|
| clients       | user_id, estado, ciudad, edad, ingreso_mensual_mxn,                  |
|               | dias_desde_ultimo_login, satisfaccion_1_10, num_productos_activos,   |
|               | es_hey_pro, UsuarioChurn                                             |
| transactions  | user_id, monto, fecha_hora, tipo_operacion   (orders)                |
| products      | user_id, producto, fecha_apertura            (lines ⋈ orders ⋈ part)|
| conversations | user_id, date, input                         (events)                |
| inputs        | fecha, input                                 (lines ⋈ part)          |

Each derivation is mirrored as a SQL CTE in :mod:`retenta.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import OPERATION_FLAGS, PRODUCT_FLAGS
from ..functions.expr import CHURN_LABEL, NO_CHURN_LABEL, whole_days_between

# Fixed values of the mapping.
CHURN_AFTER_DAYS = 180          # no order for more than this many days before the last one → CHURN
RETURN_FLAG = "R"               # lines whose part types count as held products
# Client columns that only the model names; each takes its values in turn, by client key.
ATTRIBUTES = {
    "sexo": ["F", "M"],
    "nivel_educativo": ["Preparatoria", "Licenciatura", "Posgrado"],
    "ocupacion": ["Empleado", "Independiente", "Estudiante", "Jubilado", "Empresario"],
    "canal_apertura": ["App", "Sucursal", "Referido"],
    "preferencia_canal": ["App", "Llamada", "Chat", "Sucursal"],
}


# The driver-table columns this mapping reads, with their stored types.
# Declaring them skips the footer-reading job that schema inference would run
# for every read.
SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _last_order_per_customer(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))


def active_product_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part types over each customer's lines that were returned (user_id, n).

    Every line is read; the return flag is a condition of the count.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    held = F.col("l_returnflag") == RETURN_FLAG
    # count(distinct) plans as a map-side (customer, type) dedup, a shuffle by
    # (customer, type), then a partial count and a shuffle by customer: a
    # customer holding a large share of the lines is spread over its types first
    # and reaches the final count as at most one row per map task.
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(F.count_distinct(F.when(held, F.col("p_type"))).alias("num_productos_activos"))
    )


def clients(spark: SparkSession, sf_dir: str, product_counts: bool = True, attributes: bool = False) -> DataFrame:
    """The client table; without ``product_counts`` lineitem is not read, and with
    ``attributes`` the columns that only the model names are there too."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation has 25 rows at every scale factor: a broadcast with a fixed bound.
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    last = _last_order_per_customer(orders)
    # the global last order: a scalar subquery (partial max per map task)
    overall_last = orders.agg(F.max("o_orderdate")).scalar()
    key = F.col("c_custkey")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    counts = []
    if product_counts:
        joined = joined.join(active_product_counts(spark, sf_dir), key == F.col("user_id"), "left")
        counts = [F.coalesce(F.col("num_productos_activos"), F.lit(0).cast("long")).alias("num_productos_activos")]
    own = [F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int")).alias(c) for c, values in ATTRIBUTES.items()]
    return (
        joined.join(last.filter(F.col("o_custkey").isNotNull()), key == F.col("o_custkey"), "left")
        .select(
            key.alias("user_id"),
            F.col("n_name").alias("estado"),
            F.concat_ws("-", F.col("n_name"), F.col("c_mktsegment")).alias("ciudad"),
            (F.lit(14) + (key * 7) % 110).alias("edad"),
            F.col("c_acctbal").alias("ingreso_mensual_mxn"),
            F.when(key % 13 != 0, (key * 37) % 121).alias("dias_desde_ultimo_login"),
            F.when(key % 11 != 0, (F.lit(1) + key % 10).cast("double")).alias("satisfaccion_1_10"),
            *counts,
            (key % 4 == 0).alias("es_hey_pro"),
            F.when(
                whole_days_between(F.col("last_order"), overall_last) > CHURN_AFTER_DAYS, F.lit(CHURN_LABEL)
            )
            .otherwise(F.lit(NO_CHURN_LABEL))
            .alias("UsuarioChurn"),
            *(own if attributes else []),
        )
    )


def feature_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Clients, transactions, products and conversations with what the feature table needs
    beside the columns above: operation and contract under the model's names (by order and
    part key), whether a product is active (its line was returned), and the conversations'
    JSON text, cut off in every 17th event and null in every 19th."""
    name = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))
    orders = table(spark, sf_dir, "orders")
    moves = orders.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("monto"),
        F.col("o_orderdate").alias("fecha_hora"),
        F.col("o_orderpriority").alias("tipo_operacion"),
        name(OPERATION_FLAGS, F.col("o_orderkey")).alias("operacion"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    held = (
        lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("p_type").alias("producto"),
            name(PRODUCT_FLAGS, F.col("l_partkey")).alias("contrato"),
            (F.col("l_returnflag") == RETURN_FLAG).alias("activo"),
        )
    )
    event = F.col("event_id")
    props = F.when(event % 17 == 0, F.substring("props", 1, 5)).when(event % 19 != 0, F.col("props"))
    talks = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("input"), props.alias("props"))
    return clients(spark, sf_dir, product_counts=False, attributes=True), moves, held, talks


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("monto"),
        F.col("o_orderdate").alias("fecha_hora"),
        F.col("o_orderpriority").alias("tipo_operacion"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("p_type").alias("producto"),
            F.col("l_shipdate").alias("fecha_apertura"),
        )
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").alias("date"), F.col("event_type").alias("input"), "event_id"
    )


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated chatbot-input stream: one row per line item, the input is its part type."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_shipdate").alias("fecha"), F.col("p_type").alias("input")
    )


def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map layer for the nations: (map_order, map_name).

    Names are lower case; odd keys carry a prefix (``estado nation_3``), so the
    fuzzy matcher meets both directions of its substring rule: the map name
    inside a state name (``nation_1`` in ``NATION_1`` .. ``NATION_19``) and a state
    name inside the map name.
    """
    key = F.col("n_nationkey")
    name = F.lower(F.col("n_name"))
    return table(spark, sf_dir, "nation").select(
        key.alias("map_order"),
        F.when(key % 2 == 1, F.concat(F.lit("estado "), name)).otherwise(name).alias("map_name"),
    )
