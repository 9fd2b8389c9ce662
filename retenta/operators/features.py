"""Customer feature table (F6): one row per client with the columns that the model names.

Each source table is read once and reduced by one two-level aggregate
(``(user_id, value)``, then ``user_id``), both levels combining map-side, so a
client owning a large share of the rows contributes a handful of rows per map
task to each shuffle. The per-source profiles are joined to the clients on the
id, each side unique per key.

The mean balance needs no row-by-row running balance: the time integral of a balance
that steps by each movement is the sum of ``amount x time until the end``, which is an
ordinary sum, so the client with the most movements costs no more than its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import balances
from .model import OPERATION_FLAGS, PRODUCT_FLAGS

CLIENT_COLUMNS = [
    "user_id", "edad", "sexo", "estado", "ciudad", "nivel_educativo", "ocupacion", "ingreso_mensual_mxn",
    "canal_apertura", "dias_desde_ultimo_login", "preferencia_canal", "satisfaccion_1_10",
    "num_productos_activos", "es_hey_pro",
]


def most_frequent(value: str, count: str) -> Column:
    """The non-null ``value`` of the largest ``count``, ties to the smallest value."""
    v = F.col(value)
    return F.min_by(v, F.when(v.isNotNull(), F.struct((-F.col(count)).alias("n"), v.alias("v"))))


def product_profile(products: DataFrame, flags: Sequence[str] = PRODUCT_FLAGS) -> DataFrame:
    """Per client: a flag for each held product of ``contrato``, the number of distinct
    ``producto`` values among active rows, and the most frequent ``producto``."""
    keyed = products.filter(F.col("user_id").isNotNull())
    held = [F.max((F.col("contrato") == F.lit(v)).cast("int")).alias(v) for v in flags]
    active = F.max((F.col("activo") & F.col("producto").isNotNull()).cast("int")).alias("_activo")
    level1 = keyed.groupBy("user_id", "producto").agg(F.count(F.lit(1)).alias("_n"), active, *held)
    return level1.groupBy("user_id").agg(
        most_frequent("producto", "_n").alias("categoria_mcc_moda"),
        F.coalesce(F.sum("_activo"), F.lit(0)).cast("long").alias("num_productos_activos"),
        *[F.coalesce(F.max(v), F.lit(0)).cast("boolean").alias(v) for v in flags],
    )


def transaction_profile(
    transactions: DataFrame,
    flags: Sequence[str] = OPERATION_FLAGS,
    inflows: Sequence[str] = balances.INFLOWS,
) -> DataFrame:
    """Per client: a flag for each operation of ``operacion``, the most frequent channel
    (``tipo_operacion``), amount statistics (means in whole cents, independent of summation
    order), time-weighted mean balance, days since the first and the last movement.

    Days and balances run up to the last movement of the whole table (a scalar subquery).
    """
    until = transactions.agg(F.max("fecha_hora")).scalar()
    cents = balances.cents_of("monto")
    signed = balances.signed_cents("monto", "operacion", inflows)
    held = F.timestamp_diff("SECOND", F.col("fecha_hora"), until)
    keyed = transactions.filter(F.col("user_id").isNotNull())
    level1 = keyed.groupBy("user_id", "tipo_operacion").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(cents).alias("_c"),
        F.count("monto").alias("_k"),
        F.min("monto").alias("_mn"),
        F.max("monto").alias("_mx"),
        F.min("fecha_hora").alias("_first"),
        F.max("fecha_hora").alias("_last"),
        F.sum(balances.cents_by_seconds(signed, held)).alias("_area"),
        F.sum(F.when(held.isNotNull(), signed)).alias("_net"),
        F.max(F.when(signed.isNotNull(), held)).alias("_held"),
        *[F.max((F.col("operacion") == F.lit(v)).cast("int")).alias(v) for v in flags],
    )
    mean = F.try_divide(F.sum("_c").cast("double"), F.sum("_k").cast("double")) / F.lit(100.0)
    return level1.groupBy("user_id").agg(
        most_frequent("tipo_operacion", "_n").alias("canal_moda"),
        mean.alias("monto_promedio"),
        F.min("_mn").alias("monto_min"),
        F.max("_mx").alias("monto_max"),
        balances.mean_of(F.sum("_area"), F.max("_held"), F.sum("_net")).alias("saldo_promedio"),
        F.timestamp_diff("DAY", F.min("_first"), until).alias("antiguedad_dias"),
        F.timestamp_diff("DAY", F.max("_last"), until).alias("dias_sin_tx"),
        *[F.coalesce(F.max(v), F.lit(0)).cast("boolean").alias(v) for v in flags],
    )


def json_text(props: str, path: str) -> Column:
    """A member of JSON text, as text. Text that is no JSON, a missing member and JSON's
    null are null: such a row has no value and takes no part in a mode."""
    return F.try_variant_get(F.try_parse_json(F.col(props)), path, "string")


def conversation_profile(conversations: DataFrame, device_path: str = "$.k") -> DataFrame:
    """Per client the most frequent ``input`` and the most frequent device, a member of the
    JSON text ``props``. Each row is counted under both in one pass: (client, kind, value)."""
    kinds = F.map_from_arrays(F.array(F.lit("input"), F.lit("dispositivo")), F.array(F.col("input"), json_text("props", device_path)))
    both = conversations.filter(F.col("user_id").isNotNull()).select("user_id", F.explode(kinds).alias("_kind", "_v"))
    counts = both.filter(F.col("_v").isNotNull()).groupBy("user_id", "_kind", "_v").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))
    mode = lambda kind: F.min_by("_v", F.when(F.col("_kind") == kind, rank))
    return counts.groupBy("user_id").agg(mode("input").alias("input"), mode("dispositivo").alias("dispositivo_moda"))


def feature_table(
    clients: DataFrame,
    transactions: DataFrame,
    products: DataFrame,
    conversations: DataFrame,
    product_flags: Sequence[str] = PRODUCT_FLAGS,
    operation_flags: Sequence[str] = OPERATION_FLAGS,
    label_col: str | None = "UsuarioChurn",
) -> DataFrame:
    """One row per client (F6): the client's own columns, then those of its products,
    transactions and conversations, all under the names of the model's feature list.

    ``products``: user_id, producto, contrato, activo. ``transactions``: user_id, monto,
    fecha_hora, tipo_operacion, operacion. ``conversations``: user_id, input, props.
    Clients without rows in a source get false flags, no active products and null
    statistics; a ``num_productos_activos`` that the clients bring is kept.
    """
    have = set(clients.columns)
    base = clients.select(*[c for c in CLIENT_COLUMNS if c in have], *([label_col] if label_col else []))
    held = product_profile(products, product_flags)
    if "num_productos_activos" in have:
        held = held.drop("num_productos_activos")
    out = base
    for piece in (held, transaction_profile(transactions, operation_flags), conversation_profile(conversations)):
        out = out.join(piece, "user_id", "left")
    default = {c: F.lit(False) for c in [*product_flags, *operation_flags]}
    if "num_productos_activos" not in have:
        default["num_productos_activos"] = F.lit(0).cast("long")
    return out.select(*[F.coalesce(F.col(c), default[c]).alias(c) if c in default else F.col(c) for c in out.columns])
