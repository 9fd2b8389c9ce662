"""The pre-aggregated tables the dashboard reads.

They are produced from the base tables with partial/final aggregates, so each
job shuffles at most one row per group and map task, however skewed the keys.
Month columns are month-start dates; callers format them (``yyyy-MM``) on output.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X

CHURN_AFTER_DAYS = 180  # fixed value: a client counts as churned after more than 180 days without transactions


def _between(df: DataFrame, column: str, first: _dt.date | None, last: _dt.date | None) -> DataFrame:
    """Rows from ``first`` to before ``last``, by literals of the column's own type, which the
    scan can use to skip files and row groups."""
    kind = df.schema[column].dataType
    if first is not None:
        df = df.filter(F.col(column) >= F.lit(first.isoformat()).cast(kind))
    return df if last is None else df.filter(F.col(column) < F.lit(last.isoformat()).cast(kind))


def new_churn_by_month(
    latest: DataFrame, fecha_max: Column, churn_after_days: int = CHURN_AFTER_DAYS, between: tuple[_dt.date, _dt.date] | None = None
) -> DataFrame:
    """(mes, nuevos_churn) from each client's last transaction (user_id, ultima_tx): counted in
    the month of the day on which the client first qualifies, up to ``fecha_max``."""
    churn_at = F.timestamp_add("DAY", F.lit(churn_after_days + 1), F.col("ultima_tx"))
    qualified = latest.filter(churn_at <= fecha_max)
    if between:
        first, last = (F.lit(day.isoformat()).cast("timestamp_ntz") for day in between)
        qualified = qualified.filter((churn_at >= first) & (churn_at < last))
    return qualified.groupBy(X.month_start(churn_at).alias("mes")).agg(F.count(F.lit(1)).alias("nuevos_churn"))


def monthly_kpis(
    transactions: DataFrame,
    conversations: DataFrame,
    churn_after_days: int = CHURN_AFTER_DAYS,
    between: tuple[_dt.date, _dt.date] | None = None,
) -> DataFrame:
    """Monthly KPI table (F1): mes, monto_total, num_inputs, nuevos_churn, num_transacciones.

    * monto_total, num_transacciones: sum and count of the month's transactions;
    * num_inputs: conversation turns in the month;
    * nuevos_churn: clients whose last transaction lies more than
      ``churn_after_days`` days before the last transaction of the table, counted
      in the month they first qualify (last transaction + churn_after_days + 1 days).

    The three sources are aggregated separately (each partial/final), stacked
    with ``unionByName`` and summed per month: one small shuffle instead of two
    full outer joins. Months where no source has a row do not appear.

    With ``between`` (first day, day after the last; whole months) only those months are
    made, and each source is read in the range they need: transactions and conversations
    of the months themselves, and for new churn the transactions from ``churn_after_days``
    + 1 days before the first month on. A client's last transaction lies in that part, or
    too early to count; so does the table's last, or no client can qualify.
    """
    first, last = between or (None, None)
    since = first - _dt.timedelta(days=churn_after_days + 1) if first else None
    recent = _between(transactions, "fecha_hora", since, None)
    transactions = _between(transactions, "fecha_hora", first, last)
    conversations = _between(conversations, "date", first, last)
    tx = transactions.groupBy(X.month_start("fecha_hora").alias("mes")).agg(
        X.money_sum("monto").alias("monto_total"),
        F.count(F.lit(1)).alias("num_transacciones"),
    )
    conv = conversations.groupBy(X.month_start("date").alias("mes")).agg(F.count(F.lit(1)).alias("num_inputs"))
    latest = recent.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.max("fecha_hora").alias("ultima_tx")
    )
    fecha_max = recent.agg(F.max("fecha_hora")).scalar()  # one-row scalar subquery
    churned = new_churn_by_month(latest, fecha_max, churn_after_days, between)
    stacked = tx.unionByName(conv, allowMissingColumns=True).unionByName(churned, allowMissingColumns=True)
    return stacked.groupBy("mes").agg(
        F.coalesce(F.sum("monto_total"), F.lit(0.0)).alias("monto_total"),
        F.coalesce(F.sum("num_inputs"), F.lit(0)).cast("long").alias("num_inputs"),
        F.coalesce(F.sum("nuevos_churn"), F.lit(0)).cast("long").alias("nuevos_churn"),
        F.coalesce(F.sum("num_transacciones"), F.lit(0)).cast("long").alias("num_transacciones"),
    )


def top_per_month(
    events: DataFrame,
    ts_col: str,
    key_col: str,
    measure: str = "count",
    value_col: str | None = None,
    k: int = 3,
) -> DataFrame:
    """The ``k`` largest keys of each month (F2, F3): month, key, measure.

    ``measure='count'`` counts rows, ``'sum'`` sums ``value_col`` as money. Ties
    go to the smaller key. The ``row_number() <= k`` filter plans as
    WindowGroupLimit, so every (month, key) group is first reduced map-side.
    """
    if measure == "count":
        agg = F.count(F.lit(1)).alias("count")
        out_col = "count"
    elif measure == "sum":
        agg = X.money_sum(value_col).alias(value_col)
        out_col = value_col
    else:
        raise ValueError(f"unknown measure {measure!r}")
    grouped = events.filter(F.col(key_col).isNotNull()).groupBy(X.month_start(ts_col).alias("month"), key_col).agg(agg)
    w = Window.partitionBy("month").orderBy(F.col(out_col).desc(), F.col(key_col).asc())
    return (
        grouped.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("month", key_col, out_col)
    )


def top_inputs_by_month(inputs: DataFrame, k: int = 3) -> DataFrame:
    """Top-``k`` chatbot inputs per month by count (F2): month, input, count."""
    return top_per_month(inputs, "fecha", "input", "count", k=k)


def top_operations_by_month(transactions: DataFrame, k: int = 3) -> DataFrame:
    """Top-``k`` operation types per month by amount (F3): month, tipo_operacion, monto."""
    return top_per_month(transactions, "fecha_hora", "tipo_operacion", "sum", value_col="monto", k=k)


def churn_label_counts(clients: DataFrame, label_col: str = "UsuarioChurn") -> DataFrame:
    """Rows per churn label (F4): UsuarioChurn, count."""
    return clients.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))


def product_usage(products: DataFrame, clients: DataFrame) -> DataFrame:
    """Per product (F5): producto, usos (rows), clientes (distinct holders), churn_pct.

    churn_pct is the share of holders labelled CHURN, half-even to one decimal.
    Products are reduced to (producto, user_id) pairs before the join with the
    clients, so the join sees one row per holder, not one per product row.
    """
    pairs = products.filter(F.col("producto").isNotNull() & F.col("user_id").isNotNull()).groupBy(
        "producto", "user_id"
    ).agg(F.count(F.lit(1)).alias("n"))
    labels = clients.select("user_id", X.is_churn("UsuarioChurn").cast("int").alias("churn"))
    return (
        pairs.join(labels, "user_id", "left")
        .groupBy("producto")
        .agg(
            F.sum("n").alias("usos"),
            F.count(F.lit(1)).alias("clientes"),
            F.coalesce(F.sum("churn"), F.lit(0)).cast("long").alias("churn_sum"),
        )
        .select("producto", "usos", "clientes", X.ratio_pct("churn_sum", "clientes").alias("churn_pct"))
    )
