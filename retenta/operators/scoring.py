"""Churn scoring.

Plan shape of :func:`churn_scores`: a partial/final hash aggregate per client
(map-side combine, so a client owning a large share of the rows leaves each map
task as one row), a global maximum evaluated once as a scalar subquery (partial
max per task, no keyed shuffle, no join), and one left join to the clients on
``user_id`` (both sides unique per key after aggregation: no skew, no row
multiplication).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


def transaction_summary(transactions: DataFrame) -> DataFrame:
    """Per client: total_tx, monto_total, ultima_tx, dias_sin_tx.

    ``dias_sin_tx`` counts whole days from the client's last transaction to the
    last transaction of the whole table (rows without a client included). Rows
    without a client are dropped from the result, as a group-by drops null keys.
    """
    per_user = transactions.groupBy("user_id").agg(
        F.count("monto").alias("total_tx"),
        F.coalesce(X.money_sum("monto"), F.lit(0.0)).alias("monto_total"),
        F.max("fecha_hora").alias("ultima_tx"),
    )
    # global max over every row (rows without a client included): a scalar
    # subquery, partial max per map task, one row per task into the final max.
    fecha_max = transactions.agg(F.max("fecha_hora")).scalar()
    return per_user.filter(F.col("user_id").isNotNull()).select(
        "user_id",
        "total_tx",
        "monto_total",
        "ultima_tx",
        X.whole_days_between(F.col("ultima_tx"), fecha_max).alias("dias_sin_tx"),
    )


def churn_scores(clients: DataFrame, transactions: DataFrame) -> DataFrame:
    """Clients with their transaction summary, churn score and risk band.

    Output: every client column, then total_tx, monto_total, ultima_tx,
    dias_sin_tx, score_login, score_satisfaccion, score_productos, score_tx,
    churn_score, riesgo. Clients without transactions keep null summary columns.
    """
    tx = transaction_summary(transactions)
    joined = clients.join(tx, "user_id", "left")
    parts = joined.withColumns(
        {
            "score_login": X.score_login("dias_desde_ultimo_login"),
            "score_satisfaccion": X.score_satisfaction("satisfaccion_1_10"),
            "score_productos": X.score_products("num_productos_activos"),
            "score_tx": X.score_tx("dias_sin_tx"),
        }
    )
    score = X.combine_score(
        F.col("score_login"), F.col("score_satisfaccion"), F.col("score_productos"), F.col("score_tx")
    )
    return parts.withColumns({"churn_score": score, "riesgo": X.risk_band(score)})


def score_card(scored: DataFrame) -> DataFrame:
    """Per-client card: id, score, band, suggestion (M4; band stays null, D20)."""
    return scored.select(
        F.col("user_id").alias("id"),
        F.col("churn_score").alias("score"),
        "riesgo",
        X.suggestion("churn_score").alias("suggestion"),
    )


def score_card_for(scored: DataFrame, user_id) -> DataFrame:
    """Card of one client: empty when the client is unknown."""
    return score_card(scored.filter(F.col("user_id") == F.lit(user_id))).limit(1)


HIGH_RISK_COLUMNS = [
    "user_id",
    "estado",
    "ciudad",
    "churn_score",
    "satisfaccion_1_10",
    "dias_desde_ultimo_login",
    "num_productos_activos",
    "total_tx",
    "ingreso_mensual_mxn",
]


def high_risk_list(clients: DataFrame, transactions: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Every client whose label score reaches ``threshold`` (M5 without the cut, X5, P10, P1).

    The label score is 95 for CHURN and 20 otherwise; ``total_tx`` is the real
    transaction count (D8, a partial/final count per client joined on the id);
    nulls are filled with 0 on output (P13).
    """
    counts = transactions.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("monto").alias("total_tx")
    )
    scored = clients.withColumn("churn_score", X.label_score("UsuarioChurn")).filter(F.col("churn_score") >= threshold)
    out = (
        scored.join(counts, "user_id", "left")
        .withColumn("total_tx", F.coalesce(F.col("total_tx"), F.lit(0).cast("long")))
        .select(*HIGH_RISK_COLUMNS)
    )
    return fill_zero(
        out, ["satisfaccion_1_10", "dias_desde_ultimo_login", "num_productos_activos", "ingreso_mensual_mxn"]
    )


def high_risk_top(clients: DataFrame, transactions: DataFrame, k: int = 20, threshold: float = 60.0) -> DataFrame:
    """High-risk list, top ``k`` by score, with ``total``, the number of all matches (M5, L1).

    Ties are broken by ``user_id`` so the list is repeatable (D5). Plans as
    TakeOrderedAndProject: each partition keeps its own top ``k``. The total needs the label
    only: a scalar subquery that reads neither transactions nor the other columns.
    """
    total = clients.filter(X.label_score("UsuarioChurn") >= threshold).agg(F.count(F.lit(1))).scalar()
    return (
        high_risk_list(clients, transactions, threshold)
        .orderBy(F.col("churn_score").desc(), F.col("user_id").asc())
        .limit(k)
        .withColumn("total", total)
    )


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null → 0 in the given numeric columns, keeping their types."""
    return df.select(
        *[
            F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )
