"""Balances over time: what a client's movements leave on the account, held until the next
movement (F6, ``saldo_promedio``).

A balance is zero before a client's first movement and steps by each signed amount. Its
time integral from then to the end is the sum of ``amount x seconds until the end``: no
order and no running balance is needed, so clients of any size are sums that combine
map-side. Month by month the same holds inside a month, on top of the balance carried in;
what is carried in is a running sum over the client's months, of which there are few
whatever the number of movements. Time counts in whole seconds, money in whole cents, both
exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The operations that bring money in; all others take it out.
INFLOWS = ["cashback", "deposito_farmacia", "deposito_oxxo", "retiro_inversion", "transf_entrada"]


def cents_of(amount: str) -> Column:
    return F.round(F.col(amount) * F.lit(100.0)).cast("long")


def signed_cents(amount: str, operation: str, inflows: Sequence[str] = INFLOWS) -> Column:
    """The amount in cents, negative unless the operation brings money in."""
    inflow = F.coalesce(F.col(operation).isin(*inflows), F.lit(False))
    return F.when(inflow, cents_of(amount)).otherwise(-cents_of(amount))


def cents_by_seconds(cents: Column, seconds: Column) -> Column:
    """Their product, in which no client's sum can overflow."""
    return cents.cast("decimal(20,0)") * seconds.cast("decimal(18,0)")


def mean_of(area: Column, seconds: Column, at_end: Column) -> Column:
    """Mean balance of ``area`` cent-seconds; over no time at all the balance at the end."""
    mean = F.try_divide(area.cast("double"), seconds.cast("double"))
    return F.when(seconds > 0, mean).otherwise(at_end.cast("double")) / F.lit(100.0)


def monthly_balances(transactions: DataFrame, inflows: Sequence[str] = INFLOWS) -> DataFrame:
    """A row per client and month, from the month of its first movement to that of the last
    movement of all: user_id, mes (``yyyy-MM``), saldo_inicial, saldo_medio (time-weighted, in
    the first month from the first movement on), saldo_final and movimientos.

    Months without movements carry the balance on. Movements without client, time or amount
    take no part. Rows are summed by client and month first; the window then runs over a
    client's months, and gaps are filled by repeating the month before them.
    """
    until = transactions.agg(F.max("fecha_hora")).scalar()
    moves = transactions.filter(F.col("user_id").isNotNull() & F.col("fecha_hora").isNotNull() & F.col("monto").isNotNull())
    month = F.date_trunc("month", "fecha_hora").cast("date")
    following = lambda m: F.add_months(m, 1).cast("timestamp_ntz")
    end = lambda m: F.least(following(m), until.cast("timestamp_ntz"))
    cents = signed_cents("monto", "operacion", inflows)
    seconds = lambda a, b: F.timestamp_diff("SECOND", a, b)
    by_month = moves.groupBy("user_id", month.alias("mes")).agg(
        F.sum(cents.cast("decimal(20,0)")).alias("net"),
        F.sum(cents_by_seconds(cents, seconds(F.col("fecha_hora").cast("timestamp_ntz"), end(month)))).alias("area"),
        F.min("fecha_hora").cast("timestamp_ntz").alias("first"),
        F.count(F.lit(1)).alias("movimientos"),
    )
    ordered = Window.partitionBy("user_id").orderBy("mes")
    before = F.sum("net").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    last_month = F.trunc(until.cast("date"), "month")
    carried = by_month.withColumns({"before": before, "next": F.coalesce(F.lead("mes").over(ordered), F.add_months(last_month, 1))})
    opening = F.coalesce("before", F.lit(0).cast("decimal(38,0)"))
    months = carried.withColumn("m", F.explode(F.sequence(F.col("mes"), F.add_months("next", -1), F.expr("INTERVAL 1 MONTH"))))
    moved = F.col("m") == F.col("mes")
    start = F.when(moved & F.col("before").isNull(), F.col("first")).otherwise(F.col("m").cast("timestamp_ntz"))
    span = seconds(start, end(F.col("m")))
    closing = opening + F.col("net")
    held = F.when(moved, opening).otherwise(closing)
    area = held * span.cast("decimal(18,0)") + F.when(moved, F.col("area")).otherwise(F.lit(0))
    money = lambda c: c.cast("double") / F.lit(100.0)
    return months.select(
        "user_id",
        F.date_format("m", "yyyy-MM").alias("mes"),
        money(held).alias("saldo_inicial"),
        mean_of(area, span, closing).alias("saldo_medio"),
        money(closing).alias("saldo_final"),
        F.when(moved, F.col("movimientos")).otherwise(F.lit(0)).cast("long").alias("movimientos"),
    )
