"""Month-over-month KPIs over the monthly KPI table.

The KPI table is small (one row per month, or a few), but the operators do not
assume it: the month filter is a plain range on the stored column so it reaches
the Parquet scan, and the previous-month lookup is a keyed one-pass shift
(grouped by month), not a window over the whole table.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..sources.readers import coerce_months, lower_columns

# KPI names in output order, their source column and whether a fall is good.
KPIS = [
    ("monto_total", "monto_total", False),
    ("num_inputs", "num_inputs", False),
    ("nuevos_churns", "nuevos_churn", True),
    ("num_transacciones", "num_transacciones", False),
]
MONTH_RE = re.compile(r"^(\d{4})-(\d{1,2})$")


def parse_month(month: str) -> _dt.date:
    """First day of ``YYYY-MM``; ValueError for anything else."""
    m = MONTH_RE.match(month or "")
    if not m or not 1 <= int(m.group(2)) <= 12:
        raise ValueError(f"invalid month {month!r}; use YYYY-MM")
    return _dt.date(int(m.group(1)), int(m.group(2)), 1)


def add_months(d: _dt.date, n: int) -> _dt.date:
    k = d.year * 12 + d.month - 1 + n
    return _dt.date(k // 12, k % 12 + 1, 1)


def months(kpi_table: DataFrame) -> DataFrame:
    """Distinct months newest first (A5, X9) with their long Spanish name (X10): mes, etiqueta."""
    keys = kpi_table.select(X.month_key("mes").alias("mes")).filter(F.col("mes").isNotNull()).distinct()
    return keys.select("mes", X.month_name_long_es("mes").alias("etiqueta")).orderBy(F.col("mes").desc())


def months_needed(month: str) -> tuple[_dt.date, _dt.date]:
    """First day of the month before ``month`` and first day of the month after it: what
    :func:`global_kpis` reads, for :func:`rollups.monthly_kpis`'s ``between`` (P11)."""
    current = parse_month(month)
    return add_months(current, -1), add_months(current, 1)


def _month_sums(kpi_table: DataFrame, start: _dt.date) -> list:
    """Conditional sums for the month starting at ``start`` (empty month → zeros, A3)."""
    in_month = (F.col("mes") >= F.lit(start)) & (F.col("mes") < F.lit(add_months(start, 1)))
    out = []
    for _, src, _ in KPIS:
        value = F.col(src).cast("decimal(18,2)") if src == "monto_total" else F.col(src)
        s = F.sum(F.when(in_month, value))
        out.append(s)
    return out


def global_kpis(kpi_table: DataFrame, month: str) -> DataFrame:
    """The four KPIs of ``month`` against the month before.

    Output: kpi, valor, previo, porcentaje, es_bueno, valor_texto — one row per
    KPI. Only rows of the two months are read: the range filter on ``mes`` is
    pushed to the scan.
    """
    current = parse_month(month)
    previous = add_months(current, -1)
    mes = F.col("mes").cast("date")
    two_months = kpi_table.withColumn("mes", mes).filter(
        (F.col("mes") >= F.lit(previous)) & (F.col("mes") < F.lit(add_months(current, 1)))
    )
    cur_sums, prev_sums = _month_sums(two_months, current), _month_sums(two_months, previous)
    aggs = []
    for i, (name, _, _) in enumerate(KPIS):
        aggs.append(F.coalesce(cur_sums[i].cast("double"), F.lit(0.0)).alias(f"{name}__valor"))
        aggs.append(F.coalesce(prev_sums[i].cast("double"), F.lit(0.0)).alias(f"{name}__previo"))
    wide = two_months.agg(*aggs)
    out = _long_form(wide, [name for name, _, _ in KPIS])
    # display text of the card (X18): the amount in millions, counts with separators
    text = F.when(F.col("kpi") == F.lit("monto_total"), X.money_millions("valor")).otherwise(X.whole_number_text("valor"))
    return out.withColumn("valor_texto", text)


def _long_form(wide: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    inverted = {name: inv for name, _, inv in KPIS}
    stack_args = ", ".join(f"'{n}', `{n}__valor`, `{n}__previo`" for n in names)
    long = wide.select(
        *keep, F.expr(f"stack({len(names)}, {stack_args}) AS (kpi, valor, previo)")
    )
    pct = X.pct_change("valor", "previo")
    is_inverted = F.col("kpi").isin([n for n in names if inverted[n]])
    return long.withColumns({"porcentaje": pct, "es_bueno": X.change_is_good(pct, is_inverted)})


def monthly_totals(kpi_table: DataFrame) -> DataFrame:
    """KPI sums per calendar month (mes as month-start date); rows without a readable
    month belong to none and are left out (S6)."""
    dated = kpi_table.withColumn("mes", X.month_start("mes")).filter(F.col("mes").isNotNull())
    return dated.groupBy("mes").agg(
        *[
            (X.money_sum(src) if src == "monto_total" else F.sum(src).cast("double")).alias(name)
            for name, src, _ in KPIS
        ]
    )


def kpi_changes(kpi_table: DataFrame) -> DataFrame:
    """Month-over-month change of every KPI for every month (J3 over all months).

    Output: mes (yyyy-MM), kpi, valor, previo, porcentaje, es_bueno. Each month's
    totals are emitted twice - for the month itself and as the previous month of
    the month after - and grouped by month: the equi-join of a month with
    ``add_months(mes, -1)`` done in one pass, so the totals are computed once.
    A gap in the months gives a previous value of 0 (a ``lag`` would silently
    skip the gap).
    """
    totals = monthly_totals(kpi_table)
    names = [n for n, _, _ in KPIS]
    as_current = F.struct(F.col("mes").alias("mes"), F.lit(True).alias("cur"), *[F.col(n) for n in names])
    as_previous = F.struct(
        F.add_months(F.col("mes"), 1).alias("mes"), F.lit(False).alias("cur"), *[F.col(n) for n in names]
    )
    shifted = totals.select(F.explode(F.array(as_current, as_previous)).alias("r")).select("r.*")
    cur = F.col("cur")
    joined = (
        shifted.groupBy("mes")
        .agg(
            F.max(cur.cast("int")).alias("_has_month"),
            *[F.sum(F.when(cur, F.col(n))).alias(f"{n}__valor") for n in names],
            *[F.coalesce(F.sum(F.when(~cur, F.col(n))), F.lit(0.0)).alias(f"{n}__previo") for n in names],
        )
        .filter(F.col("_has_month") == 1)
    )
    out = _long_form(joined, names, keep=["mes"])
    return out.withColumn("mes", X.month_key("mes"))


def churn_timeline(counts: DataFrame) -> DataFrame:
    """Churn rows by month, months as ``yyyy-MM``, sorted.

    Column names are lower-cased; when a ``mes`` column exists it is parsed,
    unparseable months are dropped, and rows are sorted by month.
    """
    df = lower_columns(counts)
    if "mes" not in df.columns:
        return df
    df = coerce_months(df, "mes").withColumn("mes", X.month_key("mes"))
    return df.orderBy("mes")
