"""Month × category pivots for the dashboard charts.

Each cell is one conditional sum (``sum(when(key = value, measure))``) in a single
grouped aggregate: whole-stage generated code, partial/final on the month. With a
list of values the output columns are fixed, and whatever is not in the list is
summed in one more column, ``otros``; without one, the distinct values are found
first. Totals never depend on the list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X

MILLION = 1_000_000.0


def _labels(month_col: str = "month") -> list:
    return [X.month_key(month_col).alias("mes_clave"), X.month_label_es(month_col).alias("mes")]


OTHERS = "otros"


def _values(df: DataFrame, col: str, values: Sequence[str] | None) -> list[str]:
    """The given values, or all distinct ones in order (the output's columns)."""
    if values is not None:
        return list(values)
    return [r[0] for r in df.select(col).distinct().filter(F.col(col).isNotNull()).orderBy(col).collect()]


def _is_other(col: str, values: Sequence[str]):
    return F.coalesce(~F.col(col).isin(list(values)), F.lit(True))


def inputs_pivot(top_inputs: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    """Month × input, summed counts, missing → 0, whole numbers.

    Output: mes_clave (yyyy-MM, the sort key, D4), mes ("Ene 2025"), then one
    long column per input value and ``otros``; sorted chronologically. The pivot groups by the
    month itself, so input that is already partitioned by month (the top-k per
    month) is pivoted without another shuffle; the labels are derived after.
    """
    values = _values(top_inputs, "input", values)
    wide = top_inputs.groupBy("month").agg(
        *[F.sum(F.when(F.col("input") == F.lit(v), F.col("count"))).alias(v) for v in values],
        F.sum(F.when(_is_other("input", values), F.col("count"))).alias(OTHERS),
    )
    return wide.select(
        *_labels(), *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("long").alias(v) for v in [*values, OTHERS]]
    ).orderBy("mes_clave")


def operations_pivot(top_operations: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    """Month × operation type, summed amounts in millions.

    Missing cells are 0; ``total`` is the sum of all values, listed or not, taken before scaling; every
    amount is divided by one million and rounded half-even to 2 decimals.
    Output: mes_clave, mes, one double column per value, otros, total.
    """
    amount = F.col("monto").cast("decimal(18,2)")
    values = _values(top_operations, "tipo_operacion", values)
    wide = top_operations.groupBy("month").agg(
        *[F.sum(F.when(F.col("tipo_operacion") == F.lit(v), amount)).alias(v) for v in values],
        F.sum(F.when(_is_other("tipo_operacion", values), amount)).alias(OTHERS),
        F.sum(amount).alias("total"),
    )
    zero = F.lit(0).cast("decimal(28,2)")
    scaled = [
        F.bround(F.coalesce(F.col(f"`{v}`"), zero).cast("double") / F.lit(MILLION), 2).alias(v)
        for v in [*values, OTHERS, "total"]
    ]
    return wide.select(*_labels(), *scaled).orderBy("mes_clave")
