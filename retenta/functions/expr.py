"""Scalar rules as pure ``Column`` expressions.

Every function here builds a Catalyst expression, so the rules run inside
whole-stage codegen next to the scan; none of them needs a Python UDF.

Null and rounding conventions (kept in one place on purpose):
* clipping keeps null (``least``/``greatest`` alone would turn null into a bound);
* rounding is half-even (``bround``), the rule of the table library the rules
  were written against;
* bins are right-closed with the lowest edge excluded; outside every bin is null;
* divisions by zero give null (``try_divide``), never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (labels and thresholds that results must reproduce exactly)
# ---------------------------------------------------------------------------
# Risk bands of the churn score: (0,30] Bajo, (30,60] Medio, (60,100] Alto.
RISK_BANDS = [(0.0, 30.0, "Bajo"), (30.0, 60.0, "Medio"), (60.0, 100.0, "Alto")]
# Age bands: edges 17, 25, 35, 45, 55, 65, 120; labels use an en dash.
AGE_EDGES = [17, 25, 35, 45, 55, 65, 120]
AGE_LABELS = ["18–25", "26–35", "36–45", "46–55", "56–65", "65+"]
# Short Spanish month names, January to December.
MONTHS_SHORT_ES = ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]
# Long Spanish (Mexico) month names, January to December.
MONTHS_LONG_ES = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]
# Churn severity bands on a percentage: >=55 Crítico, >=40 Alto, >=25 Medio, else Bajo.
SEVERITY_BANDS = [(55.0, "Crítico"), (40.0, "Alto"), (25.0, "Medio")]
SEVERITY_FLOOR = "Bajo"
# Map shade thresholds on a percentage: >=14, >=12, >=10, >=8 (levels 4..1), else 0.
SHADE_THRESHOLDS = [(14.0, 4), (12.0, 3), (10.0, 2), (8.0, 1)]
# Score-bar level: >=80 high, >=60 medium, else low; satisfaction flag at <= 5.
SCORE_LEVELS = [(80.0, "alto"), (60.0, "medio")]
SCORE_LEVEL_FLOOR = "bajo"
SATISFACTION_FLAG_MAX = 5.0
# Status labels and the label text that means churn.
CHURN_LABEL = "CHURN"
NO_CHURN_LABEL = "NO CHURN"
CHURN_CODES = ["1", "1.0", "CHURN"]
# Score per status label in the high-risk list.
LABEL_SCORE_CHURN = 95.0
LABEL_SCORE_OTHER = 20.0
# Suggestion by score.
URGENT_SCORE = 70.0
SUGGESTION_URGENT = "Contacto urgente"
SUGGESTION_STANDARD = "Monitoreo estándar"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_keep_null(c: str | Column, lo: float, hi: float) -> Column:
    """``clip`` that leaves null as null (Spark's least/greatest skip nulls)."""
    c = col_of(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def score_login(login_days: str | Column) -> Column:
    """35 points scaled by clip(days since last login, 0, 90) / 90; null stays null."""
    return clip_keep_null(login_days, 0, 90) / F.lit(90.0) * F.lit(35.0)


def score_satisfaction(satisfaction: str | Column) -> Column:
    """25 points scaled by (10 - rating) / 9; a missing rating reads as 5, no clipping."""
    return (F.lit(10.0) - F.coalesce(col_of(satisfaction).cast("double"), F.lit(5.0))) / F.lit(9.0) * F.lit(25.0)


def score_products(active_products: str | Column) -> Column:
    """20 points scaled by (5 - clip(products, 0, 5)) / 5; null stays null."""
    return (F.lit(5.0) - clip_keep_null(active_products, 0, 5)) / F.lit(5.0) * F.lit(20.0)


def score_tx(days_without_tx: str | Column) -> Column:
    """20 points scaled by clip(days without transactions, 0, 90) / 90; none reads as 90."""
    return clip_keep_null(F.coalesce(col_of(days_without_tx), F.lit(90)), 0, 90) / F.lit(90.0) * F.lit(20.0)


def churn_score(
    login_days: str | Column,
    satisfaction: str | Column,
    active_products: str | Column,
    days_without_tx: str | Column,
) -> Column:
    """Weighted churn score 0-100 (X1): the four parts summed in this order, rounded
    half-even to one decimal. Null login or product count leave the score null.
    Operation order is fixed so doubles agree bit for bit with other engines
    evaluating the same formula.
    """
    return combine_score(
        score_login(login_days), score_satisfaction(satisfaction), score_products(active_products), score_tx(days_without_tx)
    )


def combine_score(login: Column, sat: Column, prods: Column, tx: Column) -> Column:
    return F.bround(login + sat + prods + tx, 1)


def right_closed_band(c: str | Column, bands: list[tuple[float, float, str]]) -> Column:
    """Label of the (lo, hi] bin holding ``c``; null outside every bin or for null."""
    c = col_of(c)
    expr = None
    for lo, hi, label in bands:
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def risk_band(score: str | Column) -> Column:
    """Bajo (0,30] | Medio (30,60] | Alto (60,100]; 0.0 and above 100 are null."""
    return right_closed_band(score, RISK_BANDS)


def age_band(age: str | Column) -> Column:
    """Age band over right-closed bins 17/25/35/45/55/65/120."""
    bands = [(AGE_EDGES[i], AGE_EDGES[i + 1], AGE_LABELS[i]) for i in range(len(AGE_LABELS))]
    return right_closed_band(age, bands)


def age_band_rank(age: str | Column) -> Column:
    """1-based position of the age band, for ordering; null outside."""
    c = col_of(age)
    expr = None
    for i in range(len(AGE_LABELS)):
        cond = (c > F.lit(AGE_EDGES[i])) & (c <= F.lit(AGE_EDGES[i + 1]))
        expr = F.when(cond, F.lit(i + 1)) if expr is None else expr.when(cond, F.lit(i + 1))
    return expr


def normalized_label(label: str | Column) -> Column:
    return F.upper(F.trim(col_of(label).cast("string")))


def label_score(label: str | Column) -> Column:
    """95 when the trimmed, upper-cased label is CHURN, else 20."""
    return F.when(normalized_label(label) == F.lit(CHURN_LABEL), F.lit(LABEL_SCORE_CHURN)).otherwise(
        F.lit(LABEL_SCORE_OTHER)
    )


def is_churn(label: str | Column) -> Column:
    """Trimmed, upper-cased label equals CHURN; null is false."""
    return F.coalesce(normalized_label(label) == F.lit(CHURN_LABEL), F.lit(False))


def churn_status(label: str | Column) -> Column:
    """CHURN when the label text is exactly 1, 1.0 or CHURN, else NO CHURN."""
    return F.when(col_of(label).cast("string").isin(CHURN_CODES), F.lit(CHURN_LABEL)).otherwise(
        F.lit(NO_CHURN_LABEL)
    )


def pct_change(actual: str | Column, previous: str | Column) -> Column:
    """Percent change against the previous value.

    previous 0 gives 100 when actual > 0, else 0; otherwise
    round_half_even((actual - previous) / |previous| * 100, 1).
    """
    a, p = col_of(actual).cast("double"), col_of(previous).cast("double")
    return (
        F.when(p == 0, F.when(a > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
        .otherwise(F.bround((a - p) / F.abs(p) * F.lit(100.0), 1))
    )


def change_is_good(pct: str | Column, inverted: bool | Column = False) -> Column:
    """Growth is good (pct >= 0); for inverted measures a fall is good (pct <= 0)."""
    pct = col_of(pct)
    if isinstance(inverted, Column):
        return F.when(inverted, pct <= 0).otherwise(pct >= 0)
    return pct <= 0 if inverted else pct >= 0


def month_key(ts: str | Column) -> Column:
    """``yyyy-MM`` text of a date or timestamp."""
    return F.date_format(col_of(ts), "yyyy-MM")


def month_start(ts: str | Column) -> Column:
    return F.trunc(col_of(ts).cast("date"), "month")


def month_label_es(value: str | Column) -> Column:
    """Short Spanish month label ``Ene 2025``; the raw text when it is not a date."""
    raw = col_of(value).cast("string")
    d = F.coalesce(F.try_to_timestamp(raw), F.try_to_timestamp(raw, F.lit("yyyy-MM")))
    names = F.array(*[F.lit(m) for m in MONTHS_SHORT_ES])
    label = F.concat_ws(" ", F.element_at(names, F.month(d)), F.year(d).cast("string"))
    return F.when(d.isNotNull(), label).otherwise(raw)


def month_name_long_es(ym: str | Column) -> Column:
    """``abril de 2026`` from ``2026-04``."""
    d = F.try_to_timestamp(col_of(ym).cast("string"), F.lit("yyyy-MM"))
    names = F.array(*[F.lit(m) for m in MONTHS_LONG_ES])
    return F.concat(F.element_at(names, F.month(d)), F.lit(" de "), F.year(d).cast("string"))


def severity_band(pct: str | Column) -> Column:
    """Crítico >= 55, Alto >= 40, Medio >= 25, else Bajo (X11)."""
    c = col_of(pct)
    expr = None
    for edge, label in SEVERITY_BANDS:
        expr = F.when(c >= edge, F.lit(label)) if expr is None else expr.when(c >= edge, F.lit(label))
    return expr.otherwise(F.lit(SEVERITY_FLOOR))


def shade_level(pct: str | Column) -> Column:
    """Shade level 4..0 on thresholds 14/12/10/8; null for a missing value."""
    c = col_of(pct)
    expr = F.when(c.isNull(), F.lit(None).cast("int"))
    for edge, level in SHADE_THRESHOLDS:
        expr = expr.when(c >= edge, F.lit(level))
    return expr.otherwise(F.lit(0))


def score_level(score: str | Column) -> Column:
    """alto >= 80, medio >= 60, else bajo."""
    c = col_of(score)
    expr = None
    for edge, label in SCORE_LEVELS:
        expr = F.when(c >= edge, F.lit(label)) if expr is None else expr.when(c >= edge, F.lit(label))
    return expr.otherwise(F.lit(SCORE_LEVEL_FLOOR))


def low_satisfaction(sat: str | Column) -> Column:
    """Satisfaction at or below 5."""
    return col_of(sat) <= F.lit(SATISFACTION_FLAG_MAX)


def suggestion(score: str | Column) -> Column:
    """Contacto urgente at score >= 70, else Monitoreo estándar."""
    return F.when(col_of(score) >= URGENT_SCORE, F.lit(SUGGESTION_URGENT)).otherwise(F.lit(SUGGESTION_STANDARD))


def truncated_percent(p: str | Column) -> Column:
    """Probability to a whole percent, truncated toward zero."""
    return (col_of(p) * F.lit(100.0)).cast("int")


def predicted_class(p: str | Column, threshold: float = 0.5) -> Column:
    """1 when the probability reaches the threshold."""
    return (col_of(p) >= F.lit(threshold)).cast("int")


def js_round(c: str | Column) -> Column:
    """``Math.round``: half rounds up, also for negatives."""
    return F.floor(col_of(c) + F.lit(0.5))


def money_millions(c: str | Column) -> Column:
    """``$12.3M`` (X18): millions rounded half-even to one decimal, then printed."""
    return F.format_string("$%.1fM", F.bround(col_of(c) / F.lit(1_000_000.0), 1))


def whole_number_text(c: str | Column) -> Column:
    """``1,234`` (X18): a count with thousands separators."""
    return F.format_number(col_of(c), 0)


def thousands_label(c: str | Column) -> Column:
    """``$12k`` with ``Math.round`` of the thousands."""
    return F.concat(F.lit("$"), js_round(col_of(c) / F.lit(1000.0)).cast("string"), F.lit("k"))


def whole_days_between(start: str | Column, end: str | Column) -> Column:
    """Whole 24-hour blocks from ``start`` to ``end`` (a timedelta's ``days``)."""
    return F.timestamp_diff("DAY", col_of(start), col_of(end))


def money_sum(c: str | Column) -> Column:
    """Sum of amounts in cents, independent of summation order, as double."""
    return F.sum(col_of(c).cast("decimal(18,2)")).cast("double")


def ratio_pct(numerator: str | Column, denominator: str | Column, digits: int = 1) -> Column:
    """numerator / denominator * 100, half-even rounded; null for a zero denominator."""
    return F.bround(
        F.try_divide(col_of(numerator).cast("double"), col_of(denominator).cast("double")) * F.lit(100.0), digits
    )
