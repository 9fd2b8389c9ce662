"""Search, filters and paging over scored clients and client histories
(P1-P10, L1-L5, M4).

Every limited result has a total order (the id, or every column, breaks ties)
so a page is the same on every run and in every engine (D5).

Paging plans:
* offset paging (:func:`high_risk_page`) sorts globally and keeps
  ``offset + size`` rows per partition (TakeOrderedAndProject with offset);
  the cost grows with the offset, so deep pages should use
* keyset paging (:func:`high_risk_after`): a filter on the last (score, id)
  seen plus a top-``size``, whose cost does not depend on the page number.
* per-client pages (:func:`transaction_pages`) rank inside each client with a
  ``row_number() <= k`` filter, which Spark plans as WindowGroupLimit: each map
  task keeps at most ``k`` rows per client before the shuffle, so a client that
  owns a third of the table still sends only ``k`` rows per task. Past Spark's
  group-limit threshold the ranking salts each client into buckets first
  (:func:`top_rows_per_key`), still exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X

# The columns of the search and page results, in output order.
SEARCH_COLUMNS = ["user_id", "estado", "ciudad", "churn_score", "riesgo", "satisfaccion_1_10", "es_hey_pro"]
PAGE_COLUMNS = [
    "user_id", "estado", "ciudad", "churn_score", "satisfaccion_1_10", "dias_desde_ultimo_login",
    "num_productos_activos", "es_hey_pro", "ingreso_mensual_mxn", "total_tx",
]
MIN_QUERY_LENGTH = 3
MAX_PAGE_SIZE = 100


def present(df: DataFrame, columns: list[str]) -> list[str]:
    """The listed columns that the frame has, in list order."""
    have = set(df.columns)
    return [c for c in columns if c in have]


def check_page(page: int, page_size: int) -> None:
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be between 1 and {MAX_PAGE_SIZE}")


def regex_match(c: str | Column, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive regex (or literal substring) test; null never matches."""
    text = X.col_of(c).cast("string")
    if literal:
        hit = F.contains(F.lower(text), F.lower(F.lit(pattern)))
    else:
        hit = text.rlike("(?i)" + pattern)
    return F.coalesce(hit, F.lit(False))


def search_clients(scored: DataFrame, q: str, limit: int = 20, literal: bool = False) -> DataFrame:
    """Clients whose id matches ``q`` (case-insensitive regex), first ``limit`` by id."""
    if q is None or len(q) < MIN_QUERY_LENGTH:
        raise ValueError(f"query must have at least {MIN_QUERY_LENGTH} characters")
    return (
        scored.filter(regex_match("user_id", q, literal))
        .orderBy("user_id")
        .limit(limit)
        .select(*present(scored, SEARCH_COLUMNS))
    )


def substring_filter(df: DataFrame, term: str, columns: tuple[str, ...] = ("user_id", "estado")) -> DataFrame:
    """Rows where any of ``columns`` contains ``term``, ignoring case."""
    cond = None
    for c in columns:
        hit = F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lower(F.lit(term))), F.lit(False))
        cond = hit if cond is None else cond | hit
    return df.filter(cond)


def high_risk_filter(
    scored: DataFrame, estado: str | None = None, score_min: float = 0.0, score_max: float = 100.0
) -> DataFrame:
    """Band Alto, optional state (case-insensitive; empty = all), inclusive score range."""
    out = scored.filter(F.col("riesgo") == F.lit("Alto"))
    if estado:
        out = out.filter(F.lower(F.col("estado")) == F.lit(estado.lower()))
    return out.filter(F.col("churn_score").between(F.lit(float(score_min)), F.lit(float(score_max))))


def _with_page_meta(rows: DataFrame, filtered: DataFrame, page: int, page_size: int) -> DataFrame:
    """Page rows plus total, page, page_size, pages; the total is a one-row scalar subquery."""
    total = filtered.agg(F.count(F.lit(1))).scalar()
    return rows.select(
        "*",
        total.alias("total"),
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        F.ceil(total / F.lit(page_size)).cast("long").alias("pages"),
    )


def high_risk_page(
    scored: DataFrame,
    page: int = 1,
    page_size: int = 15,
    estado: str | None = None,
    score_min: float = 0.0,
    score_max: float = 100.0,
) -> DataFrame:
    """One page of high-risk clients by score (desc, then id) with the paging totals (L2).

    ``total`` counts every match (D9); ``pages = ceil(total / page_size)``. The
    total is a scalar subquery: it reads ``scored`` a second time, so ``scored``
    is meant to be a materialized table (``session.materialize``), computed once
    and paged many times, as a dashboard does.
    """
    check_page(page, page_size)
    filtered = high_risk_filter(scored, estado, score_min, score_max)
    rows = (
        filtered.orderBy(F.col("churn_score").desc(), F.col("user_id").asc())
        .offset((page - 1) * page_size)
        .limit(page_size)
        .select(*present(filtered, PAGE_COLUMNS))
    )
    return _with_page_meta(rows, filtered, page, page_size)


def high_risk_after(
    scored: DataFrame,
    last_score: float | None,
    last_id,
    page_size: int = 15,
    estado: str | None = None,
    score_min: float = 0.0,
    score_max: float = 100.0,
) -> DataFrame:
    """Keyset page: the ``page_size`` high-risk clients after (last_score, last_id)."""
    check_page(1, page_size)
    filtered = high_risk_filter(scored, estado, score_min, score_max)
    if last_score is not None:
        s, i = F.col("churn_score"), F.col("user_id")
        filtered = filtered.filter((s < F.lit(last_score)) | ((s == F.lit(last_score)) & (i > F.lit(last_id))))
    return (
        filtered.orderBy(F.col("churn_score").desc(), F.col("user_id").asc())
        .limit(page_size)
        .select(*present(filtered, PAGE_COLUMNS))
    )


def tx_order() -> list[Column]:
    """Newest first; amount and type break ties between same-time transactions."""
    return [F.col("fecha_hora").desc(), F.col("monto").desc(), F.col("tipo_operacion").asc()]


def client_transactions(transactions: DataFrame, user_id, page: int = 1, page_size: int = 20) -> DataFrame:
    """One client's transactions, newest first, one page, timestamps as text.

    Columns: the transaction columns plus ``total``, ``page``, ``page_size``,
    ``pages``; no rows for an unknown client.
    """
    check_page(page, page_size)
    mine = transactions.filter(F.col("user_id") == F.lit(user_id))
    rows = (
        mine.orderBy(*tx_order())
        .offset((page - 1) * page_size)
        .limit(page_size)
        .withColumn("fecha_hora", F.date_format("fecha_hora", "yyyy-MM-dd HH:mm:ss"))
    )
    return _with_page_meta(rows, mine, page, page_size)


GROUP_LIMIT_THRESHOLD = 1000  # Spark plans row_number() <= k as WindowGroupLimit only up to this k
SALT_BUCKETS = 64


def top_rows_per_key(df: DataFrame, key: str, order: list[Column], k: int, salts: int = SALT_BUCKETS) -> DataFrame:
    """The first ``k`` rows of every ``key`` in ``order``, with ``pos`` (1..k), exact.

    Up to ``GROUP_LIMIT_THRESHOLD`` rows the ``row_number() <= k`` filter plans as
    WindowGroupLimit (each map task keeps k rows per key before the shuffle).
    Beyond it, the rows of each key are first spread over ``salts`` buckets by a
    hash of the row and cut to k per (key, bucket); the final ranking then sees
    at most ``salts * k`` rows per key. The union of the bucket winners contains
    the true first k, so the result is exact, and a key that owns a third of
    the table is sorted in ``salts`` pieces instead of one task.
    """
    if k <= GROUP_LIMIT_THRESHOLD:
        w = Window.partitionBy(key).orderBy(*order)
        return df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
    w1 = Window.partitionBy(key, "_salt").orderBy(*order)
    candidates = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(key).orderBy(*order)
    return candidates.withColumn("pos", F.row_number().over(w2)).filter(F.col("pos") <= k)


def transaction_pages(transactions: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """The same page of transactions for every client at once (L3 over all clients).

    Columns: transaction columns, ``pos`` (1-based position in the client's
    history, newest first), ``total`` (the client's transaction count), ``pages``.
    The ranking is :func:`top_rows_per_key` (bounded per client at any page depth);
    the totals are a partial/final count joined on the client.
    """
    check_page(page, page_size)
    first, last = (page - 1) * page_size + 1, page * page_size
    keyed = transactions.filter(F.col("user_id").isNotNull())
    ranked = (
        top_rows_per_key(keyed, "user_id", tx_order(), last)
        .filter(F.col("pos") >= first)
        .withColumn("pos", F.col("pos").cast("long"))
    )
    totals = keyed.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return (
        ranked.join(totals, "user_id")
        .withColumns(
            {
                "fecha_hora": F.date_format("fecha_hora", "yyyy-MM-dd HH:mm:ss"),
                "pages": F.ceil(F.col("total") / F.lit(page_size)).cast("long"),
            }
        )
    )


def client_conversations(conversations: DataFrame, user_id) -> DataFrame:
    """One client's conversations, newest first, all of them, dates as text.

    Sorted on the timestamp, then cast; ``total`` is the client's count.
    """
    mine = conversations.filter(F.col("user_id") == F.lit(user_id))
    total = mine.agg(F.count(F.lit(1))).scalar()
    return (
        mine.select("*", total.alias("total"))
        .orderBy(F.col("date").desc(), *[F.col(c) for c in mine.columns if c != "date"])
        .withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )


def with_client_totals(rows: DataFrame, salts: int = SALT_BUCKETS) -> DataFrame:
    """``rows`` with ``total``, how many of them their client has.

    Rows are counted by (client, salt), the salt being a hash of the row, and joined on
    both: a client that owns a third of the table is spread over ``salts`` join tasks.
    The counts hold only the pairs that occur, so few-row clients cost nothing extra.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)).cast("int"))
    parts = dealt.groupBy("user_id", "_salt").agg(F.count(F.lit(1)).alias("n"))
    totals = parts.groupBy("user_id").agg(F.sum("n").alias("total"))
    spread = parts.select("user_id", "_salt").join(totals, "user_id")
    return dealt.join(spread, ["user_id", "_salt"]).drop("_salt")


def conversation_histories(conversations: DataFrame) -> DataFrame:
    """Every client's conversations with the client's total, newest first per client (L4).

    The per-client totals are joined by :func:`with_client_totals`; the global sort on
    (user_id, date desc) range-partitions on both keys, so one busy client's
    history is spread over several sort tasks instead of landing in one.
    """
    keyed = conversations.filter(F.col("user_id").isNotNull())
    return (
        with_client_totals(keyed)
        .orderBy(
            F.col("user_id").asc(),
            F.col("date").desc(),
            *[F.col(c) for c in keyed.columns if c not in ("user_id", "date")],
        )
        .withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )
