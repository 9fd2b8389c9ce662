"""Churn segments: label totals, state map, age profile, product ranking, income
sample, region matching (A6-A9, A14, J4, J5, M6, L6, P12, S8, X4, X6, X7, X11, X12, X21).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..sources.readers import find_column

# Output labels of the churn totals, in output order.
STATUS_CHURN = "Churn"
STATUS_NO_CHURN = "No Churn"
# Column-name fragments used to find the product table's columns.
PRODUCT_NAME_HINTS = ["producto", "nombre", "name"]
PRODUCT_USE_HINTS = ["uso", "count", "total", "cantidad"]
PRODUCT_CHURN_HINTS = ["churn"]
# Region aliases (data name fragment, map name test).
CAPITAL_DATA = "cdmx"
CAPITAL_MAP = ["distrito", "ciudad de"]


def churn_totals_from_counts(
    label_counts: DataFrame, label_col: str = "UsuarioChurn", count_col: str = "count"
) -> DataFrame:
    """Churn / no-churn totals from a label-count table (A6): status, cantidad.

    Labels are trimmed and upper-cased; both rows are always present.
    """
    key = X.normalized_label(label_col)
    wide = label_counts.agg(
        F.coalesce(F.sum(F.when(key == F.lit(X.CHURN_LABEL), F.col(count_col))), F.lit(0)).cast("long").alias("c"),
        F.coalesce(F.sum(F.when(key == F.lit(X.NO_CHURN_LABEL), F.col(count_col))), F.lit(0)).cast("long").alias("n"),
    )
    return wide.select(F.expr(f"stack(2, '{STATUS_CHURN}', c, '{STATUS_NO_CHURN}', n) AS (status, cantidad)"))


def churn_totals(clients: DataFrame, label_col: str = "UsuarioChurn") -> DataFrame:
    """Churn / no-churn counts from raw clients (A7, D7): status, cantidad.

    One normaliser (trim + upper; 1, 1.0 and CHURN mean churn); both rows always present.
    """
    key = X.normalized_label(label_col)
    churn = key.isin(X.CHURN_CODES)
    wide = clients.agg(
        F.count(F.when(churn, F.lit(1))).alias("c"),
        F.count(F.when(~churn | key.isNull(), F.lit(1))).alias("n"),
    )
    return wide.select(F.expr(f"stack(2, '{STATUS_NO_CHURN}', n, '{STATUS_CHURN}', c) AS (status, cantidad)"))


def state_map(clients: DataFrame) -> DataFrame:
    """Clients and churn % per state (A8, X6, X11, X12): nombre, clientes, churn_pct, severidad, nivel.

    Null states are dropped; ``clientes`` counts non-null ids; churn_pct is
    half-even to one decimal and null when a state has no counted client.
    """
    grp = (
        clients.filter(F.col("estado").isNotNull())
        .groupBy("estado")
        .agg(
            F.count("user_id").alias("clientes"),
            F.sum(X.is_churn("UsuarioChurn").cast("int")).cast("long").alias("churn_sum"),
        )
    )
    pct = X.ratio_pct("churn_sum", "clientes")
    return grp.select(
        F.col("estado").alias("nombre"),
        "clientes",
        pct.alias("churn_pct"),
        X.severity_band(pct).alias("severidad"),
        X.shade_level(pct).alias("nivel"),
    )


def age_profile(clients: DataFrame) -> DataFrame:
    """Mean income, churn % and size per age band, occupied bands only.

    Output: rango_edad, orden, ingreso_promedio (half-even to a whole number,
    null when no income is known), churn_pct, total. The mean is computed in
    whole cents so the result does not depend on summation order.
    """
    banded = clients.select(
        X.age_band("edad").alias("rango_edad"),
        X.age_band_rank("edad").alias("orden"),
        F.round(F.col("ingreso_mensual_mxn") * F.lit(100.0)).cast("long").alias("cents"),
        X.is_churn("UsuarioChurn").cast("int").alias("churn"),
        "user_id",
    ).filter(F.col("rango_edad").isNotNull())
    grp = banded.groupBy("rango_edad", "orden").agg(
        F.sum("cents").alias("cents_sum"),
        F.count("cents").alias("cents_n"),
        F.sum("churn").cast("long").alias("churn_sum"),
        F.count("user_id").alias("total"),
    )
    mean = F.try_divide(F.col("cents_sum").cast("double"), F.col("cents_n").cast("double")) / F.lit(100.0)
    return grp.select(
        "rango_edad",
        "orden",
        F.bround(mean, 0).cast("long").alias("ingreso_promedio"),
        X.ratio_pct("churn_sum", "total").alias("churn_pct"),
        "total",
    )


def top_products(usage_table: DataFrame, n: int = 8) -> DataFrame:
    """First ``n`` products of a usage table with cleaned values.

    Columns are found by name fragment (first match in column order; the name
    falls back to the first column, the uses to the second). Rows are taken in
    an explicit order: uses descending, then name (D5). Output: producto
    (text), usos (whole, truncated; 0 without a use column), churn_pct (half-even
    one decimal, 0 when missing), share (uses over the largest uses among the
    listed rows, floor 1, times 100).
    """
    cols = usage_table.columns
    name_col = find_column(cols, PRODUCT_NAME_HINTS, fallback=0)
    use_col = find_column(cols, PRODUCT_USE_HINTS, fallback=1 if len(cols) > 1 else 0)
    churn_col = find_column(cols, PRODUCT_CHURN_HINTS)
    uses = F.col(use_col).cast("long") if use_col != name_col else F.lit(0).cast("long")
    churn = (
        F.coalesce(F.bround(F.col(churn_col).cast("double"), 1), F.lit(0.0)) if churn_col else F.lit(0.0)
    )
    clean = usage_table.select(
        F.col(name_col).cast("string").alias("producto"), uses.alias("usos"), churn.alias("churn_pct")
    )
    top = clean.orderBy(F.col("usos").desc(), F.col("producto").asc()).limit(n)
    # the largest uses among the listed rows (the list is the top by uses, so this
    # is also the table's largest); the window spans the n rows of the top-n
    # result, which already sits in one partition
    max_uses = F.greatest(F.coalesce(F.max("usos").over(Window.partitionBy()), F.lit(0)), F.lit(1))
    return top.select(
        "producto",
        "usos",
        "churn_pct",
        F.bround(F.col("usos") / max_uses * F.lit(100.0), 1).alias("share"),
    )


PARTITION_GROUP = 256     # input partitions per group in the first cut


def top_n(df: DataFrame, n: int, order: list, group: int = PARTITION_GROUP) -> DataFrame:
    """The first ``n`` rows in ``order``, exact, without funnelling ``n`` rows per partition into one task.

    A plain ``orderBy().limit(n)`` keeps n rows per input partition and merges
    them all in one place (n x partitions rows). Here the rows are first cut to n per group of ``group`` input partitions (``row_number() <= n`` per
    group, a map-side WindowGroupLimit), so the final merge sees n rows per group.
    The n smallest rows of the whole are among the n smallest of each group.
    """
    grp = F.floor(F.spark_partition_id() / F.lit(group))
    w = Window.partitionBy("_grp").orderBy(*order)
    cut = df.withColumn("_grp", grp).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return cut.drop("_grp", "_rn").orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, n: int, seed: int, id_col: str = "user_id") -> DataFrame:
    """Exactly min(n, rows) rows, the same on every run and engine.

    Rows are ranked by md5 of ``seed-id`` (ties by id) and the first ``n`` kept
    with :func:`top_n`: no sort of the whole table, and the final merge is
    bounded by n rows per partition group.
    """
    key = F.md5(F.concat(F.lit(str(seed)), F.lit("-"), F.col(id_col).cast("string")))
    return top_n(df.withColumn("_h", key), n, [F.col("_h"), F.col(id_col)]).drop("_h")


def income_sample(clients: DataFrame, n: int = 800, seed: int = 42) -> DataFrame:
    """Age / income / status sample for a scatter plot (M6, X7, P3): edad, ingreso, status."""
    return seeded_sample(clients, n, seed).select(
        "edad",
        F.col("ingreso_mensual_mxn").alias("ingreso"),
        X.churn_status("UsuarioChurn").alias("status"),
    )


def split_by_status(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(CHURN rows, NO CHURN rows) of a labelled frame."""
    return (
        sample.filter(F.col("status") == F.lit(X.CHURN_LABEL)),
        sample.filter(F.col("status") == F.lit(X.NO_CHURN_LABEL)),
    )


def last_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per ``key``: the one with the largest ``order_col`` (J4, last wins).

    ``row_number() = 1`` plans as WindowGroupLimit (one row per key and map task
    before the shuffle).
    """
    w = Window.partitionBy(key).orderBy(F.col(order_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def lookup_states(map_names: DataFrame, states: DataFrame, order_col: str = "orden") -> DataFrame:
    """Exact-name lookup of map regions in state rows, last row per name wins.

    Output: every map row plus the matched state's clientes and churn_pct (null
    when the name is not found).
    """
    latest = last_per_key(states, "nombre", order_col).select("nombre", "clientes", "churn_pct")
    return map_names.join(latest, map_names["map_name"] == latest["nombre"], "left").drop("nombre")


def _substrings(name):
    """All substrings of a short name, the empty one too."""
    size = F.length(name)
    some = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size),
            lambda i: F.transform(F.sequence(i, size), lambda j: F.substring(name, i, j - i + F.lit(1))),
        )
    )
    none = F.array(F.lit(""))
    return F.when(size > 0, F.array_distinct(F.concat(none, some))).when(size == 0, none)


def region_match(map_names: DataFrame, states: DataFrame, order_col: str = "nombre") -> DataFrame:
    """Fuzzy match of map regions to state rows.

    A state row matches a map name (both lower-cased) when the state holds
    ``cdmx`` and the map name ``distrito`` or ``ciudad de``; when the state holds
    ``estado de méxico`` and the map name is exactly ``méxico`` (then it holds the
    map name); or when either name contains the other. The first matching state
    in ``order_col`` order wins; a map row without a name or a match keeps nulls.

    Each rule is an equality of keys: a state's substrings with the whole map name, the
    whole state name with the map name's substrings, one key for the capital. The first
    state of each key is found before the join, so a key has one row on that side and
    neither list has to be small; the names themselves are short.

    Output: map_order, map_name, nombre, clientes, churn_pct, nivel.
    """
    m, d = F.lower(F.col("map_name")), F.lower(F.col("nombre"))
    tagged = lambda tag, names: F.transform(names, lambda x: F.concat(F.lit(tag), x))
    alias = lambda hit: F.when(hit, F.array(F.lit("capital"))).otherwise(F.array().cast("array<string>"))
    state_keys = F.concat(
        tagged("held:", _substrings(d)), tagged("whole:", F.array(d)), alias(F.contains(d, F.lit(CAPITAL_DATA)))
    )
    map_keys = F.concat(
        tagged("held:", F.array(m)),
        tagged("whole:", _substrings(m)),
        alias(F.contains(m, F.lit(CAPITAL_MAP[0])) | F.contains(m, F.lit(CAPITAL_MAP[1]))),
    )
    order = F.col(order_col)
    row = F.struct(order.isNull().alias("last"), order.alias("ord"), "nombre", "clientes", "churn_pct")
    by_key = states.select(row.alias("state"), F.explode(state_keys).alias("key")).groupBy("key").agg(F.min("state").alias("state"))
    asked = map_names.select("map_order", "map_name", F.explode_outer(map_keys).alias("key"))
    first = asked.join(by_key, "key", "left").groupBy("map_order", "map_name").agg(F.min("state").alias("state"))
    return first.select(
        "map_order", "map_name", "state.nombre", "state.clientes", "state.churn_pct", X.shade_level("state.churn_pct").alias("nivel")
    )
