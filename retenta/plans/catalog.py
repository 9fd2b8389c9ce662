"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each entry reads the driver tables through :mod:`retenta.sources.fixtures`,
runs one library operator over the whole tables and projects comparable output
(timestamps as text, integer columns that can hold nulls as double, every
computed column aliased). The SQL twin of each entry
lives in :mod:`retenta.plans.oracle` under the same name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import actions, balances, features, incremental, kpis, lookup, model, monthly, page_index, rollups, scoring, segments, trees, trigrams
from ..sources import monthly_files, readers
from . import params as P
from ..session import checkpoint_dir, materialize
from ..sources import fixtures as fx
from ..streaming import monthly_rollup

TS_TEXT = "yyyy-MM-dd HH:mm:ss"
# Integer columns that can hold nulls are handed over as double: the pandas
# views of a Spark and a DuckDB result then agree (float with NaN on both sides).
NULLABLE_COUNTS = ["dias_desde_ultimo_login", "total_tx", "dias_sin_tx", "antiguedad_dias"]


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def nullable_counts_as_double(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in NULLABLE_COUNTS if c in df.columns})

SCORED_COLUMNS = [
    "user_id", "estado", "ciudad", "edad", "ingreso_mensual_mxn", "dias_desde_ultimo_login",
    "satisfaccion_1_10", "num_productos_activos", "es_hey_pro", "UsuarioChurn", "total_tx", "monto_total",
    "ultima_tx", "dias_sin_tx", "score_login", "score_satisfaccion", "score_productos", "score_tx",
    "churn_score", "riesgo",
]


def scored_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.churn_scores(fx.clients(spark, sf_dir), fx.transactions(spark, sf_dir))


def q_churn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored_clients(spark, sf_dir)
    return nullable_counts_as_double(df.withColumn("ultima_tx", F.date_format("ultima_tx", TS_TEXT)).select(*SCORED_COLUMNS))


def q_search_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.search_clients(scored_clients(spark, sf_dir), P.SEARCH_Q, P.SEARCH_LIMIT)


def scored_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored clients computed once and checkpointed to the shared checkpoint folder.

    A page and its total both read the snapshot, so the scoring pipeline runs
    once per page request instead of twice, and the lineage is cut.
    """
    return materialize(scored_clients(spark, sf_dir), "checkpoint")


def q_high_risk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nullable_counts_as_double(lookup.high_risk_page(scored_snapshot(spark, sf_dir), **P.HIGH_RISK_PAGE))


def q_high_risk_page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nullable_counts_as_double(lookup.high_risk_page(scored_snapshot(spark, sf_dir), **P.HIGH_RISK_PAGE_STATE))


def page_index_path(spark: SparkSession, sf_dir: str) -> str:
    """A page index of the scored clients, written to a new folder."""
    path = fresh_folder(spark, "pages")
    page_index.write_page_index(scored_clients(spark, sf_dir), path, P.PAGE_RANGES)
    return path


def page_from_index(spark: SparkSession, sf_dir: str, page: dict) -> DataFrame:
    """A page read by the index; a page without clients has nulls in all their columns, so
    ids, counts and flags are handed over as double."""
    out = nullable_counts_as_double(page_index.indexed_page(spark, page_index_path(spark, sf_dir), **page))
    return out.withColumns({c: F.col(c).cast("double") for c in ("user_id", "num_productos_activos", "es_hey_pro")})


def q_high_risk_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later page, read from the ranges that the index names (L2)."""
    return page_from_index(spark, sf_dir, P.DEEP_PAGE)


def q_high_risk_page_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page past the end of one state's clients: its totals, and no client (L2)."""
    return page_from_index(spark, sf_dir, P.PAST_END_PAGE)


def q_high_risk_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nullable_counts_as_double(lookup.high_risk_after(scored_clients(spark, sf_dir), **P.HIGH_RISK_AFTER))


def q_client_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.transaction_pages(fx.transactions(spark, sf_dir), **P.TX_PAGE_FIRST)


def q_client_transactions_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.transaction_pages(fx.transactions(spark, sf_dir), **P.TX_PAGE_SECOND)


def q_client_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.conversation_histories(fx.conversations(spark, sf_dir))


def q_score_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_card(scored_clients(spark, sf_dir))


def q_high_risk_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.high_risk_top(fx.clients(spark, sf_dir), fx.transactions(spark, sf_dir), k=P.HIGH_RISK_TOP_K)


def kpi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.monthly_kpis(fx.transactions(spark, sf_dir), fx.conversations(spark, sf_dir))


def q_monthly_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi_table(spark, sf_dir).withColumn("mes", F.date_format("mes", "yyyy-MM"))


def loaded_state(spark: SparkSession, sf_dir: str) -> str:
    """Transactions and conversations that come in three batches, the second without
    conversations, each loaded when it is there; the last load finds nothing new."""
    folder = fresh_folder(spark, "incremental")
    tx, conv = fx.transactions(spark, sf_dir), fx.conversations(spark, sf_dir)
    part = lambda df, n, i: df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == i)
    for i in range(3):
        part(tx, 3, i).write.mode("append").parquet(f"{folder}/tx")
        if i != 1:
            part(conv, 2, i // 2).write.mode("append").parquet(f"{folder}/conv")
        incremental.load_new(spark, f"{folder}/state", f"{folder}/tx", f"{folder}/conv")
    incremental.load_new(spark, f"{folder}/state", f"{folder}/tx", f"{folder}/conv")
    return f"{folder}/state"


def q_monthly_kpis_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly KPIs from the states of several loads."""
    return incremental.monthly_kpis(spark, loaded_state(spark, sf_dir)).withColumn("mes", F.date_format("mes", "yyyy-MM"))


def q_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.months(kpi_table(spark, sf_dir))


def month_kpis(spark: SparkSession, sf_dir: str, month: str) -> DataFrame:
    """The KPIs of a month, from the transactions and conversations that it needs."""
    tx, conv = fx.transactions(spark, sf_dir), fx.conversations(spark, sf_dir)
    return kpis.global_kpis(rollups.monthly_kpis(tx, conv, between=kpis.months_needed(month)), month)


def q_global_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return month_kpis(spark, sf_dir, P.GLOBAL_KPI_MONTH)


def q_global_kpis_first_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return month_kpis(spark, sf_dir, P.GLOBAL_KPI_FIRST_MONTH)


def q_kpi_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.kpi_changes(kpi_table(spark, sf_dir))


def q_churn_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.churn_timeline(kpi_table(spark, sf_dir).select("mes", "nuevos_churn"))


def q_churn_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.churn_label_counts(fx.clients(spark, sf_dir))


def q_churn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.churn_totals_from_counts(rollups.churn_label_counts(fx.clients(spark, sf_dir)))


def q_churn_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.churn_totals(fx.clients(spark, sf_dir))


def q_state_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.state_map(fx.clients(spark, sf_dir))


def q_age_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.age_profile(fx.clients(spark, sf_dir))


def usage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.product_usage(fx.products(spark, sf_dir), fx.clients(spark, sf_dir))


def q_product_usage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_table(spark, sf_dir)


def q_product_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.top_products(usage_table(spark, sf_dir).select("producto", "usos", "churn_pct"), P.TOP_PRODUCTS)


def q_income_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.income_sample(fx.clients(spark, sf_dir), P.SAMPLE_ROWS, P.SAMPLE_SEED)


def q_region_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = segments.state_map(fx.clients(spark, sf_dir))
    return segments.region_match(fx.region_names(spark, sf_dir), states)


def q_state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = segments.state_map(fx.clients(spark, sf_dir))
    layer = fx.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("map_order"), F.col("n_name").alias("map_name")
    )
    return segments.lookup_states(layer, states, order_col="clientes")


def q_top_inputs_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollups.top_inputs_by_month(fx.inputs(spark, sf_dir), P.TOP_PER_MONTH)
    return out.withColumn("month", F.date_format("month", "yyyy-MM"))


def q_top_operations_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollups.top_operations_by_month(fx.transactions(spark, sf_dir), P.TOP_PER_MONTH)
    return out.withColumn("month", F.date_format("month", "yyyy-MM"))


def q_inputs_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = rollups.top_inputs_by_month(fx.inputs(spark, sf_dir), P.TOP_PER_MONTH)
    return monthly.inputs_pivot(top, P.INPUT_VALUES)


def q_operations_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = rollups.top_operations_by_month(fx.transactions(spark, sf_dir), P.TOP_PER_MONTH)
    return monthly.operations_pivot(top, P.OPERATION_VALUES)


def high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.high_risk_list(fx.clients(spark, sf_dir), fx.transactions(spark, sf_dir))


def q_retention_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.retention_actions(high_risk(spark, sf_dir))


def q_action_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.action_messages(actions.retention_actions(high_risk(spark, sf_dir)))


def q_high_risk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.substring_filter(high_risk(spark, sf_dir), P.HIGH_RISK_SEARCH_TERM)
    return found.orderBy(F.col("churn_score").desc(), F.col("user_id").asc()).limit(P.HIGH_RISK_SEARCH_ROWS)


def search_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Clients, and the trigrams of their ids and cities in a new folder."""
    clients = fx.clients(spark, sf_dir, product_counts=False).select("user_id", "estado", "ciudad", "edad")
    path = fresh_folder(spark, "trigrams")
    trigrams.write_trigrams(clients, path, "user_id", ["user_id", "ciudad"])
    return clients, path


def q_client_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clients whose id or city holds a text, found by its trigrams."""
    clients, path = search_index(spark, sf_dir)
    return trigrams.search(clients, path, P.INDEXED_SEARCH_TERM, "user_id", ["user_id", "ciudad"])


def q_client_regex_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clients whose city matches an expression, found by its literal parts (P5)."""
    clients, path = search_index(spark, sf_dir)
    return trigrams.search(clients, path, P.INDEXED_SEARCH_REGEX, "user_id", ["ciudad"], regex=True)


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_table(*fx.feature_sources(spark, sf_dir))


def q_monthly_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every client's balance month by month (F6's mean balance, split at month ends)."""
    _, moves, _, _ = fx.feature_sources(spark, sf_dir)
    return balances.monthly_balances(moves)


def q_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nullable_counts_as_double(customer_features(spark, sf_dir))


def q_aligned_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nullable_counts_as_double(model.align_features(customer_features(spark, sf_dir), keep=["user_id"]))


def scored_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.scored_upload(customer_features(spark, sf_dir), model.rule_scorer)


def q_batch_report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.report_table(scored_upload(spark, sf_dir), P.REPORT_TOP_ROWS)


def q_batch_report_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.report_cities(scored_upload(spark, sf_dir), P.REPORT_TOP_CITIES)


def q_batch_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.report_summary(scored_upload(spark, sf_dir))


def q_batch_report_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.report_scatter(scored_upload(spark, sf_dir))


def q_churn_model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every client scored by the stored model, compiled to expressions (M2): probability,
    whole percent and class."""
    table = customer_features(spark, sf_dir)
    scored = trees.scorer(trees.stored())(table)
    return scored.select(
        "user_id",
        F.round("proba", 9).alias("probabilidad"),
        X.truncated_percent("proba").alias("prob_churn"),
        X.predicted_class("proba").alias("pred_churn"),
    )


def trained(spark: SparkSession, sf_dir: str, numbers_only: bool = False) -> tuple:
    """(feature table, model, its features, AUC on the held-out clients).

    The feature table is checkpointed once; training, evaluation and scoring read it.
    ``dias_sin_tx`` is no feature: the label is made of the days since the last order. With
    ``numbers_only`` the fitted trees can be written as expressions.
    """
    table = materialize(customer_features(spark, sf_dir), "checkpoint")
    feats = model.table_features(table, exclude=["user_id", "UsuarioChurn", "dias_sin_tx"])
    feats = model.numeric_features(feats) if numbers_only else feats
    fitted, feats = model.train_churn_model(table.filter(~model.held_out()), feats, max_iter=P.MODEL_ITERATIONS)
    return table, fitted, feats, model.evaluate_auc(fitted, table.filter(model.held_out()), feats)


def q_churn_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and held-out clients and churners, how many rows were scored, and whether
    the model ranks held-out clients better than chance (F7, M2)."""
    table, fitted, feats, auc = trained(spark, sf_dir)
    scored = model.ml_scorer(fitted, feats)(table)
    return (
        scored.groupBy(F.when(model.held_out(), "prueba").otherwise("entrenamiento").alias("conjunto"))
        .agg(
            F.count(F.lit(1)).alias("clientes"),
            F.sum(X.is_churn("UsuarioChurn").cast("long")).alias("churn"),
            F.count(F.when(F.col("proba").between(0, 1), 1)).alias("con_probabilidad"),
        )
        .withColumn("mejor_que_azar", F.lit(auc > P.MODEL_AUC_FLOOR))
    )


def q_score_card_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One client's score card."""
    return scoring.score_card_for(scored_clients(spark, sf_dir), P.CLIENT_ID)


def q_one_client_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of one client's transactions."""
    return lookup.client_transactions(fx.transactions(spark, sf_dir), P.CLIENT_ID, **P.CLIENT_TX_PAGE)


def q_one_client_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations of one client."""
    return lookup.client_conversations(fx.conversations(spark, sf_dir), P.CLIENT_ID)


def q_income_sample_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scatter sample's two series, with the series' name."""
    churn, rest = segments.split_by_status(q_income_sample(spark, sf_dir))
    return churn.withColumn("serie", F.lit("churn")).unionByName(rest.withColumn("serie", F.lit("no churn")))


def q_upload_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report over an uploaded file (S4, M1, M3, X20): the clients are written as CSV with
    ``;`` and without a city to the shared folder, read back and scored."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/upload-{uuid.uuid4().hex}"
    fx.clients(spark, sf_dir).drop("ciudad").write.option("header", True).option("sep", ";").csv(path)
    return model.scored_upload(readers.read_upload_csv(spark, path), model.rule_scorer)


def q_upload_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report over an uploaded file whose rows have no ids (S4, M3, X19): the clients in
    the order of their ids, written as CSV without them. Rows are named ``N-`` and their
    place in the file."""
    path = fresh_folder(spark, "upload-without-ids")
    clients = fx.clients(spark, sf_dir)
    clients.orderBy("user_id").drop("user_id").write.option("header", True).csv(path)
    return model.scored_upload(readers.read_upload_csv(spark, path), model.rule_scorer)


KPI_FILE = "mes string, monto_total double, num_transacciones long, num_inputs long, nuevos_churn long"


def kpi_file(spark: SparkSession, sf_dir: str) -> monthly_files.MonthlyFile:
    """The transactions' days as a KPI file (day as month stamp, amount, counts) with names in
    capitals, read back; of the days every 7th has a month that does not parse and every
    11th an amount that is no number."""
    path, day = fresh_folder(spark, "kpi-file"), F.to_date("fecha_hora")
    days = fx.transactions(spark, sf_dir).groupBy(day.alias("d")).agg(F.count("monto").alias("n"), F.sum(F.col("monto").cast("decimal(18,2)")).alias("m"))
    number = F.datediff("d", F.lit("1995-01-01").cast("date"))
    rows = days.select(
        F.when(number % 7 == 0, F.concat(F.lit("sin fecha "), F.col("d").cast("string"))).otherwise(F.date_format("d", "yyyy-MM-dd")).alias("MES"),
        F.when(number % 11 == 0, F.lit("n/d")).otherwise(F.col("m").cast("string")).alias("MONTO_TOTAL"),
        F.col("n").alias("NUM_TRANSACCIONES"),
        F.lit(0).alias("NUM_INPUTS"),
        (F.col("n") % 5).alias("NUEVOS_CHURN"),
    )
    rows.write.option("header", True).option("sep", ";").csv(path)
    return monthly_files.read_monthly_csv(spark, path, KPI_FILE, fresh_folder(spark, "kpi-read"))


def q_kpi_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of a KPI file are valid, have no month, or are no records."""
    return kpi_file(spark, sf_dir).report()


def q_kpi_file_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of the file's valid rows, with their sums and the names in lower case."""
    valid = kpi_file(spark, sf_dir).valid
    return valid.groupBy(F.date_format("mes", "yyyy-MM").alias("mes")).agg(
        F.sum(F.col("monto_total").cast("decimal(18,2)")).cast("double").alias("monto_total"),
        F.sum("num_transacciones").alias("num_transacciones"),
        F.sum("nuevos_churn").alias("nuevos_churn"),
    )


def q_written_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients written as records, found again as the first existing of two paths
    (S2, S3, S10)."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/clients-{uuid.uuid4().hex}"
    readers.write_records(fx.clients(spark, sf_dir), f"{base}/new")
    return nullable_counts_as_double(readers.read_first_existing(spark, [f"{base}/old", f"{base}/new"]))


def q_monthly_rollup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming monthly rollup over the whole transaction and conversation tables.

    The derived tables are written as the stream's source files into a fresh
    folder under the shared checkpoint folder, drained with an available-now
    trigger, and the current per-month totals are read back.
    """
    base = f"{checkpoint_dir(spark).rstrip('/')}/monthly-rollup-{uuid.uuid4().hex}"
    fx.transactions(spark, sf_dir).write.parquet(f"{base}/transactions")
    fx.conversations(spark, sf_dir).select("user_id", "date", "input").write.parquet(f"{base}/conversations")
    monthly_rollup.start_monthly_rollup(
        spark, f"{base}/transactions", f"{base}/totals", f"{base}/state", conversations_dir=f"{base}/conversations"
    ).awaitTermination()
    return monthly_rollup.current_totals(spark, f"{base}/totals").withColumn("mes", F.date_format("mes", "yyyy-MM"))


def q_kpi_unparseable_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many KPI rows have a month that does not parse (S6's report)."""
    return readers.count_unparseable(kpi_table(spark, sf_dir), "mes")


def q_top_conversation_inputs_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-3 conversation inputs per month over the conversation table itself (F2)."""
    conv = fx.conversations(spark, sf_dir).select(F.col("date").alias("fecha"), "input")
    out = rollups.top_inputs_by_month(conv, P.TOP_PER_MONTH)
    return out.withColumn("month", F.date_format("month", "yyyy-MM"))


def q_conversation_inputs_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month × conversation input over the top-3 inputs of the conversation table."""
    conv = fx.conversations(spark, sf_dir).select(F.col("date").alias("fecha"), "input")
    top = rollups.top_inputs_by_month(conv, P.TOP_PER_MONTH)
    return monthly.inputs_pivot(top, P.CONVERSATION_INPUT_VALUES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "churn_scores": q_churn_scores,
    "search_clients": q_search_clients,
    "high_risk_page": q_high_risk_page,
    "high_risk_page_state": q_high_risk_page_state,
    "high_risk_deep_page": q_high_risk_deep_page,
    "high_risk_page_past_end": q_high_risk_page_past_end,
    "high_risk_after": q_high_risk_after,
    "client_transactions": q_client_transactions,
    "client_transactions_page2": q_client_transactions_page2,
    "client_conversations": q_client_conversations,
    "score_card": q_score_card,
    "high_risk_top": q_high_risk_top,
    "monthly_kpis": q_monthly_kpis,
    "monthly_kpis_incremental": q_monthly_kpis_incremental,
    "months": q_months,
    "global_kpis": q_global_kpis,
    "global_kpis_first_month": q_global_kpis_first_month,
    "kpi_changes": q_kpi_changes,
    "churn_timeline": q_churn_timeline,
    "kpi_unparseable_months": q_kpi_unparseable_months,
    "churn_label_counts": q_churn_label_counts,
    "churn_counts": q_churn_counts,
    "churn_totals": q_churn_totals,
    "state_map": q_state_map,
    "age_profile": q_age_profile,
    "product_usage_table": q_product_usage_table,
    "product_usage": q_product_usage,
    "income_sample": q_income_sample,
    "region_match": q_region_match,
    "state_lookup": q_state_lookup,
    "top_inputs_by_month": q_top_inputs_by_month,
    "top_conversation_inputs_by_month": q_top_conversation_inputs_by_month,
    "top_operations_by_month": q_top_operations_by_month,
    "inputs_pivot": q_inputs_pivot,
    "conversation_inputs_pivot": q_conversation_inputs_pivot,
    "operations_pivot": q_operations_pivot,
    "retention_actions": q_retention_actions,
    "action_messages": q_action_messages,
    "high_risk_search": q_high_risk_search,
    "client_search_indexed": q_client_search_indexed,
    "client_regex_indexed": q_client_regex_indexed,
    "feature_table": q_feature_table,
    "monthly_balances": q_monthly_balances,
    "aligned_upload": q_aligned_upload,
    "batch_report_table": q_batch_report_table,
    "batch_report_cities": q_batch_report_cities,
    "batch_report_summary": q_batch_report_summary,
    "batch_report_scatter": q_batch_report_scatter,
    "churn_model_predictions": q_churn_model_predictions,
    "churn_model_summary": q_churn_model_summary,
    "score_card_client": q_score_card_client,
    "one_client_transactions": q_one_client_transactions,
    "one_client_conversations": q_one_client_conversations,
    "income_sample_split": q_income_sample_split,
    "upload_report": q_upload_report,
    "upload_without_ids": q_upload_without_ids,
    "kpi_file_report": q_kpi_file_report,
    "kpi_file_months": q_kpi_file_months,
    "written_clients": q_written_clients,
    "monthly_rollup_stream": q_monthly_rollup_stream,
}
