"""Incremental monthly rollup (the stream-able part of F1) with Structured Streaming.

Transaction files (and, optionally, conversation files) that land in folders
are folded into running per-month totals: amount in cents, transaction count,
conversation count. New churn depends on the last date of the whole table, so
it stays a batch job (:func:`retenta.operators.rollups.monthly_kpis`).

The aggregation state lives in the streaming state store under the checkpoint
location, so a restarted query resumes where it stopped. The state holds one
row per calendar month, so it stays small without a watermark; a watermark
would drop rows that arrive late, and the totals must keep every row. Calendar months cannot be expressed as a streaming time window, so
the query runs in update mode and ``foreachBatch`` appends the months a batch
changed, tagged with the batch id, to a versions table. A replayed batch writes
identical rows under the same id, so readers stay correct (exactly-once
results from an at-least-once sink). :func:`current_totals` keeps the newest
version of each month.

The checkpoint and output folders must be shared storage on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import expr as X

TRANSACTION_SCHEMA = "user_id long, monto double, fecha_hora timestamp_ntz, tipo_operacion string"
CONVERSATION_SCHEMA = "user_id long, date timestamp_ntz, input string"


def monthly_totals_stream(
    spark: SparkSession,
    source_dir: str,
    conversations_dir: str | None = None,
    schema: str = TRANSACTION_SCHEMA,
    conversation_schema: str = CONVERSATION_SCHEMA,
    max_files: int = 100,
) -> DataFrame:
    """Streaming frame of running per-month totals: mes, monto_cents, num_transacciones, num_inputs.

    Both streams are projected to (mes, cents, is_tx, is_input) and unioned, so
    one stateful aggregation keyed by month serves both.
    """
    tx = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    rows = tx.select(
        X.month_start("fecha_hora").alias("mes"),
        F.round(F.col("monto") * F.lit(100.0)).cast("long").alias("cents"),
        F.lit(1).alias("is_tx"),
        F.lit(0).alias("is_input"),
    )
    if conversations_dir:
        conv = spark.readStream.schema(conversation_schema).option("maxFilesPerTrigger", max_files).parquet(
            conversations_dir
        )
        rows = rows.unionByName(
            conv.select(
                X.month_start("date").alias("mes"),
                F.lit(None).cast("long").alias("cents"),
                F.lit(0).alias("is_tx"),
                F.lit(1).alias("is_input"),
            )
        )
    return rows.groupBy("mes").agg(
        F.sum("cents").alias("monto_cents"),
        F.sum("is_tx").cast("long").alias("num_transacciones"),
        F.sum("is_input").cast("long").alias("num_inputs"),
    )


def start_monthly_rollup(
    spark: SparkSession,
    source_dir: str,
    output_dir: str,
    checkpoint_dir: str,
    available_now: bool = True,
    processing_time: str | None = None,
    conversations_dir: str | None = None,
) -> StreamingQuery:
    """Start the rollup; each micro-batch appends its changed months to ``output_dir``."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(output_dir)

    writer = (
        monthly_totals_stream(spark, source_dir, conversations_dir)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint_dir)
        .foreachBatch(write_batch)
    )
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_totals(spark: SparkSession, output_dir: str) -> DataFrame:
    """Newest version of each month: mes, monto_total, num_transacciones, num_inputs.

    ``row_number() = 1`` per month plans as a map-side group limit.
    """
    versions = spark.read.parquet(output_dir)
    w = Window.partitionBy("mes").orderBy(F.col("batch_id").desc())
    latest = versions.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    return latest.select(
        "mes",
        F.coalesce(F.col("monto_cents").cast("double") / F.lit(100.0), F.lit(0.0)).alias("monto_total"),
        "num_transacciones",
        "num_inputs",
    )
