"""Load once, then only what is new.

The monthly KPIs and the clients' summaries are sums, counts and maxima, so what a batch of
new files adds can be kept as a small table of its own and merged when read. A state folder
holds, for each batch, the files it read (the manifest), and its share of the months and of
the clients. A load lists the sources, leaves out the files of the manifest, aggregates the
others and writes their share; the manifest entry comes last and makes it count. A load
that broke off before is repeated under the same number and overwrites what it left, and a
load without new files does nothing, so no row counts twice or is missed. Files are taken
as whole and unchanging, as Parquet folders are appended to. One load runs at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from .rollups import CHURN_AFTER_DAYS, new_churn_by_month

MANIFEST = "batch int, kind string, file string"
MONTHS = "mes date, monto decimal(38,2), num_transacciones long, num_inputs long, ultima timestamp_ntz, batch int"
CLIENTS = "user_id {id}, total_tx long, monto decimal(38,2), ultima_tx timestamp_ntz, batch int"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def manifest(spark: SparkSession, state: str) -> DataFrame:
    """(batch, kind, file) of every file that counts."""
    return _read(spark, f"{state}/manifest", MANIFEST)


def _new_files(spark: SparkSession, state: str, kind: str, source: str) -> DataFrame:
    """(file) under ``source`` that no batch has read; the files' data are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(source)
    known = manifest(spark, state).filter(F.col("kind") == kind).select("file")
    return listed.select(F.col("path").alias("file")).join(known, "file", "left_anti")


def load_new(spark: SparkSession, state: str, transactions: str, conversations: str) -> int:
    """Add the files that came to the folders ``transactions`` (user_id, monto, fecha_hora) and
    ``conversations`` (date) since the last load. Returns the number of new files."""
    found = {kind: [r["file"] for r in _new_files(spark, state, kind, path).collect()] for kind, path in (("tx", transactions), ("conv", conversations))}
    if not any(found.values()):
        return 0
    batch = (manifest(spark, state).agg(F.max("batch")).first()[0] or 0) + 1
    amount = F.sum(F.col("monto").cast("decimal(18,2)")).cast("decimal(38,2)").alias("monto")
    months = []
    if found["tx"]:
        tx = spark.read.parquet(*found["tx"])
        months.append(tx.groupBy(X.month_start("fecha_hora").alias("mes")).agg(amount, F.count(F.lit(1)).alias("num_transacciones"), F.max("fecha_hora").cast("timestamp_ntz").alias("ultima")))
        clients = tx.filter(F.col("user_id").isNotNull()).groupBy("user_id")
        share = clients.agg(F.count("monto").alias("total_tx"), amount, F.max("fecha_hora").cast("timestamp_ntz").alias("ultima_tx"))
        share.write.mode("overwrite").parquet(f"{state}/clients/batch={batch}")
    if found["conv"]:
        conv = spark.read.parquet(*found["conv"])
        months.append(conv.groupBy(X.month_start("date").alias("mes")).agg(F.count(F.lit(1)).alias("num_inputs")))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), months)
    stacked.write.mode("overwrite").parquet(f"{state}/months/batch={batch}")
    rows = [(batch, kind, file) for kind, files in found.items() for file in files]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{state}/manifest")
    return len(rows)


def _counted(spark: SparkSession, state: str, name: str, schema: str) -> DataFrame:
    """The shares of the batches of the manifest; what a broken load left is not among them."""
    batches = manifest(spark, state).select("batch").distinct()
    return _read(spark, f"{state}/{name}", schema).join(batches, "batch", "left_semi")


def client_summary(spark: SparkSession, state: str, id_type: str = "long") -> DataFrame:
    """Per client: total_tx, monto_total, ultima_tx over all loads."""
    parts = _counted(spark, state, "clients", CLIENTS.format(id=id_type)).groupBy("user_id")
    return parts.agg(F.sum("total_tx").alias("total_tx"), F.coalesce(F.sum("monto").cast("double"), F.lit(0.0)).alias("monto_total"), F.max("ultima_tx").alias("ultima_tx"))


def monthly_kpis(spark: SparkSession, state: str, id_type: str = "long", churn_after_days: int = CHURN_AFTER_DAYS) -> DataFrame:
    """The monthly KPI table over all loads, equal to ``rollups.monthly_kpis`` over all rows."""
    months = _counted(spark, state, "months", MONTHS)
    sums = months.select("mes", "monto", "num_transacciones", "num_inputs")
    latest = client_summary(spark, state, id_type).select("user_id", "ultima_tx")
    churned = new_churn_by_month(latest, months.agg(F.max("ultima")).scalar(), churn_after_days)
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    amount = F.coalesce(F.sum("monto").cast("double"), F.lit(0.0)).alias("monto_total")
    return sums.unionByName(churned, allowMissingColumns=True).groupBy("mes").agg(amount, whole("num_inputs"), whole("nuevos_churn"), whole("num_transacciones"))
