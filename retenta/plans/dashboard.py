"""Build the dashboard's tables once, then serve every screen from them.

:func:`build_tables` runs the rollup jobs and the scoring job and writes their
results as Parquet tables under one folder (on a cluster: shared storage). The
scored client table is the reusable base of search, paging and score cards;
writing it cuts the lineage, so later reads survive lost executors without a
recompute. :func:`open_tables` reads them back with the first-existing-path
resolver, so a missing table yields an empty frame or an error by policy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators import model, rollups, scoring
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources.readers import read_first_existing, read_upload_csv

# The table names the dashboard reads, with the schema used when a table is missing.
TABLES = {
    "scored_clients": None,
    "monthly_kpis": "mes date, monto_total double, num_inputs long, nuevos_churn long, num_transacciones long",
    "churn_label_counts": "UsuarioChurn string, count long",
    "top_inputs_by_month": "month date, input string, count long",
    "top_operations_by_month": "month date, tipo_operacion string, monto double",
    "product_usage": "producto string, usos long, clientes long, churn_pct double",
}


# The scored clients are stored by risk band: the high-risk screens filter on
# riesgo = 'Alto' and then read only that band's folder (partition pruning).
PARTITION_COLUMNS = {"scored_clients": "riesgo"}


def build_tables(spark: SparkSession, sf_dir: str, out_dir: str | None = None, top_k: int = 3) -> dict[str, str]:
    """Compute and write every dashboard table; returns name -> path.

    Without ``out_dir`` the tables go under ``<spark.checkpoint.dir>/dashboard``,
    the shared folder the cluster names for lineage cuts.
    """
    if out_dir is None:
        out_dir = f"{checkpoint_dir(spark).rstrip('/')}/dashboard"
    clients = fx.clients(spark, sf_dir)
    tx = fx.transactions(spark, sf_dir)
    outputs: dict[str, DataFrame] = {
        "scored_clients": scoring.churn_scores(clients, tx),
        "monthly_kpis": rollups.monthly_kpis(tx, fx.conversations(spark, sf_dir)),
        "churn_label_counts": rollups.churn_label_counts(clients),
        "top_inputs_by_month": rollups.top_inputs_by_month(fx.inputs(spark, sf_dir), top_k),
        "top_operations_by_month": rollups.top_operations_by_month(tx, top_k),
        "product_usage": rollups.product_usage(fx.products(spark, sf_dir), clients),
    }
    paths = {}
    for name, df in outputs.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        if name in PARTITION_COLUMNS:
            writer = writer.partitionBy(PARTITION_COLUMNS[name])
        writer.parquet(path)
        paths[name] = path
    return paths


def open_tables(
    spark: SparkSession, folders: Sequence[str], names: Sequence[str] | None = None, on_missing: str = "empty"
) -> dict[str, DataFrame | None]:
    """Each table from the first folder that has it (S2); a missing table follows ``on_missing`` (S3)."""
    out = {}
    for name in names or list(TABLES):
        schema = TABLES[name]
        policy = on_missing if (schema is not None or on_missing != "empty") else "none"
        out[name] = read_first_existing(
            spark, [f"{f.rstrip('/')}/{name}" for f in folders], on_missing=policy, empty_schema=schema
        )
    return out


def score_upload_file(spark: SparkSession, path: str, scorer: model.Scorer = model.rule_scorer) -> dict[str, DataFrame]:
    """A CSV upload scored into the batch report (S4, M1-M3): the upload endpoint as one call.

    The separator comes from the header line; missing features are imputed
    before scoring; the result holds the table, cities, summary and scatter frames.
    """
    return model.batch_report(read_upload_csv(spark, path), scorer)
