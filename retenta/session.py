"""Session helpers.

Operators never create or look up a session themselves: they take DataFrames and
return DataFrames. These helpers are for tests, the bench and the query catalogue.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "retenta",
) -> SparkSession:
    """Local session with the settings the library is tuned for.

    On a cluster the session comes from the launcher; there only the SQL settings
    below matter (AQE with partition coalescing and skew-join splitting).
    """
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    parts = shuffle_partitions or int(os.environ.get("RETENTA_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # coalesce shuffle partitions to the advisory size (64 MB) instead of keeping
        # one per core: fewer, fuller tasks, as recommended for shared clusters
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files of snapshots that are no longer referenced are deleted
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("RETENTA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when a local session leaves it unset (tests, bench) a fresh folder under the
    system temp directory is used; a cluster must name a shared one.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="retenta-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, how: str = "persist") -> DataFrame:
    """Reuse a computed table between calls (load once, reuse; S11).

    ``persist``: kept in executor memory/disk, rebuilt from lineage if an executor
    is lost. ``checkpoint``: written to the shared checkpoint folder, which cuts the
    lineage so a lost executor costs a re-read, not a recompute.
    """
    if how == "persist":
        return df.persist()
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    raise ValueError(f"unknown materialisation {how!r}")
