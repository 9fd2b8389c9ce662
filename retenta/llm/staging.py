"""Shared intermediate tables and small frame helpers of the subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: the white space of every contract: space and the ASCII controls 9 to 13
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where the session names none, a local master (tests) gets a temporary folder; a
    cluster must name one, since its executors share no local disk.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="retenta-llm-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so that a
    lost executor costs a re-read. The folder's owner expires old tables."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def attach(rows: DataFrame, facts: DataFrame, key: str, salt_on: Column, salts: int = 16) -> DataFrame:
    """Left join of ``rows`` with ``facts`` (one row a key, never a null key), for keys
    that may hold a third of all rows: a key's rows are dealt over ``salts`` tasks by
    ``salt_on``, and its one fact is repeated for each salt."""
    salted = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    return dealt.join(salted, [key, "__salt"], "left").drop("__salt")
