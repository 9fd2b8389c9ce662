"""Pages at any depth by an order-statistics index (L2).

The scored clients of a band are written once in page order, cut into ranges of score and
id, one folder each, with a small index beside them: how many clients each range holds by
state and score. A page is looked up in the index: the counts of the ranges before it say
in which range it starts, so page 100,000 reads one range (two at a border) like page 1,
and the totals come from the index alone, also for a page past the end or without a match.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookup import PAGE_COLUMNS, check_page, high_risk_filter, present

#: clients that a range is meant to hold, and the most ranges there may be, which bounds the
#: rows that reach the driver for a page
RANGE_ROWS = 50_000
MAX_RANGES = 4096


def write_page_index(scored: DataFrame, path: str, ranges: int | None = None) -> None:
    """Write the high-risk clients of ``scored`` under ``path`` in page order (score
    descending, then id), with the index of their ranges."""
    clients = high_risk_filter(scored)
    if ranges is None:
        ranges = ceil(clients.count() / RANGE_ROWS)
    ranges = max(1, min(MAX_RANGES, ranges))
    order = [F.col("churn_score").desc(), F.col("user_id").asc()]
    # the number is given, so that no two ranges are joined into one at run time
    ranged = clients.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ranged.withColumn("rango", F.spark_partition_id()).write.partitionBy("rango").parquet(f"{path}/clients")
    spark = scored.sparkSession
    clients.limit(0).write.parquet(f"{path}/columns")  # the columns, where no client is stored too
    counts = _stored(spark, path).groupBy("rango", F.lower("estado").alias("estado"), "churn_score")
    counts.agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/index")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema.add("rango", "integer")
    return spark.read.schema(columns).parquet(f"{path}/clients")


def indexed_page(
    spark: SparkSession,
    path: str,
    page: int = 1,
    page_size: int = 15,
    estado: str | None = None,
    score_min: float = 0.0,
    score_max: float = 100.0,
) -> DataFrame:
    """One page of the clients under ``path`` with total, page, page_size and pages. A page
    without clients is one row with the totals and null client columns."""
    check_page(page, page_size)
    index = spark.read.parquet(f"{path}/index").filter(F.col("churn_score").between(float(score_min), float(score_max)))
    if estado:
        index = index.filter(F.col("estado") == F.lit(estado.lower()))
    counts = index.groupBy("rango").agg(F.sum("n").alias("n")).orderBy("rango").collect()  # MAX_RANGES rows at most
    first, last = (page - 1) * page_size, page * page_size
    needed, before, total = [], 0, 0
    for r in counts:
        if total < last and total + r["n"] > first:
            before = before if needed else total
            needed.append(r["rango"])
        total += r["n"]
    # the band is that of the whole table; naming the ranges prunes the other folders
    stored = _stored(spark, path)
    found = high_risk_filter(stored.filter(F.col("rango").isin(needed) if needed else F.lit(False)), estado, score_min, score_max)
    order = [F.col("churn_score").desc(), F.col("user_id").asc()]
    rows = found.orderBy(*order).offset(max(0, first - before)).limit(page_size).select(*present(stored, PAGE_COLUMNS), F.lit(page).alias("page"))
    meta = spark.range(1).select(
        F.lit(total).cast("long").alias("total"),
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        F.lit(ceil(total / page_size)).cast("long").alias("pages"),
    )
    return meta.join(rows, "page", "left").select(*present(stored, PAGE_COLUMNS), "total", "page", "page_size", "pages")
