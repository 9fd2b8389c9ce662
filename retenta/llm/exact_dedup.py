"""Exact de-duplication with a persistent digest index.

The index is a table of one row for each digest, bucketed and sorted by the digest. A new
batch is reduced to one row for each digest (partial sums before the shuffle), anti-joined
with the index by a sort-merge join that reads the index's buckets as they lie, and the
digests the index lacks are appended. Built from DataFrame operations only.

An index lives in the shared folder under its table's name, with the number of its buckets
beside it, so a session that never saw it finds it there and goes on with it.

Texts are equal when they are identical after each run of white space became one space; a
null text counts as empty. Of equal texts in a batch the row of the smallest id stays
(null ids last); of rows that agree in both, the one that was read first. A digest that an
earlier batch brought keeps that batch's row, and all its later copies go. An empty batch
appends nothing. Ids may be of any type that can be ordered, the same in each batch. Other
columns of the batch, whatever their names, are not looked at.
"""

from __future__ import annotations

import uuid
from functools import reduce
from math import ceil, log2

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retenta.llm.staging import SPACE, attach, shared_root, staged, text_of

#: least number of buckets, digests that a bucket is meant to hold (some 128 MB), and how many
#: times the first batch an index is laid out for
BUCKETS = 16
BUCKET_ROWS = 4_000_000
ROOM = 4


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), SPACE, " ")


def digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A digest index under a table name. ``buckets`` is fixed by the first batch: as given,
    or by the batch's size."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.path = f"{shared_root(spark)}/{self.table}"

    def _layout(self) -> tuple[int, str] | None:
        """(buckets, type of the ids) of an index that an earlier session left in the folder."""
        try:
            found = self.spark.read.schema("buckets int, id_type string").json(f"{self.path}.layout").first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return (found["buckets"], found["id_type"]) if found else None

    def exists(self) -> bool:
        """Whether there is an index; one that this session's catalog lacks is registered."""
        if self.spark.catalog.tableExists(self.table):
            return True
        if (layout := self._layout()) is None:
            return False
        self._register(*layout)
        return True

    def _register(self, buckets: int, id_type: str) -> None:
        self.spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id {id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _create(self, entries: DataFrame) -> None:
        n = entries.count() if self.buckets is None else 0
        wanted = max(1, ROOM * n / BUCKET_ROWS)
        self.buckets = self.buckets or max(BUCKETS, 2 ** ceil(log2(wanted)))
        id_type = entries.schema["keep_id"].dataType.simpleString()
        about = self.spark.createDataFrame([(self.buckets, id_type)], "buckets int, id_type string")
        about.coalesce(1).write.json(f"{self.path}.layout")
        self._register(self.buckets, id_type)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """Add rows to the table as it is laid out."""
        buckets = int(next(r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED {self.table}").collect() if r["col_name"] == "Num Buckets"))
        rows.write.format("parquet").bucketBy(buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)

    def forget(self) -> None:
        """Take the table out of this session's catalog; the index itself stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", batches: int = 1) -> DataFrame:
        """De-duplicate a batch against the index and itself, append what is new.

        Returns a row for each row of the batch: ``id_col``, digest, keep_id (the id of the
        row that stays), group_size (rows of the batch with the digest) and kept. With
        ``batches`` the rows are added in so many parts, dealt by digest, so that equal texts
        meet in one part and nothing changes but the size of a step.
        """
        rows = staged(
            docs.select(F.col(f"`{id_col}`").alias("id"), digest(text).alias("digest")).withColumn("row", F.monotonically_increasing_id()),
            "digests",
        )
        part = F.pmod(F.xxhash64("digest"), F.lit(batches))
        decided = [self._add(rows.filter(part == i) if batches > 1 else rows, id_col) for i in range(batches)]
        return reduce(DataFrame.unionByName, decided)

    def _add(self, rows: DataFrame, id_col: str) -> DataFrame:
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row")))
        groups = staged(rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
        entries = groups.select("digest", F.col("first.id").alias("keep_id"))
        if not self.exists():
            self._create(entries)
        known = self.read().select("digest").hint("merge")
        fresh = staged(entries.join(known, "digest", "left_anti").withColumn("fresh", F.lit(True)), "digest-fresh")
        self.append(fresh.select("digest", "keep_id"))
        marks = fresh.select("digest", "fresh")
        index = self.read().select("digest", "keep_id").hint("merge")
        facts = groups.join(marks, "digest", "left").join(index, "digest").select(
            "digest", "keep_id", "group_size", F.when(F.col("fresh"), F.col("first.row")).alias("keep_row")
        )
        # a row alone in its group and new to the index needs no fact: most rows
        shared = facts.filter((F.col("group_size") > 1) | F.col("keep_row").isNull()).withColumn("found", F.lit(True))
        out = attach(rows, shared, "digest", F.col("row"))
        return out.select(
            F.col("id").alias(id_col),
            "digest",
            F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.when(F.col("found"), F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))).otherwise(F.lit(True)).alias("kept"),
        )


def kept_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``DigestIndex.add`` kept, with their own columns. Of rows that
    agree in id and digest one stays, that of the smallest hash of all columns."""
    columns = docs.columns
    named = lambda: F.concat(F.when(F.col(f"`{id_col}`").isNull(), "n").otherwise("v"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    keys = decisions.filter("kept").select(named().alias("__id"), F.col("digest").alias("__digest"))
    marked = docs.withColumns({"__digest": digest(text), "__id": named(), "__row": F.xxhash64(*[F.col(f"`{c}`") for c in columns])})
    place = F.row_number().over(W.partitionBy("__digest", "__id").orderBy("__row"))
    return marked.join(keys, ["__digest", "__id"]).withColumn("__place", place).filter("__place = 1").select(*[F.col(f"`{c}`") for c in columns])
