"""Month-keyed CSV files with their report in the same pass.

Lines that are no records (a number that isn't one, too many fields) and records whose month
does not parse are kept apart, not lost: the file is read once, each row gets its state, the
counts are observed while the rows are written, and each state has a folder of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import detect_separator, lower_columns

CORRUPT = "_linea"
VALID, BAD_MONTH, BAD_LINE = "valida", "mes_invalido", "linea_corrupta"


@dataclass(frozen=True)
class MonthlyFile:
    """``valid``: the rows whose month parses, it being a timestamp. ``bad_months``: the other
    records, as they were read. ``bad_lines``: the lines that are no records. ``counts``:
    rows read and rows of each state."""

    valid: DataFrame
    bad_months: DataFrame
    bad_lines: DataFrame
    counts: dict[str, int]

    def report(self) -> DataFrame:
        """One row a state: estado, filas."""
        spark = self.valid.sparkSession
        return spark.createDataFrame(sorted(self.counts.items()), "estado string, filas long")


def read_monthly_csv(spark: SparkSession, path: str, schema: str, out: str, month: str = "mes") -> MonthlyFile:
    """Read CSV files with a header into ``out`` (new). ``schema`` is a DDL string whose month
    column is text; names are taken in lower case whatever the files' are (S7)."""
    first = spark.read.text(path).limit(1).collect()
    fields = T.StructType.fromDDL(schema).add(CORRUPT, T.StringType())
    reader = spark.read.schema(fields).option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", CORRUPT)
    lines = lower_columns(reader.option("sep", detect_separator(first[0][0] if first else None)).csv(path))
    month, corrupt = month.lower(), CORRUPT.lower()
    parsed = F.try_to_timestamp(F.col(month)).cast("timestamp_ntz")
    state = F.when(F.col(corrupt).isNotNull(), BAD_LINE).when(parsed.isNull(), BAD_MONTH).otherwise(VALID)
    rows = lines.withColumns({"_mes": parsed, "_estado": state})
    seen = Observation("monthly_csv")
    counted = [F.count(F.when(F.col("_estado") == s, 1)).alias(s) for s in (VALID, BAD_MONTH, BAD_LINE)]
    rows.observe(seen, F.count(F.lit(1)).alias("leidas"), *counted).write.partitionBy("_estado").parquet(out)
    counts = {k: int(v) for k, v in seen.get.items()}
    stored = spark.read.schema(T.StructType([*rows.schema.fields])).parquet(out)
    names = [c for c in lines.columns if c != corrupt]
    of = lambda s: stored.filter(F.col("_estado") == s)  # noqa: E731  its folder only
    valid = of(VALID).select(*[F.col("_mes").alias(month) if c == month else F.col(c) for c in names])
    return MonthlyFile(valid, of(BAD_MONTH).select(*names), of(BAD_LINE).select(F.col(corrupt).alias("linea")), counts)
