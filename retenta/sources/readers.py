"""Readers, resolvers and writers.

All readers are lazy: they return a DataFrame whose scan Catalyst prunes to the
columns and rows a query needs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceMissing(RuntimeError):
    """No candidate path exists (the policy asked for an error)."""


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table, optionally projected to ``columns``."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def _try_read(spark: SparkSession, path: str, fmt: str, options: dict | None) -> DataFrame | None:
    try:
        return spark.read.format(fmt).options(**(options or {})).load(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return None
        raise


def read_first_existing(
    spark: SparkSession,
    candidates: Iterable[str],
    *,
    fmt: str = "parquet",
    options: dict | None = None,
    on_missing: str = "none",
    empty_schema: T.StructType | str | None = None,
) -> DataFrame | None:
    """First readable path of ``candidates`` (S2), with a policy for none (S3).

    ``on_missing``: ``"none"`` returns None, ``"empty"`` an empty DataFrame of
    ``empty_schema``, ``"error"`` raises :class:`SourceMissing`.
    """
    tried = []
    for path in candidates:
        tried.append(path)
        df = _try_read(spark, path, fmt, options)
        if df is not None:
            return df
    if on_missing == "none":
        return None
    if on_missing == "empty":
        if empty_schema is None:
            raise ValueError("on_missing='empty' needs empty_schema")
        return spark.createDataFrame([], empty_schema)
    if on_missing == "error":
        raise SourceMissing(f"none of {tried} exists")
    raise ValueError(f"unknown policy {on_missing!r}")


def detect_separator(header_line: str | None) -> str:
    """``,`` unless the header has ``;`` and no ``,``."""
    if header_line and ";" in header_line and "," not in header_line:
        return ";"
    return ","


def read_upload_csv(
    spark: SparkSession, path: str, sep: str | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV with a header; the separator is taken from the header line.

    Only the first line of the first file reaches the driver, to pick the separator.
    Without ``schema`` the types are inferred from the data (long for whole
    numbers, double, string), which costs one extra pass over the upload; a
    known schema skips it.
    """
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        sep = detect_separator(first[0][0] if first else None)
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def parse_timestamps(df: DataFrame, *columns: str) -> DataFrame:
    """Cast text or date columns to timestamps on load (S5); unparseable → null."""
    out = df
    for c in columns:
        dtype = df.schema[c].dataType
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            continue
        if isinstance(dtype, T.DateType):
            out = out.withColumn(c, F.col(c).cast("timestamp_ntz"))
        else:
            out = out.withColumn(c, F.try_to_timestamp(F.col(c).cast("string")))
    return out


def coerce_months(df: DataFrame, column: str = "mes") -> DataFrame:
    """Unparseable months become null and are dropped."""
    parsed = parse_timestamps(df, column)
    return parsed.dropna(subset=[column])


def count_unparseable(df: DataFrame, column: str = "mes") -> DataFrame:
    """One-row count of the rows :func:`coerce_months` drops."""
    parsed = parse_timestamps(df, column)
    return parsed.agg(F.count(F.when(F.col(column).isNull(), F.lit(1))).alias("filas_descartadas"))


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def find_column(columns: Sequence[str], needles: Sequence[str], fallback: int | None = None) -> str | None:
    """First column (in column order) whose lower-cased name contains a needle.

    Falls back to the column at position ``fallback`` when nothing matches.
    """
    for c in columns:
        low = c.lower()
        if any(n in low for n in needles):
            return c
    if fallback is not None and -len(columns) <= fallback < len(columns):
        return columns[fallback]
    return None


def schema_report(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(tabla, ordinal, columna, tipo) for every column of every table.

    Built from schema metadata only; no data is read.
    """
    rows = [
        (name, i + 1, f.name, f.dataType.simpleString())
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    schema = "tabla string, ordinal int, columna string, tipo string"
    return spark.createDataFrame(rows, schema)


def write_records(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write result rows; null stays null in every format (S10). CSV gets a header line."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
