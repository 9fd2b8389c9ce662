"""Spark result against its DuckDB twin: row count, column names, values.

Values are compared order-insensitively: both sides are sorted on every column
after normalising (floats rounded to 9 significant places, NaN as null,
integers written as floats when they hold nulls on one side).
"""

from __future__ import annotations

import math

import duckdb
import pandas as pd


DIGITS = 17

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return None
        return float(f"{float(v):.{DIGITS}g}")
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def types_match(spark_df, con, sql: str) -> bool:
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE ({sql})").fetchall()}
    return all(SPARK_TO_DUCK.get(t, t) == duck_types.get(c) for c, t in spark_df.dtypes)


def strict_match(s: pd.DataFrame, d: pd.DataFrame) -> bool:
    """Same pandas dtypes and same row hashes after sorting columns by name and rows
    by value: what a hash over the two pandas views would see, with no normalisation."""
    cols = sorted(s.columns)
    s, d = s[cols], d[cols]
    if [str(s[c].dtype) for c in cols] != [str(d[c].dtype) for c in cols]:
        return False
    s = s.sort_values(cols).reset_index(drop=True)
    d = d.sort_values(cols).reset_index(drop=True)
    return int(pd.util.hash_pandas_object(s, index=False).sum()) == int(pd.util.hash_pandas_object(d, index=False).sum())


def compare(spark_df, con, sql: str) -> dict:
    s = spark_df.toPandas()
    d = con.execute(sql).fetchdf()
    res = {
        "rows_spark": len(s),
        "rows_oracle": len(d),
        "columns_match": sorted(s.columns) == sorted(d.columns),
        "types_match": types_match(spark_df, con, sql),
    }
    if not res["columns_match"]:
        res["columns"] = (sorted(s.columns), sorted(d.columns))
        res["values_match"] = False
        return res
    rs, rd = _rows(s), _rows(d)
    res["values_match"] = rs == rd
    res["strict_match"] = strict_match(s, d)
    if not res["values_match"]:
        diffs = [(a, b) for a, b in zip(rs, rd) if a != b]
        res["first_diffs"] = diffs[:3]
        res["n_diff"] = len(diffs)
    return res
