"""Substring and regex search over an index of trigrams.

A text that holds a term holds all of the term's trigrams, so only the rows that the
postings of its rarest trigrams have in common need to be looked at; those are then
checked with the term itself. Postings are one row for each (column, trigram, key), in
folders by a hash of the trigram and sorted by it, so a search reads a few folders and in
them the row groups of its trigrams. A term or expression without three literal characters
in a row is searched for by a scan, as without an index.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import regex_match, substring_filter

#: folders of postings, and trigrams of a term that are intersected: the rarest ones
FOLDERS = 64
INTERSECTED = 3


def folder_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def write_trigrams(df: DataFrame, path: str, key: str, columns: Sequence[str]) -> None:
    """Write the postings of ``columns`` (compared in lower case) under ``path``. ``key`` is
    unique and not null. A trigram that most rows hold is range-partitioned by key too."""
    text = lambda c: F.lower(F.col(c).cast("string"))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(text(c)) - 2), lambda i: F.substring(text(c), i, F.lit(3)))
    some = lambda c: F.when(F.length(text(c)) >= 3, F.array_distinct(grams(c)))
    postings = None
    for c in columns:
        part = df.select(F.col(key).alias("clave"), F.lit(c).alias("columna"), F.explode(some(c)).alias("trigrama"))
        postings = part if postings is None else postings.unionByName(part)
    dealt = postings.withColumn("carpeta", folder_of(F.col("trigrama"))).repartitionByRange("carpeta", "trigrama", "clave")
    dealt.sortWithinPartitions("carpeta", "trigrama", "clave").write.partitionBy("carpeta").parquet(f"{path}/postings")
    stored = _postings(df, path, key)
    stored.groupBy("columna", "trigrama").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")


def _postings(df: DataFrame, path: str, key: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.read.schema(f"clave {kind}, columna string, trigrama string, carpeta int").parquet(f"{path}/postings")


def literal_parts(pattern: str) -> list[str]:
    """Texts that every match of a regular expression holds: those between its dots. Of an
    expression with any other special character none is taken for granted."""
    return [] if re.search(r"[\\\[\](){}*+?|^$]", pattern) else pattern.split(".")


def search(df: DataFrame, path: str, term: str, key: str, columns: Sequence[str], regex: bool = False) -> DataFrame:
    """Rows of ``df`` of which one of ``columns`` holds ``term`` (with ``regex``: matches it),
    whatever the case."""
    spark = df.sparkSession
    if regex:
        hit = regex_match(columns[0], term)
        for c in columns[1:]:
            hit = hit | regex_match(c, term)
        checked = df.filter(hit)
    else:
        checked = substring_filter(df, term, tuple(columns))
    parts = literal_parts(term) if regex else [term]
    grams = sorted({p[i : i + 3].lower() for p in parts for i in range(len(p) - 2)})
    if not grams or any(len(g) != 3 for g in grams):  # lower case may be longer
        return checked
    counts = spark.read.schema("columna string, trigrama string, n long").parquet(f"{path}/counts")
    found = counts.filter(F.col("trigrama").isin(grams) & F.col("columna").isin(list(columns))).collect()  # a row a trigram and column
    keys = None
    for c in columns:
        n = {r["trigrama"]: r["n"] for r in found if r["columna"] == c}
        if len(n) < len(grams):
            continue  # no row holds all of them
        rarest = sorted(grams, key=lambda g: (n[g], g))[:INTERSECTED]
        folders = [r[0] for r in spark.createDataFrame([(g,) for g in rarest], "g string").select(folder_of(F.col("g"))).distinct().collect()]
        held = _postings(df, path, key).filter(F.col("carpeta").isin(folders) & F.col("trigrama").isin(rarest) & (F.col("columna") == c))
        common = held.groupBy("clave").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rarest)).select(F.col("clave").alias(key))
        keys = common if keys is None else keys.unionByName(common)
    if keys is None:
        return df.limit(0)
    return checked.join(keys, key, "left_semi")
