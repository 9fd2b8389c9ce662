"""From documents to token ids in five stages, each one operator of ``retenta.llm``.

A stage takes (spark, docs, sf_dir) and returns a table; all but the last return the
columns of ``docs``. Between stages the table is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retenta.llm import bpe, exact_dedup, mixing, quality, simhash
from retenta.llm.staging import staged, text_of


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    rows = docs.select(*[F.col(f"`{c}`").alias(at[c]) for c in names])
    out = quality.classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), at["doc_id"], at["text"], at["lang"])
    return out.filter(~F.col("rejected")).select(*[F.col(at[c]).alias(c) for c in names])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the smallest id stays."""
    index = exact_dedup.DigestIndex(spark)
    decisions = staged(index.add(docs, batches=2), "dedup-decisions")
    index.forget()
    return exact_dedup.kept_rows(docs, decisions)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group (three-word shingles, at most 2 bits) one document stays."""
    return simhash.kept_rows(docs, simhash.group(docs, shingle=3, radius=2))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target sizes; what is taken n times is there n times."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids (little-endian 32-bit) and whether decoding them
    gives the text back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select("doc_id", "source", "lang", "text", F.xxhash64(text_of("text")).alias("text_key"))
    out = bpe.round_trip(rows, path, ["doc_id", "source", "lang", "text_key"])
    same = F.xxhash64("decoded") == F.col("text_key")
    return out.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the model, the fingerprints nor the tokens; tests/llm compare
#: the stages with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
