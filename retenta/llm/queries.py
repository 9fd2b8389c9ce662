"""The registered queries of the subpackage: each operator over its whole table, and the
digest columns that the query's contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retenta.llm import ann, bpe, conversation_repair, hard_negatives, license_scan, lm_scoring, mixing, quality, secret_scan, sharding, simhash, warc
from retenta.llm.exact_dedup import DigestIndex
from retenta.llm.staging import staged


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, whole_license, licenses (of lines, comma-joined), n_lines."""
    out = license_scan.scan(documents(spark, sf_dir), license_scan.known_digests(spark), ["doc_id"])
    return out.withColumn("licenses", F.concat_ws(",", "licenses"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.score(documents(spark, sf_dir), ~lm_scoring.held_out())
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, perplexity, limit, rejected."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    out = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id", "lang"])
    return out.select("doc_id", "lang", "perplexity", "limit", "rejected")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark)
    out = staged(index.add(documents(spark, sf_dir), batches=2), "dedup-decisions")
    index.forget()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.round_trip(documents(spark, sf_dir), path, ["doc_id"])
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sizes(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.group(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(documents(spark, sf_dir), ["doc_id"])
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "format")
    return out.select("doc_id", *[count(k) for k in secret_scan.KINDS[:3]], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.totals(conversation_repair.repair(conversation_repair.damaged(rows)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("id") % 100 == 0)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_lm_scoring, op3_quality, op4_sharding, op5_exact_dedup, op6_bpe, op7_ann, op8_mixing, op9_simhash, op10_secret_scan, op11_conversation_repair, op12_hard_negatives, op13_warc)}
