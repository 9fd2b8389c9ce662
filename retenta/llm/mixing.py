"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand in a permuted order, that of a seeded 60-bit hash. A source
of which t words are wanted is read in whole passes, and in a last pass up to the hash at
which t is reached. Its passes are cut into blocks, equal ranges of the hash, so that the
source has an exact quota of blocks. Starting with all output shards and all quotas, a
tree halves the shards again and again: how many blocks of each source go left is drawn
from the multivariate hypergeometric distribution (draws without replacement), so that the
quotas below a node always sum to its own, and each shard ends with its own exact quota of
each source. A shard then takes its quota from the source's blocks in a permuted order:
disjoint blocks, each one in one shard only. Within a shard the documents are ordered
by a hash of their own.

What a document is given depends on its id, its source and the sources' totals: a document
is decided where it lies, and texts are never moved. Totals, targets and hash limits come
from sums over all documents; only a row a source is joined to the documents.

Cases: a null source is a source of its own, the last one; a null text, or one without
words, has size 0; a corpus without words has targets 0 and takes nothing; rows of equal
id and source are taken together; an empty table gives an empty table; other columns are
kept as they are unless they bear a name that the operator adds, which is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retenta.llm.staging import WORD, staged, text_of

SEED = 17
SHARDS = 64
#: blocks of an average shard
BLOCKS = 128
#: times that a document is taken at most, and the weights of the sources in turn
MOST = 3
WEIGHTS = (1, 2, 3)

BITS = 60
LEVEL = 10  # bits by which one step narrows the hash limit


def words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def order_hash(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """The place of a document in its source's permuted order, 0 to 2^60 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 64 - BITS)


def source_key(source: str = "source") -> Column:
    """Never null; sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, weight, target) from (key, size): all sizes are shared by weight;
    a source stops at MOST times its size, and the excess is shared anew."""
    place = F.row_number().over(W.orderBy("key"))  # a row a source
    sources = staged(
        sizes.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("weight", F.array(*map(F.lit, WEIGHTS))[(place - 1) % len(WEIGHTS)]),
        "mix-sources",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, full = float(total) / max(1, sources.agg(F.sum("weight")).first()[0] or 1), None
    while True:
        above = (F.col("weight") * F.lit(share)) > F.col("source_size") * MOST
        row = sources.agg(
            F.sum(F.when(above, F.col("source_size") * MOST)).alias("stopped"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("n")
        ).first()
        if row["n"] == full or not row["open"]:
            break
        full, share = row["n"], (total - (row["stopped"] or 0)) / row["open"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(share), (F.col("source_size") * MOST).cast("double")))


def hash_limits(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``passes`` (whole ones) and ``limit``: in the last pass, documents whose hash is
    below it are taken. The limit is found bit by bit: the words below each of 2^LEVEL
    equal ranges are summed, and the range in which the target falls is cut anew, until it
    holds one document (or documents of one hash)."""
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0)
    state = sources.withColumn("passes", passes.cast("int"))
    state = state.withColumns({"rest": F.col("target") - F.col("passes") * F.col("source_size"), "prefix": F.lit(0).cast("long"), "limit": F.lit(0).cast("long")})
    state = staged(state.withColumn("open", F.col("rest") > 0), "mix-limits")
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        fields = state.filter("open").select("key", "rest", "prefix")
        bin_ = F.shiftright("hash", shift)
        bins = (
            sizes.join(fields, "key").filter(F.shiftright("hash", shift + LEVEL) == F.col("prefix"))
            .groupBy("key", "rest", bin_.alias("bin")).agg(F.sum("size").alias("size"), F.countDistinct("hash").alias("hashes"))
        )
        below = F.coalesce(F.sum("size").over(W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # 2^LEVEL rows a source at most
        cut = (
            bins.withColumn("below", below).filter((F.col("below") <= F.col("rest")) & (F.col("rest") < F.col("below") + F.col("size")))
            .select("key", "bin", (F.col("rest") - F.col("below")).alias("left"), "size", "hashes")
        )
        state = state.join(cut, "key", "left")
        done = (F.col("hashes") <= 1) | F.lit(shift == 0)
        took = F.when(done & (2 * F.col("left") >= F.col("size")), 1).otherwise(0)  # the nearer end
        state = staged(
            state.select(
                "key", "source_size", "weight", "target", "passes",
                F.coalesce("left", "rest").alias("rest"),
                F.coalesce("bin", "prefix").alias("prefix"),
                # without a bin in which the target falls, all of the range is taken
                F.when(~F.col("open"), F.col("limit")).when(F.col("bin").isNull(), F.shiftleft(F.col("prefix") + 1, shift + LEVEL)).otherwise(F.shiftleft(F.col("bin") + took, shift)).alias("limit"),
                (F.col("open") & F.col("bin").isNotNull() & ~F.coalesce(done, F.lit(True))).alias("open"),
            ),
            "mix-limits",
        )
        if not state.filter("open").limit(1).count():
            break
    return state.select("key", "source_size", "weight", "target", "passes", "limit")


def split_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> np.ndarray:
    """A shard's block quota of each source: the path from the tree's root to its leaf. All
    shards draw the same numbers at a node they share, so their quotas sum to the whole."""
    first, last, left = 0, shards, quotas.astype(np.int64)
    while last - first > 1:
        middle = (first + last) // 2
        blocks = int(left.sum())
        to_left = blocks * (middle - first) // (last - first)
        rng = np.random.default_rng([seed, first, last])
        drawn = rng.multivariate_hypergeometric(left, to_left, method="marginals") if blocks else left
        if shard < middle:
            last, left = middle, drawn
        else:
            first, left = middle, left - drawn
    return left


def plan(sizes: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """A row a source: target, passes, limit, n_blocks (of a whole pass), quota (blocks of
    all passes), and ``ends``: up to which permuted block each shard takes."""
    sources = hash_limits(sizes, targets(sizes))
    block_words = max(1.0, (sources.agg(F.sum("target")).first()[0] or 0) / (shards * blocks))
    n = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(block_words))).cast("long")
    width = (F.floor(F.lit(2.0**BITS) / F.col("n_blocks")) + 1).cast("long")
    sources = sources.withColumn("n_blocks", n).withColumn("width", width)
    sources = staged(sources.withColumn("quota", F.col("passes") * F.col("n_blocks") + F.ceil(F.col("limit") / F.col("width")).cast("long")), "mix-plan")

    def leaf(key, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("key")
        drawn = split_quotas(table["quota"].to_numpy(), shards, int(key[0]), seed)
        return pd.DataFrame({"key": table["key"], "shard": table["shard"], "blocks": drawn})

    leaves = sources.select("key", "quota", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    drawn = leaves.groupBy("shard").applyInPandas(leaf, "key string, shard int, blocks long")
    ends = drawn.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("shard", "blocks"))).alias("parts"))  # one entry a shard
    sums = F.aggregate("parts", F.array(F.lit(0).cast("long")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x["blocks"])))
    return staged(sources.join(ends.select("key", F.slice(sums, 2, shards).alias("ends")), "key"), "mix-plan")


def _stride(quota: pd.Series) -> pd.Series:
    """A stride that has no divisor in common with the quota, near its golden section: it
    steps through all blocks in a scattered order."""

    def one(n: int) -> int:
        a = max(1, int(n * 0.6180339887498949))
        while math.gcd(a, n) > 1:
            a += 1
        return a

    return quota.map(lambda n: one(int(n)) if n else 1)


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), source_key(source).alias("key"), order_hash(id_col, seed).alias("hash"), words(text).alias("size"))


def assign(docs: DataFrame, planned: DataFrame, hash_: Column, key: Column, seed: int = SEED) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``draws``: an array of (pass, shard,
    place), one for each time that the row is taken; ``place`` orders a shard."""
    facts = planned.withColumn("stride", F.pandas_udf(_stride, "long")("quota")).select(
        F.col("key").alias("__key"), "source_size", "target", *[F.col(c).alias(f"__{c}") for c in ("passes", "limit", "n_blocks", "width", "quota", "ends", "stride")]
    )
    added = {"source_size", "target", "draws"}
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added], hash_.alias("__hash"), key.alias("__key"))
    taken = F.col("__passes") + F.when(F.col("__hash") < F.col("__limit"), 1).otherwise(0)
    block = F.floor(F.col("__hash") / F.col("__width")).cast("long")

    def draw(p: Column) -> Column:
        number = p * F.col("__n_blocks") + block
        permuted = F.pmod(number * F.col("__stride"), F.col("__quota"))
        shard = F.size(F.filter("__ends", lambda x: x <= permuted))
        return F.struct(p.cast("int").alias("pass"), shard.alias("shard"), F.xxhash64(F.lit(seed + 1), "__hash", p.cast("int")).alias("place"))

    passes = F.filter(F.array(*[F.lit(p).cast("long") for p in range(MOST)]), lambda p: p < taken)
    out = rows.join(facts, "__key", "left").withColumn("draws", F.transform(passes, draw))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs`` with ``source_size``, ``target`` and ``draws``."""
    planned = plan(staged(sizes_of(docs, id_col, text, source, seed), "mix-sizes"), shards, blocks, seed)
    return assign(docs, planned, order_hash(id_col, seed), source_key(source), seed)


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """As ``mix``, but in place of the documents' columns ``id`` and ``size``."""
    sizes = staged(sizes_of(docs, id_col, text, source, seed), "mix-sizes")
    planned = plan(sizes, shards, blocks, seed)
    return assign(sizes, planned, F.col("hash"), F.col("key"), seed).drop("hash", "key")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The rows of the mix with exactly the columns of ``docs``; a row that is taken n times
    is there n times. They are written as they are mixed: shard after shard, each in the
    order of its shuffle; a shard larger than a task's share runs over several."""
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    rows = docs.select(*[F.col(f"`{c}`").alias(at[c]) for c in names])
    drawn = mix(rows, at[id_col], at[text], at[source], shards, blocks, seed).withColumn("draw", F.explode("draws"))
    ordered = drawn.repartitionByRange("draw.shard", "draw.place").sortWithinPartitions("draw.shard", "draw.place")
    return ordered.select(*[F.col(at[c]).alias(c) for c in names])
