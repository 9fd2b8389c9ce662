"""Balanced label propagation: documents into shards of equal row counts.

Documents of equal text are linked. A group's links are held as one hyperedge, so that no
pairs are made; a group larger than a PART of a shard is split by a hash of its rows into
parts that fit (links between its parts are cut in any balanced sharding). Every linked
document starts in a random shard. In each round a part's members vote by their counts a
shard (summed before the shuffle), and the blocks of members in other shards ask to move
to the shard of most votes. The requests are summed by pairs of shards and ranges of a
hash, and of these sums as many are admitted as leave each shard within its quota, the rows
that leave it in the same round counted out. The others wait for the next round, with
another hash. It ends when none wants to move, or when IDLE rounds in turn admit none. Then each shard that is still over its row count gives up the last rows of
its order, and those, with the documents that no link holds, fill all shards to counts at
most one apart. Built from DataFrame operations only.

Cases: a null text counts as empty (size 8, CRC 0) and null texts are linked with empty
ones; rows of equal id and text are told apart by the order in which they were read; with
fewer rows than shards some shards are empty; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retenta.llm.staging import attach, staged, text_of

#: rounds without a move after which the propagation ends
IDLE = 2
#: a linked part holds at most this share of a shard
PART = 0.25
#: sums of requests, by two shards and a range of a hash, that the driver gets in a round
SUMS = 40_000
#: rows that a task orders
ORDERED_ROWS = 200_000


def gapless(df: DataFrame, keys: list, n_rows: int, label: str) -> DataFrame:
    """``df`` with ``rank``, its place from 0 in the order of ``keys``.

    Range-partitioned and sorted within the partitions, so that no task orders more than
    its share; the written rows keep partition and place, and the partitions' row counts (a
    row each) give the offsets.
    """
    parts = max(1, -(-n_rows // ORDERED_ROWS), min(n_rows // 1000, 32))
    placed = staged(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), label)
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = counts.select("__part", (before - F.col("__first")).alias("__shift"))
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def _admitted(moves: list[tuple[int, int, int]], room: list[int]) -> list[int]:
    """Places in ``moves`` (from, to, rows) of those that leave no shard with more rows than
    before and its ``room``. Starts from all moves and drops some into each shard that is
    over, first those from the shards that have most room left, until none is."""
    source, goal, n = (np.array(x, np.int64) for x in zip(*moves))
    over = np.bincount(goal, n, len(room)).astype(np.int64) - np.bincount(source, n, len(room)).astype(np.int64) - np.array(room)
    kept = np.ones(len(n), bool)
    todo = True
    while todo:
        todo = False
        for k in np.flatnonzero(over > 0):
            into = np.flatnonzero(kept & (goal == k))
            into = into[np.argsort(over[source[into]], kind="stable")]
            drop = into[: int(np.searchsorted(np.cumsum(n[into]), over[k])) + 1]
            kept[drop] = False
            over[k] -= n[drop].sum()
            np.add.at(over, source[drop], n[drop])
            todo = todo or len(drop) > 0
    return np.flatnonzero(kept).tolist()


def _propagate(blocks: DataFrame, by: str, quotas: list[int]) -> DataFrame:
    """Moves blocks (group, part, start, shard, n) to the shard of most votes in their
    ``by`` (part or group), round by round. A move adds to the goal's votes, so the goals
    stay and the rows away from them become fewer in each round that admits any."""
    spark, shards = blocks.sparkSession, len(quotas)
    ranges = max(4, SUMS // shards**2)
    turn, idle = 0, 0
    while idle < IDLE:
        votes = blocks.groupBy(by, "shard").agg(F.sum("n").alias("n"))
        goal = votes.groupBy(by).agg(F.max_by("shard", F.struct("n", F.xxhash64(by, "shard"))).alias("goal"))
        range_ = F.pmod(F.xxhash64(F.lit(turn), "part"), F.lit(ranges))
        code = ((F.col("shard") * shards + F.col("goal")) * ranges + range_).cast("long")
        asked = staged(blocks.join(goal, by).withColumn("code", code), "shard-asked")
        wanted = asked.filter(F.col("goal") != F.col("shard")).groupBy("code").agg(F.sum("n").alias("n")).collect()  # shards * shards * ranges rows at most
        if not wanted:
            break
        load = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a number a shard
        wanted = sorted((r["code"], r["n"]) for r in wanted)
        pairs = [divmod(c // ranges, shards) for c, _ in wanted]
        codes = [wanted[k][0] for k in _admitted([(a, b, n) for (a, b), (_, n) in zip(pairs, wanted)], [q - load.get(k, 0) for k, q in enumerate(quotas)])]
        turn, idle = turn + 1, 0 if codes else idle + 1
        if codes:
            admitted = spark.range(1).select(F.explode(F.split(F.lit(",".join(map(str, codes))), ",").cast("array<bigint>")).alias("code"), F.lit(True).alias("admitted"))
            moved = asked.join(F.broadcast(admitted), "code", "left")
            blocks = staged(moved.select("group", "part", "start", F.when(F.col("admitted"), F.col("goal")).otherwise(F.col("shard")).alias("shard"), "n"), "shard-blocks")
    return blocks


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: ``id_col``, size, text_crc32, shard, slot (gapless from 0 in a shard)
    and linked (whether another row has its text)."""
    body = text_of(text)
    rows = staged(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("digest")
        ).withColumn("row", F.monotonically_increasing_id()),
        "shard-rows",
    )
    n_rows = rows.count()
    small, larger = divmod(n_rows, shards)  # the first shards hold one row more
    quotas = [small + (k < larger) for k in range(shards)]

    part_rows = max(1, int(PART * small))
    groups = staged(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int")), "shard-groups")
    start = F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(shards)).cast("int")
    part = F.xxhash64("digest", F.pmod(F.xxhash64(F.lit(2), "row"), F.col("parts")))
    known = staged(
        attach(rows, groups.select("digest", "parts"), "digest", F.col("row")).select(
            "id", "size", "text_crc32", "row", F.xxhash64("digest").alias("group"), F.when(F.col("parts").isNotNull(), part).alias("part"), start.alias("start")
        ),
        "shard-known",
    )
    linked, free = known.filter("part IS NOT NULL"), known.filter("part IS NULL")
    blocks = linked.groupBy("group", "part", "start").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", F.col("start"))
    blocks = _propagate(staged(blocks.select("group", "part", "start", "shard", "n"), "shard-blocks"), "part", quotas)
    blocks = _propagate(blocks, "group", quotas)  # now the parts of a split group

    ordered = gapless(linked.join(blocks.drop("n", "group"), ["part", "start"]), ["shard", "group", "part", "id", "row"], n_rows, "shard-linked")
    load = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a number a shard
    loads = [load.get(k, 0) for k in range(shards)]
    first = [sum(loads[:k]) for k in range(shards)]
    number = lambda values, k: F.array(*[F.lit(v).cast("long") for v in values])[k]
    ordered = ordered.withColumn("slot", F.col("rank") - number(first, F.col("shard"))).drop("rank")
    over = F.col("slot") >= number(quotas, F.col("shard"))
    columns = ["id", "size", "text_crc32", "row", "group", "part"]
    stay = ordered.filter(~over).select(*columns, "shard", "slot")

    held = [min(a, b) for a, b in zip(loads, quotas)]
    room = [q - h for q, h in zip(quotas, held)]
    filled = [sum(room[: k + 1]) for k in range(shards)]
    # the rows that were given up come first and in group order, so that they stay together
    rest = ordered.filter(over).select(*columns, F.lit(0).alias("late")).unionByName(free.select(*columns, F.lit(1).alias("late")))
    rest = gapless(rest, ["late", "group", "part", "id", "row"], n_rows, "shard-rest")
    to = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in filled]), lambda end: end <= F.col("rank")))
    rest = rest.withColumn("shard", to).withColumn("slot", F.col("rank") - number([f - r for f, r in zip(filled, room)], F.col("shard")) + number(held, F.col("shard")))
    out = stay.unionByName(rest.select(*columns, "shard", "slot"))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("part").isNotNull().alias("linked"))
