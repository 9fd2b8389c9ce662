"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has a bit for each of 64 positions: whether over half of its word
shingles' 64-bit hashes have it set. Equal fingerprints are one class. Classes that differ
in at most ``radius`` bits agree in at least two of four 16-bit quarters as long as the
radius is at most 2, so a class is filed under each of the six pairs of quarters, and
compared with the classes it shares a bucket with. There the fingerprints stand
vertically: one machine word holds a bit of 64 of them. A fingerprint is compared with all
lanes at once, plane by plane: carry-save counters of a few bits a lane add up the
differing bits, and a block of lanes is abandoned once all of them exceed the radius.
A bucket of more than BUCKET classes is cut into pieces that are compared two by two in
tasks of their own, so no task holds more than two pieces of one bucket. Of each bucket a
spanning forest of its links goes on (not all pairs of a dense group); the components over
all buckets are the groups.

Cases: a null text counts as empty; a text without words has fingerprint zero and is linked
like any other; one with fewer words than a shingle is one shingle; rows of equal id stay
rows of their own; null ids are left out when the smallest id is sought; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retenta.llm.components import components
from retenta.llm.staging import attach, staged, text_of

SHINGLE = 3
RADIUS = 2
SEED = 42
QUARTERS = list(combinations(range(4), 2))

#: classes of a bucket that are compared in one piece
BUCKET = 2048
#: fingerprints that are compared with all lanes at once
TILE = 512
#: filed rows that a task compares
TASK_ROWS = 200_000
HASHES_AT_ONCE = 1 << 15
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = text.encode().lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(shingle, len(words))
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_key, fp, row): the fingerprint as a signed long, and a hash of the text."""
    chosen = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text"), F.xxhash64(text_of(text)).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, shingle) for x in batch.column("text").to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(fps)], ["id", "text_key", "fp"])

    out = chosen.mapInArrow(run, T.StructType([chosen.schema["id"], T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())]))
    return out.withColumn("row", F.monotonically_increasing_id())


def within(fps: np.ndarray, radius: int, skip: int = 0) -> Iterator[np.ndarray]:
    """For TILE fingerprints after the other, a table of which row i, lane j, 64 lanes a word,
    says whether that fingerprint and the j-th of all differ in at most ``radius`` bits.
    ``skip``: a mask of bits in which all of them agree."""
    n = len(fps)
    words = -(-n // 64)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    lanes = np.zeros((64, words * 64), np.uint8)
    lanes[:, :n] = bits.T
    planes = np.packbits(lanes, axis=1, bitorder="little").view("<u8")
    # counters start so that they run over at radius + 1
    width = (radius + 1).bit_length()
    offset = (1 << width) - radius - 1
    for first in range(0, n, TILE):
        tile = bits[first : first + TILE]
        out = np.zeros((len(tile), words), np.uint64)
        rows = np.arange(len(tile))
        counter = [np.full((len(tile), words), FULL if offset >> k & 1 else np.uint64(0)) for k in range(width)]
        over = np.zeros((len(tile), words), np.uint64)
        for done, p in enumerate([p for p in range(64) if not skip >> p & 1], 1):
            carry = planes[p][None, :] ^ np.where(tile[rows, p], FULL, np.uint64(0))[:, None]
            for c in counter:
                lost = c & carry
                c ^= carry
                carry = lost
            over |= carry
            if done % 8 == 0 and len(rows):
                going = (over != FULL).any(axis=1)  # of the others every lane exceeds
                if not going.all():
                    rows, over, counter = rows[going], over[going], [c[going] for c in counter]
        out[rows] = ~over
        yield out


def forest(fps: np.ndarray, radius: int, skip: int = 0) -> np.ndarray:
    """For each fingerprint the first of all that it is connected to by links. Of the tables
    of ``within`` no more than one is held."""
    n = len(fps)
    label = np.arange(n)
    for close in within(fps, radius, skip):
        for row in np.flatnonzero(np.bitwise_count(close).sum(axis=1) > 1):
            near = np.flatnonzero(np.unpackbits(close[row].view(np.uint8), bitorder="little")[:n])
            found = np.unique(label[near])
            if len(found) > 1:
                joined = np.zeros(n, bool)
                joined[found[1:]] = True
                label[joined[label]] = found[0]
    return label


def _bucket_links(table: pa.Table, radius: int) -> pa.Table:
    """(a, b) links of a task's buckets."""
    fps = table.column("fp").to_numpy().view(np.uint64)
    unit = table.column("unit").to_numpy()
    pair = table.column("pair").to_numpy()
    order = np.lexsort((fps, pair, unit))
    fps, unit, pair = fps[order], unit[order], pair[order]
    quarter = [(fps >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4)]
    key = np.choose(pair, [quarter[a] << np.uint64(16) | quarter[b] for a, b in QUARTERS])
    new = np.concatenate([[True], (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1]) | (key[1:] != key[:-1])]) if len(fps) else np.zeros(0, bool)
    # units are hashes of a bucket's piece; where two of them are equal, the key tells them apart
    starts = np.flatnonzero(new)
    left, right = [], []
    for a, b in zip(starts, np.append(starts[1:], len(fps))):
        if b - a < 2:
            continue
        members = np.unique(fps[a:b])
        x, y = QUARTERS[pair[a]]
        label = forest(members, radius, 0xFFFF << 16 * x | 0xFFFF << 16 * y)
        linked = label != np.arange(len(members))
        left.append(members[label[linked]])
        right.append(members[linked])
    cat = lambda parts: pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64))
    return pa.table({"a": cat(left), "b": cat(right)})


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest of the links within each bucket, of distinct ``fp``."""
    if radius > 2:
        raise ValueError("four quarters find fingerprints within 2 bits only")
    quarter = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)
    entries = F.array(*[F.struct(F.lit(i).alias("pair"), F.shiftleft(quarter(a), 16).bitwiseOR(quarter(b)).alias("key")) for i, (a, b) in enumerate(QUARTERS)])
    filed = classes.select("fp", F.explode(entries).alias("e")).select("fp", "e.pair", "e.key")
    sizes = filed.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.withColumn("pieces", F.ceil(F.col("n") / BUCKET).cast("int"))
    salted = sizes.withColumn("bucket", F.xxhash64("pair", "key"))
    rows = attach(filed.withColumn("bucket", F.xxhash64("pair", "key")), salted.select("bucket", "pieces"), "bucket", F.col("fp")).filter("pieces IS NOT NULL")
    own = F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("pieces")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    # two pieces meet in one unit; a piece is compared with itself there, or alone if it is the only one
    rows = rows.filter((F.col("pieces") == 1) | (F.col("own") != F.col("other")))
    rows = staged(rows.select("fp", "pair", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("unit")), "simhash-units")
    tasks = max(1, rows.count() // TASK_ROWS, min(rows.count() // 1000, 12))
    dealt = rows.withColumn("task", F.pmod("unit", F.lit(tasks)).cast("int")).repartition(tasks, "task")

    def run(table: pa.Table) -> pa.Table:
        return _bucket_links(table, radius)

    return dealt.groupBy("task").applyInArrow(run, "a long, b long")


def group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """For each row: ``id_col``, text_key, fp (signed long), component_id (the smallest id of
    the group) and kept (true for one row of each group, one of that id)."""
    rows = staged(fingerprints(docs, id_col, text, shingle), "simhash-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row")))
    classes = staged(rows.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    roots = components(staged(links(classes.select("fp"), radius), "simhash-links")).withColumnRenamed("node", "fp")
    linked = staged(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-linked")
    best = linked.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("rows")).filter("rows > 1")
    facts = attach(linked.select("fp", "root"), best, "root", F.col("fp")).filter("best IS NOT NULL").select("fp", "best")
    out = attach(rows, facts, "fp", F.col("row"))
    return out.select(
        F.col("id").alias(id_col),
        "text_key",
        "fp",
        F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
        F.when(F.col("best").isNull(), True).otherwise(F.col("best.row") == F.col("row")).alias("kept"),
    )


def kept_rows(docs: DataFrame, grouped: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``group`` kept, with their own columns. Of rows of equal id and
    text one stays, that of the smallest hash of all columns."""
    columns = docs.columns
    named = lambda: F.concat(F.when(F.col(f"`{id_col}`").isNull(), "n").otherwise("v"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    keys = grouped.filter("kept").select(named().alias("__id"), F.col("text_key").alias("__text")).distinct()
    marked = docs.withColumns({"__id": named(), "__text": F.xxhash64(text_of(text)), "__row": F.xxhash64(*[F.col(f"`{c}`") for c in columns])})
    place = F.row_number().over(W.partitionBy("__id", "__text").orderBy("__row"))
    return marked.join(keys, ["__id", "__text"]).withColumn("__place", place).filter("__place = 1").select(*[F.col(f"`{c}`") for c in columns])
