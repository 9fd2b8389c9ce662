"""Interpolated modified Kneser-Ney model over the bytes of texts, as Spark tables.

An n-gram of k bytes is a number of 9-bit symbols (0 for what stands before a text, else
the byte plus one) with its order above them. The highest order has its counts, a lower one
the number of different symbols seen before it (its count where it begins a text). An order's discounts
follow from how many of its n-grams have the counts 1 to 4. All sums are grouped sums, and
probabilities come from joins of n-grams with their contexts and their suffixes, sharded by
key; a context has at most 257 n-grams, so no key of these joins is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retenta.llm import slices
from retenta.llm.staging import staged

ORDER = 5
SYMBOL = 9
CHUNK = 1 << 20


def grams(flat: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte the ``order``-gram that it ends, within its text; no order mark."""
    place = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
    symbols = flat.astype(np.uint64) + np.uint64(1)
    out = symbols.copy()
    for back in range(1, order):
        before = np.zeros_like(symbols)
        before[back:] = symbols[:-back]
        before[place < back] = 0
        out |= before << np.uint64(SYMBOL * back)
    return out


def marked(keys: np.ndarray, order: int) -> np.ndarray:
    """An order's n-grams as keys that are unlike any other order's."""
    return keys | np.uint64(order << 60)


def suffixes(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << SYMBOL * order) - 1)


def chunks(flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK bytes, at least one text each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK)) - 1)
        yield at, to
        at = to


def count(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, c): the n-grams of the highest order in a ``text`` column and their counts, of
    which each task sends one sum a chunk and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = slices.documents_of(pa.Table.from_batches([batch]))
            for a, b in chunks(flat, offsets):
                keys, n = np.unique(grams(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "c"])

    return texts.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def discounts(counted: DataFrame) -> list[float]:
    """D1, D2 and D3+ of an order; the usual halves where its counts of counts are too thin."""
    n1, n2, n3, n4 = counted.agg(*[F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]).first()
    if not all((n1, n2, n3, n4)):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def train(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, log_p, log_gamma): marked keys of all orders, their log10 probability after
    their context (null for keys that are contexts only), and the log10 weight with which
    they, as contexts, pass on to the lower order (null if nothing follows them)."""
    counted = {order: staged(count(texts, order), "kn-counts")}
    for k in range(order - 1, 0, -1):
        suffix = F.col("key").bitwiseAND(F.lit((1 << SYMBOL * k) - 1))
        begins = F.shiftright("suffix", SYMBOL * (k - 1)) == 0
        counted[k] = staged(
            counted[k + 1].withColumn("suffix", suffix).groupBy("suffix")
            .agg(F.when(F.max(begins), F.sum("c")).otherwise(F.count(F.lit(1))).alias("c")).withColumnRenamed("suffix", "key"),
            "kn-counts",
        )
    lower, tables = None, []
    for k in range(1, order + 1):
        d = discounts(counted[k])
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = counted[k].withColumns({"context": F.shiftright("key", SYMBOL), "discount": discount})
        contexts = rows.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("discount") / F.sum("c")).alias("gamma"))
        rows = rows.join(contexts, "context")
        if lower is None:
            rows = rows.withColumn("p_lower", F.lit(1 / 257))
        else:
            rows = rows.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << SYMBOL * (k - 1)) - 1))).join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("p_lower")), "suffix")
        lower = staged(rows.select("key", ((F.col("c") - F.col("discount")) / F.col("total") + F.col("gamma") * F.col("p_lower")).alias("p")), "kn-order")
        mark = lambda n: F.lit(n << 60 if n < 8 else (n << 60) - (1 << 64))
        tables.append(lower.select(F.col("key").bitwiseOR(mark(k)).alias("gram"), F.log10("p").alias("log_p"), F.lit(None).cast("double").alias("log_gamma")))
        tables.append(contexts.select(F.col("context").bitwiseOR(mark(k - 1)).alias("gram"), F.lit(None).cast("double").alias("log_p"), F.log10("gamma").alias("log_gamma")))
    model = tables[0]
    for t in tables[1:]:
        model = model.unionByName(t)
    return staged(model.groupBy("gram").agg(F.max("log_p").alias("log_p"), F.max("log_gamma").alias("log_gamma")), "kn-model")
