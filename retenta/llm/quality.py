"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

The model (``kneser_ney``) is trained on the texts of trusted rows: labelled of good quality
and not toxic, a bounded sample of at most TRAIN_ROWS of them. Every document is then
scored: documents are dealt into slices, a slice sends each n-gram it holds once to the
n-gram's shard, the shards join these with their share of the model, and the slice gets the
values back and sums them by document. The limit of a language is the QUANTILE of the
perplexities of its trusted rows that the model was not trained on, each weighted by its
bytes, so that tiny texts do not set it; documents above it are rejected. A language with
too few such rows to resolve the quantile gets the limit of all languages together. These
quantiles cover all such rows, counted in fine steps.

Cases: a null or empty text has no perplexity and is not rejected; a language with too few
trusted rows or none (or a null one) gets the limit of all trusted rows together; without trusted
rows nothing is rejected; of conflicting labels the worst holds; a label without document
is ignored; repeated rows are scored row by row; an empty table gives an empty table. All
columns of the documents are kept; those that bear an added name are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retenta.llm import kneser_ney as kn
from retenta.llm import slices
from retenta.llm.staging import staged, text_of

TRAIN_ROWS = 20_000
QUANTILE = 0.995
SLICE_BYTES = 16 << 20
#: steps of log10 perplexity
STEP = 0.0005


def trusted(labels: DataFrame) -> DataFrame:
    """(id, held): the trusted rows' ids; every fifth is held back from training."""
    rows = labels.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    held = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) == 0
    return rows.filter("id IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) = 0").select("id", held.alias("held"))


def perplexities(docs: DataFrame, model: DataFrame, text: str = "text", keep: list[str] | None = None, order: int = kn.ORDER, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """All rows and columns (or those of ``keep``) of ``docs`` and ``perplexity`` (a byte's,
    null without bytes)."""
    n = slices.number_of(docs, text, slice_bytes)
    names = [c for c in docs.columns if c.lower() != "perplexity"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    of_text = f"c{names.index(text)}"
    kept = [i for i, c in enumerate(names) if keep is None or c in keep]
    texts = slices.packed(rows.withColumn("slice", F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int")), n)

    def opened(blocks: pa.Table) -> tuple[pa.Table | None, np.ndarray, np.ndarray]:
        table = slices.unpacked(blocks.column("block"))
        if table is None:
            return None, np.zeros(0, np.uint8), np.zeros(1, np.int64)
        filled = pa.table({"text": pc.fill_null(table.column(of_text), "")})
        return table, *slices.documents_of(filled)

    def distinct(flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Of each order the n-grams that occur, the contexts of a text's beginning too."""
        parts = [np.unique(kn.grams(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order)) for a, b in kn.chunks(flat, offsets)]
        top = np.unique(np.concatenate([*parts, np.zeros(1, np.uint64)]))
        by_order = {order: top}
        for k in range(order - 1, -1, -1):
            by_order[k] = np.unique(np.concatenate([kn.suffixes(by_order[k + 1], k), by_order[k + 1] >> np.uint64(kn.SYMBOL)]))
        return [by_order[k] for k in range(order + 1)]

    def wanted(by_order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The keys that a slice asks for in the order of their mixed form, and that form."""
        keys = np.concatenate([kn.marked(x, k) for k, x in enumerate(by_order)])
        mixed = slices.mixed(keys)
        at = np.argsort(mixed)
        return keys[at], mixed[at]

    def ask(key: tuple, blocks: pa.Table) -> pa.Table:
        _, flat, offsets = opened(blocks)
        _, mixed = wanted(distinct(flat, offsets))
        parts = slices.by_shard(mixed, n)
        return pa.table({"shard": pa.array(range(n), pa.int32()), "slice": pa.array([key[0].as_py()] * n, pa.int32()), "keys": pa.array([slices.pack_keys(mixed[p]) for p in parts], pa.binary())})

    def place(batches):
        for batch in batches:
            mixed = slices.mixed(batch.column("gram").to_numpy().view(np.uint64))
            bounds = np.array([((1 << 64) * k) // n for k in range(1, n)], np.uint64)
            shard = np.searchsorted(bounds, mixed, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(mixed.view(np.int64)), batch.column("log_p"), batch.column("log_gamma")], ["shard", "mixed", "log_p", "log_gamma"])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        keys = held.column("mixed").to_numpy().view(np.uint64)
        at = np.argsort(keys)
        keys = keys[at]
        values = [held.column(c).to_numpy()[at].astype(np.float32) for c in ("log_p", "log_gamma")]
        out = []
        for blob in asked.column("keys"):
            mixed = slices.unpack_keys(blob.as_py())
            got = np.full((2, len(mixed)), np.nan, np.float32)
            if len(keys):
                where = np.minimum(np.searchsorted(keys, mixed), len(keys) - 1)
                hit = keys[where] == mixed
                for i, v in enumerate(values):
                    got[i, hit] = v[where[hit]]
            out.append(got.tobytes())
        return pa.table({"slice": asked.column("slice"), "shard": asked.column("shard"), "values": pa.array(out, pa.binary())})

    schema = T.StructType([*[rows.schema[f"c{i}"] for i in kept], T.StructField("perplexity", T.DoubleType())])

    def sum_up(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        table, flat, offsets = opened(blocks)
        by_order = distinct(flat, offsets)
        keys, _ = wanted(by_order)
        got = answers.sort_by("shard").column("values")
        got = np.concatenate([np.frombuffer(x.as_py(), np.float32).reshape(2, -1) for x in got], axis=1).astype(np.float64)
        at = np.argsort(keys)
        keys, log_p, log_gamma = keys[at], got[0, at], got[1, at]
        spot = lambda x, k: np.searchsorted(keys, kn.marked(x, k))
        # the log probability of each n-gram, order by order: its own, or the suffix's with its context's weight
        lower = np.full(1, -np.log10(257))
        for k in range(1, order + 1):
            own = log_p[spot(by_order[k], k)]
            passed = np.nan_to_num(log_gamma[spot(by_order[k] >> np.uint64(kn.SYMBOL), k - 1)])
            back = lower[np.searchsorted(by_order[k - 1], kn.suffixes(by_order[k], k - 1))]
            lower = np.where(np.isnan(own), passed + back, own)
        total = np.zeros(len(offsets) - 1)
        for a, b in kn.chunks(flat, offsets):
            within = offsets[a : b + 1] - offsets[a]
            found, where = np.unique(kn.grams(flat[offsets[a] : offsets[b]], within, order), return_inverse=True)
            steps = np.concatenate([[0.0], np.cumsum(lower[np.searchsorted(by_order[order], found)][where])])
            total[a:b] = steps[within[1:]] - steps[within[:-1]]
        size = np.diff(offsets)
        perplexity = 10 ** (-total / np.maximum(size, 1))
        return table.select([f"c{i}" for i in kept]).append_column("perplexity", pa.array(perplexity, mask=size == 0))

    asked = texts.groupBy("slice").applyInArrow(ask, "shard int, slice int, keys binary")
    shares = model.mapInArrow(place, "shard int, mixed long, log_p double, log_gamma double")
    answers = asked.groupBy("shard").cogroup(shares.groupBy("shard")).applyInArrow(answer, "slice int, shard int, values binary")
    out = texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(sum_up, schema)
    return out.select(*[F.col(f"c{i}").alias(names[i]) for i in kept], "perplexity")


def limits(scored: DataFrame, held: DataFrame, id_col: str, lang: str, size: str, quantile: float = QUANTILE) -> tuple[DataFrame, float | None]:
    """(lang, limit) by language that has rows enough to resolve the quantile, and the limit
    of all languages together (null without trusted rows). Perplexities are counted by
    steps, some thousands a language; ``size`` has a row's weight."""
    step = F.ceil(F.log10("perplexity") / STEP).cast("int").alias("step")
    known = scored.filter("perplexity IS NOT NULL").select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(size).cast("long").alias("size"), step).join(held, "id")
    counts = staged(known.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")), "quality-steps")
    least = round(1 / (1 - quantile))

    def at_quantile(steps: DataFrame, by: list[str]) -> DataFrame:
        running, total = F.sum("weight").over(W.partitionBy(*by).orderBy("step")), F.sum("weight").over(W.partitionBy(*by))
        reached = steps.withColumn("share", running / total).filter(F.col("share") >= quantile)
        return reached.groupBy(*by).agg(F.pow(F.lit(10.0), F.min("step") * STEP).alias("limit"))

    overall = at_quantile(counts.groupBy("step").agg(F.sum("weight").alias("weight")).withColumn("all", F.lit(1)), ["all"]).first()
    resolved = counts.withColumn("rows", F.sum("n").over(W.partitionBy("lang"))).filter(F.col("lang").isNotNull() & (F.col("rows") >= least))
    return at_quantile(resolved, ["lang"]), overall["limit"] if overall else None


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` (or those of ``keep``, which has the id and the
    language) with ``perplexity``, ``limit`` and ``rejected``."""
    chosen = staged(trusted(labels), "quality-trusted")
    sample = chosen.filter("NOT held").orderBy(F.xxhash64("id"), "id").limit(train_rows).select("id")  # at most train_rows ids
    texts = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text")).join(F.broadcast(sample), "id")
    model = kn.train(texts)
    named = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("perplexity", "limit", "rejected")])
    named = named.withColumn("__bytes", F.octet_length(F.col(text)))
    scored = staged(perplexities(named, model, text, keep and [*keep, "__bytes"]), "quality-scored")
    by_lang, overall = limits(scored, chosen.filter("held").select("id"), id_col, lang, "__bytes")
    out = scored.drop("__bytes").join(by_lang.withColumnRenamed("lang", "__lang"), F.col(lang) == F.col("__lang"), "left").drop("__lang")
    out = out.withColumn("limit", F.coalesce("limit", F.lit(overall).cast("double")))
    return out.withColumn("rejected", F.coalesce(F.col("perplexity") > F.col("limit"), F.lit(False)))
