"""Approximate nearest neighbours by multi-index hashing.

The largest inner product becomes a matter of angles: the stored vectors' mean is taken off
(that changes a query's inner products by one constant) and a component is added that
brings all of them to one length. A rotation learned on a bounded sample, iteratively
fitted so that signs lose least, gives every vector a code of BITS signs. Codes are cut
into SUBSTRINGS, and each substring has an index of its occupied buckets. By the pigeonhole
principle a code within ``radius`` of a query's is within radius // SUBSTRINGS of it in at
least one substring, so probing all buckets that near in each index retrieves every code
within the radius; these are then reranked by the inner products of the original vectors.
The radius is that within which TARGET of the true neighbours of some CALIBRATION queries
lie, found against all rows.

All rows are indexed, in blocks of BLOCK rows; each block of queries meets each block of
rows in a task of its own, and only the best of each go on.

Cases: a vector that is null, zero, or holds a null or non-finite component takes no part,
nor does one without id or of another length than most; rows that repeat an id count as
one (the least vector); a query for which fewer than ``k`` rows lie within the radius is
searched again among all rows; with fewer rows than ``k`` all are found; ties go to the
smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retenta.llm.staging import staged

BITS = 64
SUBSTRINGS = 4
SAMPLE = 8192
CALIBRATION = 128
TARGET = 0.96
BLOCK = 16_384
QUERY_BLOCK = 2_048


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): the vectors that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(sound)
    rows = staged(rows.groupBy("id").agg(F.min("v").alias("v")), "ann-vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("v") == sizes["d"]) if sizes else rows


class Codes:
    """The learned map from vectors to codes."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = 30):
        self.mean = sample.mean(axis=0)
        self.longest = float(np.linalg.norm(sample - self.mean, axis=1).max())
        rng, parts = np.random.default_rng(7), []
        x = self._lifted(sample)
        axes = np.linalg.svd(x.T @ x)[0]
        while (lacking := bits - sum(p.shape[1] for p in parts)) > 0:
            basis = axes[:, : min(lacking, x.shape[1])]
            z = x @ basis
            rotation = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(z @ rotation >= 0, 1.0, -1.0).T @ z)
                rotation = (u @ v).T
            parts.append(basis @ rotation)
        self.planes = np.hstack(parts)

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        centred = x - self.mean
        rest = np.sqrt(np.maximum(self.longest**2 - (centred**2).sum(axis=1), 0))
        return np.hstack([centred, rest[:, None]])

    @staticmethod
    def _packed(signs: np.ndarray) -> np.ndarray:
        return np.packbits(signs, axis=1, bitorder="little").view("<u8")[:, 0]

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._packed(self._lifted(x) @ self.planes >= 0)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return self._packed(np.hstack([q, np.zeros((len(q), 1))]) @ self.planes >= 0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column as rows of a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, ties to the smaller id."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Index:
    """Multi-index of a block's codes: for each substring its occupied buckets, and in which
    of them each row lies."""

    def __init__(self, codes: np.ndarray, substrings: int = SUBSTRINGS):
        self.codes, width = codes, 64 // substrings
        self.parts = [(np.uint64(width * i), np.uint64((1 << width) - 1)) for i in range(substrings)]
        self.buckets = [np.unique((codes >> shift) & mask, return_inverse=True) for shift, mask in self.parts]

    def near(self, code: np.uint64, radius: int) -> np.ndarray:
        """All rows whose code differs from ``code`` in at most ``radius`` bits."""
        base, extra = divmod(radius, len(self.parts))
        seen = np.zeros(len(self.codes), bool)
        for i, ((shift, mask), (values, bucket)) in enumerate(zip(self.parts, self.buckets)):
            reach = base if i <= extra else base - 1
            if reach >= 0:
                seen |= (np.bitwise_count(values ^ ((code >> shift) & mask)) <= reach)[bucket]
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _radius(rows: DataFrame, queries: DataFrame, codes: Codes, k: int) -> int:
    """The Hamming distance within which TARGET of the true k nearest of a bounded set of
    queries lie; those are found by brute force over all rows."""
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).collect()
    if not asked:
        return 0
    q_ids, q = np.array([r["id"] for r in asked]), np.array([r["v"] for r in asked])
    q_codes = codes.of_queries(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("id").to_numpy(), matrix(batch.column("v"))
            scores, x_codes = x @ q.T, codes.of_rows(x)
            for i in range(len(q)):
                other = np.flatnonzero(ids != q_ids[i])
                top = other[best_of(ids[other], scores[other, i], k)]
                distance = np.bitwise_count(x_codes[top] ^ q_codes[i]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i, np.int32)), pa.array(ids[top]), pa.array(scores[top, i]), pa.array(distance)], ["q", "id", "score", "distance"])

    found = rows.mapInArrow(run, "q int, id long, score double, distance int")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    distances = found.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("distance").agg(F.count(F.lit(1)).alias("n")).orderBy("distance").collect()
    total, running = sum(r["n"] for r in distances), 0
    for r in distances:  # BITS + 1 rows at most
        running += r["n"]
        if running >= TARGET * total:
            return r["distance"]
    return BITS


def _met(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, codes: Codes, radius: int, k: int) -> DataFrame:
    """(query, id, score): of each block of rows the best k for each query."""
    across, down = max(1, -(-n_rows // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    block = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "v", block(across, 1).alias("i")).withColumn("j", every(down))
    right = queries.select("id", "v", block(down, 2).alias("j")).withColumn("i", every(across))

    def run(stored: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if stored.num_rows and asked.num_rows:
            ids, x = stored.column("id").to_numpy(), matrix(stored.column("v"))
            q_ids, q = asked.column("id").to_numpy(), matrix(asked.column("v"))
            index = Index(codes.of_rows(x))
            for q_id, vector, code in zip(q_ids, q, codes.of_queries(q)):
                near = index.near(code, radius)
                near = near[ids[near] != q_id]
                scores = x[near] @ vector
                top = best_of(ids[near], scores, k)
                out.append((np.full(len(top), q_id), ids[near][top], scores[top]))
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query", "id", "score"), columns)))

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "query long, id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score) of the rows for which ``is_query`` (over ``id``)
    holds: their k nearest other rows, rank 1 the nearest."""
    rows = usable(vectors, id_col, vector)
    queries = rows.filter(is_query)
    n_rows, n_queries = rows.count(), queries.count()
    top = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id")).alias("rank")
    shape = lambda met: met.select("query", top, "id", "score").filter(F.col("rank") <= k)
    names = lambda df: df.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
    if not n_queries:
        return names(shape(rows.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score")).limit(0)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    codes = Codes(np.array([r["v"] for r in sample]))
    found = staged(shape(_met(rows, queries, n_rows, n_queries, codes, _radius(rows, queries, codes, k), k)), "ann-found")
    full = found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, n_rows - 1)).select(F.col("query").alias("id"))
    lacking = staged(queries.join(full, "id", "left_anti"), "ann-lacking")
    n_lacking = lacking.count()
    if n_lacking:
        again = shape(_met(rows, lacking, n_rows, n_lacking, codes, BITS, k))
        found = found.join(lacking.select(F.col("id").alias("query")), "query", "left_anti").unionByName(again)
    return names(found)
