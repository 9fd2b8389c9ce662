"""Hard-negative mining with an STR-packed R-tree over inner products.

For an anchor, the rows of largest inner product that share its label are its positives, and
its hard negatives are rows of other labels whose score comes close to a positive's: within
a window below it. Rows are packed sort-tile-recursively: Spark cuts the table by quantiles
of its most varying coordinates, one coordinate a level, into tiles of about TILE_ROWS rows;
within a tile rows are sorted and tiled again into leaves, and leaves are packed FAN to a
node up to the root. A node's minimum bounding box gives for every coordinate an interval
of its product with the anchor's, and their sum an interval of the score. A search takes
nodes best first from a queue by the upper end, and prunes those outside all of an anchor's
windows, or whose upper end is strictly below the k-th best score found (equal ones stay,
as ties go to the smaller id).

Between tiles the same is done with boxes of whole tiles and of blocks of anchors that lie
close together: a block first meets the FIRST tiles of highest upper end; the k-th scores
found there raise the lower ends of the windows; of the other tiles it meets those that
its windows still reach. Each such meeting is a task's group of one tile with a bounded
number of anchors. Of rows equal in label and vector only the k + 1 of smallest ids can
be in any answer, so no more are searched, however many there are.

Cases: a row with a null id, label or vector, or with a null or non-finite component takes
no part; a shorter vector counts as filled up with zeros; of several rows of one id the one
of least label, then least vector counts; components are exact integers and saturate at the
ends of a long, as do scores; an anchor without positives, or a positive without negatives
in its window, has no row; an empty table gives an empty table; other columns are not
looked at.
"""

from __future__ import annotations

import heapq
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retenta.llm.staging import attach, staged

SCALE = 256
#: a negative scores at least 1 - 1/PART of its positive: 80 %
PART = 5

TILE_ROWS = 8192
LEAF_ROWS = 256
FAN = 8
#: parts into which one level cuts a node, and their relative accuracy's inverse
CUTS = 8
ACCURACY = 1000
#: anchors of a block, blocks that meet a tile in one group, and tiles that a block meets first
BLOCK = 512
MEET = 8
FIRST = 2
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: below this, double precision holds all products and sums exactly
EXACT = float(1 << 53)


def scaled(vectors: DataFrame, id_col: str, label: str, vector: str) -> DataFrame:
    """(id, label, v): one row an id, of the rows that take part; ``v`` as whole numbers."""
    v = F.col(f"`{vector}`").cast("array<double>")
    chosen = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = chosen.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(sound)
    whole = rows.select("id", F.struct("label", F.transform("v", lambda x: F.floor(x * SCALE)).alias("v")).alias("row"))
    rows = staged(whole.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v"), "negatives-rows")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))


def varying(rows: DataFrame, n: int) -> list[int]:
    """The n coordinates of largest variance."""
    spread = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("spread"))
    return [r["at"] for r in spread.orderBy(F.desc("spread"), "at").limit(n).collect()]


def cut(rows: DataFrame, n: int) -> DataFrame:
    """With ``node``, the place of a row in the upper levels of the tree: at each level all
    nodes are cut into CUTS parts of about equal size along one coordinate."""
    levels = max(0, ceil(log(max(1, n / TILE_ROWS)) / log(CUTS) - 1e-9))
    shares = [(i + 1) / CUTS for i in range(CUTS - 1)]
    out = rows.withColumn("node", F.lit(0).cast("long"))
    for at in varying(rows, levels) if levels else []:
        x = F.col("v")[at]
        ends = out.groupBy("node").agg(F.percentile_approx(x, shares, ACCURACY).alias("ends"))
        part = F.size(F.filter("ends", lambda end: end < x))
        out = staged(attach(out, ends, "node", F.col("id")).withColumn("node", F.col("node") * CUTS + part).drop("ends"), "negatives-cut")
    return out


def chopped(rows: DataFrame, name: str, most: int) -> DataFrame:
    """With the column ``name``: nodes of more than ``most`` rows (equal along what they were
    cut by) are dealt into several by a hash."""
    sizes = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("pieces"))
    piece = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("pieces"))
    return attach(rows, sizes, "node", F.col("id")).withColumn(name, F.xxhash64("node", piece)).drop("pieces")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of whole numbers."""
    flat = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1 if len(flat) else 0)


def boxes(rows: DataFrame, key: str) -> DataFrame:
    """(key, low, high): the minimum bounding box of each key's rows, as doubles."""

    def run(table: pa.Table) -> pa.Table:
        x = matrix(table.column("v")).astype(np.float64)
        return pa.table({key: table.column(key)[:1], "low": [x.min(axis=0).tolist()], "high": [x.max(axis=0).tolist()]}, schema=schema)

    schema = pa.schema([(key, pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
    return rows.select(key, "v").groupBy(key).applyInArrow(run, f"{key} long, low array<double>, high array<double>")


def tiled(x: np.ndarray, axes: list[int], size: int, at: np.ndarray | None = None) -> np.ndarray:
    """Rows of ``x`` in sort-tile-recursive order: sorted by the first axis into slabs of whole
    leaves of ``size`` rows, each slab tiled by the other axes."""
    at = np.arange(len(x)) if at is None else at
    at = at[np.argsort(x[at, axes[0]], kind="stable")]
    leaves = ceil(len(at) / size)
    if len(axes) == 1 or leaves <= 1:
        return at
    slab = size * ceil(leaves / ceil(leaves ** (1 / len(axes))))
    return np.concatenate([tiled(x, axes[1:], size, at[i : i + slab]) for i in range(0, len(at), slab)])


class Tree:
    """An R-tree packed over one tile."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        axes = np.argsort(-x.astype(np.float64).var(axis=0), kind="stable")[:2].tolist() if x.shape[1] else []
        order = tiled(x, axes, LEAF_ROWS) if axes else np.arange(len(x))
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.largest = float(np.abs(x.astype(np.float64)).max(initial=0))
        starts = np.arange(0, len(x), LEAF_ROWS)
        low, high = np.minimum.reduceat(self.x, starts, axis=0), np.maximum.reduceat(self.x, starts, axis=0)
        self.levels = [(low, high)]  # from the leaves up to the root
        while len(low) > 1:
            starts = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)
            self.levels.append((low, high))
        self.kind: type | None = None

    def hold(self, kind: type) -> None:
        """Numbers as doubles where these are exact, else as Python's whole numbers."""
        if kind is not self.kind:
            self.kind, self.rows = kind, self.x.astype(kind)
            self.held = [(low.astype(kind), high.astype(kind)) for low, high in self.levels]

    def search(self, anchor: int, q: np.ndarray, fits: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window [lowest, highest] the (scores, ids) of the k best rows in it, of
        those that ``fits`` (a mask of the tile's rows) and are not the anchor."""
        self.hold(np.float64 if self.largest * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, len(q)) < EXACT else object)
        q = q.astype(self.kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        interval = lambda low, high: (low @ up + high @ down, high @ up + low @ down)
        lowest, highest = [w[0] for w in windows], [w[1] for w in windows]
        best = [(np.zeros(0, self.kind), np.zeros(0, np.int64)) for _ in windows]
        queue: list[tuple] = []

        def push(level: int, first: int, last: int) -> None:
            least, most = interval(*(b[first:last] for b in self.held[level]))
            for i, (a, b) in enumerate(zip(least.tolist(), most.tolist()), first):
                if any(b >= x and a <= y for x, y in zip(lowest, highest)):
                    heapq.heappush(queue, (-b, level, i))

        push(len(self.held) - 1, 0, 1)
        while queue and -queue[0][0] >= min(lowest):
            _, level, i = heapq.heappop(queue)
            if level:
                push(level - 1, i * FAN, min((i + 1) * FAN, len(self.held[level - 1][0])))
                continue
            part = slice(i * LEAF_ROWS, (i + 1) * LEAF_ROWS)
            scores = self.rows[part] @ q
            usable = fits[part] & (self.ids[part] != anchor)
            for w in range(len(windows)):
                at = np.flatnonzero(usable & (scores >= lowest[w]) & (scores <= highest[w]))
                if not len(at):
                    continue
                s, ids = np.concatenate([best[w][0], scores[at]]), np.concatenate([best[w][1], self.ids[part][at]])
                order = np.lexsort((ids, -s))[:k]
                best[w] = s[order], ids[order]
                if len(order) == k:
                    lowest[w] = max(lowest[w], int(s[order[-1]]))
        return best


ANSWER = "anchor long, window long, id long, score long"


def _meet(pairs: DataFrame, questions: DataFrame, rows: DataFrame, n_blocks: int, same: bool, k: int) -> DataFrame:
    """Answers of each pair's questions from the pair's tile."""
    parts = max(1, ceil(n_blocks / MEET))
    dealt = pairs.select("block", "tile", F.pmod(F.xxhash64(F.lit(2), "block"), F.lit(parts)).alias("part"))
    left = rows.select("tile", "id", "label", "v").join(dealt.select("tile", "part").distinct(), "tile")
    right = questions.join(dealt, "block").select(F.col("tile").alias("near"), F.col("part").alias("of"), "anchor", "window", "label", "v", "lowest", "highest")

    def run(stored: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if stored.num_rows and asked.num_rows:
            number = lambda t, c: t.column(c).to_numpy()
            tree = Tree(number(stored, "id"), number(stored, "label"), matrix(stored.column("v")))
            fitting = {x: (tree.labels == x) if same else (tree.labels != x) for x in np.unique(number(asked, "label")).tolist()}
            anchors, window, label, q = number(asked, "anchor"), number(asked, "window"), number(asked, "label"), matrix(asked.column("v"))
            lowest, highest = number(asked, "lowest").tolist(), number(asked, "highest").tolist()
            order = np.argsort(anchors, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(anchors[order])) + 1):
                anchor = int(anchors[at[0]])
                found = tree.search(anchor, q[at[0]], fitting[int(label[at[0]])], [(lowest[i], highest[i]) for i in at], k)
                out += [(np.full(len(ids), anchor), np.full(len(ids), window[i]), ids, np.array([max(LEAST, min(MOST, int(x))) for x in s], np.int64)) for i, (s, ids) in zip(at, found)]
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(4)]
        return pa.table(dict(zip(("anchor", "window", "id", "score"), columns)))

    return left.groupBy("tile", "part").cogroup(right.groupBy("near", "of")).applyInArrow(run, ANSWER)


def _reach(block: DataFrame, tile: DataFrame) -> DataFrame:
    """(block, tile, least, most): the interval of all scores of a block's anchors with a
    tile's rows. Boxes meet boxes bucket by bucket; no row of the tables is among them."""
    buckets = 16
    left = block.select("block", F.col("low").alias("a"), F.col("high").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    right = tile.select("tile", F.col("low").alias("c"), F.col("high").alias("d"), F.pmod("tile", F.lit(buckets)).cast("int").alias("bucket"))
    corners = F.transform(F.arrays_zip("a", "b", "c", "d"), lambda x: F.array(x["a"] * x["c"], x["a"] * x["d"], x["b"] * x["c"], x["b"] * x["d"]))
    total = lambda ends: F.aggregate(F.transform("corners", ends), F.lit(0.0), lambda s, x: s + x)
    met = left.join(right, "bucket").withColumn("corners", corners)
    # wider by what rounding may take off
    slack = F.aggregate(F.transform("corners", lambda x: F.array_max(F.transform(x, F.abs))), F.lit(0.0), lambda s, x: s + x) * 1e-12
    return met.select("block", "tile", (total(F.array_min) - slack).alias("least"), (total(F.array_max) + slack).alias("most"))


def best_in_windows(questions: DataFrame, rows: DataFrame, reach: DataFrame, n_blocks: int, same: bool, k: int) -> DataFrame:
    """The k best rows of each question (anchor, window, label, v, lowest, highest, block),
    of the anchor's own label or (``same`` false) of others."""
    top = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)

    def reached(asked: DataFrame) -> DataFrame:
        ends = asked.groupBy("block").agg(F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
        return reach.join(ends, "block").filter((F.col("most") >= F.col("lowest")) & (F.col("least") <= F.col("highest")))

    rank = F.row_number().over(W.partitionBy("block").orderBy(F.desc("most"), "tile"))
    first = staged(reached(questions).withColumn("place", rank).filter(F.col("place") <= FIRST).select("block", "tile"), "negatives-first")
    found = staged(top(_meet(first, questions, rows, n_blocks, same, k)), "negatives-found")
    kth = found.filter(F.col("rank") == k).select("anchor", "window", F.col("score").alias("kth"))
    raised = staged(questions.join(kth, ["anchor", "window"], "left").withColumn("lowest", F.greatest("lowest", "kth")).drop("kth"), "negatives-raised")
    rest = reached(raised).join(first, ["block", "tile"], "left_anti")
    more = _meet(staged(rest.select("block", "tile"), "negatives-rest"), raised, rows, n_blocks, same, k)
    return top(found.drop("rank").unionByName(more))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row
    for which ``is_anchor`` (over ``id``) holds and each of its best ``positives`` rows of equal
    label, the best ``negatives`` rows of other labels whose score is at most the positive's
    and at least 1 - 1/PART of it."""
    rows = scaled(vectors, id_col, label, vector)
    rows = staged(cut(rows, rows.count()), "negatives-nodes")
    copies = F.row_number().over(W.partitionBy("label", "v").orderBy("id"))
    stored = rows.withColumn("copy", copies).filter(F.col("copy") <= max(positives + 1, negatives)).drop("copy")
    stored = staged(chopped(stored, "tile", TILE_ROWS), "negatives-tiles")
    anchors = staged(chopped(rows.filter(is_anchor), "block", BLOCK).select("block", F.col("id").alias("anchor"), "label", "v"), "negatives-anchors")
    block_boxes = staged(boxes(anchors, "block"), "negatives-blocks")
    reach = staged(_reach(block_boxes, boxes(stored, "tile")), "negatives-reach")
    n_blocks = block_boxes.count()
    whole = [F.lit(x).cast("long").alias(c) for x, c in ((0, "window"), (LEAST, "lowest"), (MOST, "highest"))]
    liked = staged(best_in_windows(anchors.select("*", *whole), stored, reach, n_blocks, True, positives), "negatives-positives")
    # a window is named after its positive; below 0 the share of a score is above it
    windows = liked.filter("score >= 0").select("anchor", F.col("id").alias("window"), F.expr(f"score - score div {PART}").alias("lowest"), F.col("score").alias("highest"))
    questions = staged(windows.join(anchors, "anchor"), "negatives-questions")
    hard = best_in_windows(questions, stored, reach, n_blocks, False, negatives)
    scores = liked.select("anchor", F.col("id").alias("window"), F.col("score").alias("positive_score"))
    return hard.join(scores, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), F.col("window").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
