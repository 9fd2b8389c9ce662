"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta.llm import hard_negatives as hn
from retenta.llm.queries import op12_hard_negatives

SF01 = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, step=100, k=5):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * float(np.float32(x))))) for x in v]
        if i not in best or (label, whole) < best[i]:
            best[i] = (label, whole)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for anchor in (i for i in best if i % step == 0):
        label, q = best[anchor]
        scores = sorted((-score(q, v), i, other == label) for i, (other, v) in best.items() if i != anchor)
        for s, positive, _ in [x for x in scores if x[2]][:k]:
            hard = [x for x in scores if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out |= {(anchor, positive, n, i, -s, -t) for n, (t, i, _) in enumerate(hard, 1)}
    return out


def mined(frame, step=100):
    rows = [tuple(r) for r in hn.mine(frame, F.col("id") % step == 0).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def clustered(seed, n=900, dims=12, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    at = rng.integers(0, clusters, n)
    x = (centres[at] + 0.3 * rng.normal(size=(n, dims))).astype(np.float32)
    return [(i, x[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("tile, leaf, block, meet, first", [(8192, 256, 512, 8, 2), (64, 8, 3, 1, 1), (30, 5, 2, 2, 2)])
def test_mining_equals_brute_force(spark, monkeypatch, tile, leaf, block, meet, first):
    for name, value in (("TILE_ROWS", tile), ("LEAF_ROWS", leaf), ("FAN", 3), ("BLOCK", block), ("MEET", meet), ("FIRST", first)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(tile)
    odd = [(5000, None, 1), (5001, [0.1] * 12, None), (5002, [float("nan")] + [0.1] * 11, 1), (5003, [None] + [0.1] * 11, 1), (None, [0.2] * 12, 1)]
    odd += [(5100, [0.5, 0.5], 1), (5200, [], 2), (5300, [0.0] * 12, 3), (100, [9.0] * 12, 0), (5004, [float("inf")] * 12, 1)] + rows[:30]
    rows = rows + odd
    frame = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA + ", id int, tile int").repartition(3)
    assert mined(frame) == brute(rows)


def test_copies_by_the_thousand(spark, monkeypatch):
    """A vector that a third of all rows share, under two labels."""
    monkeypatch.setattr(hn, "TILE_ROWS", 64)
    monkeypatch.setattr(hn, "LEAF_ROWS", 16)
    rows = clustered(9, n=1200)
    rows = [(i, [0.25] * 12 if i % 3 == 0 else v, (i // 3) % 2 if i % 3 == 0 else label) for i, v, label in rows]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_huge_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1e5, -3e6, 2.5e6, 0.3, 7.0]) * rng.random() for _ in range(4)], i % 3) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert mined(frame, 10) == brute(rows, 10)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == set()
    assert mined(spark.createDataFrame([(1, [0.5], 1), (2, [0.25], 2)], SCHEMA)) == set()
    assert mined(spark.createDataFrame([(0, [0.5], 1)], SCHEMA)) == set()


def test_query_at_small_scale(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert {tuple(r) for r in op12_hard_negatives(spark, SF01).collect()} == brute(rows)


def test_pruning_leaves_most_of_a_clustered_tile_unread():
    """The queue reads few leaves where vectors lie in groups, and the answer is the same."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, size=(40, 3))
    x = np.concatenate([c + rng.integers(-20, 20, size=(200, 3)) for c in centres])
    ids, labels = np.arange(len(x)), rng.integers(0, 3, len(x))
    tree = hn.Tree(ids, labels, x)
    reads = []
    plain = tree.search(-1, centres[0], tree.labels >= 0, [(hn.LEAST, hn.MOST)], 5)
    tree.rows = type("Counted", (), {"__getitem__": lambda self, part, rows=tree.rows: (reads.append(part), rows[part])[1]})()
    again = tree.search(-1, centres[0], tree.labels >= 0, [(hn.LEAST, hn.MOST)], 5)
    scores = x @ centres[0]
    order = np.lexsort((ids, -scores))[:5]
    for s, i in (plain[0], again[0]):
        assert s.tolist() == scores[order].tolist() and i.tolist() == ids[order].tolist()
    assert len(reads) <= 0.4 * -(-len(x) // hn.LEAF_ROWS)
