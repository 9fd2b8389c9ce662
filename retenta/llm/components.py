"""Connected components over an edge table, by smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retenta.llm.staging import attach, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that can
    be reached. Each round takes the smallest label of the neighbours (summed up before the
    shuffle), then the label's own label, so paths halve; it ends when none changes. Nodes
    with very many edges, and labels of very many nodes, are salted in both joins."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    labels = staged(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "component-labels")
    while True:
        sent = attach(both.withColumnRenamed("a", "node"), labels, "node", F.col("b"))
        near = sent.groupBy(F.col("b").alias("node")).agg(F.min("root").alias("near"))
        closer = staged(labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("by")), "component-closer")
        of_label = closer.select(F.col("node").alias("by"), F.col("by").alias("root"))
        moved = staged(attach(closer, of_label, "by", F.col("node")).select("node", "was", "root"), "component-labels")
        labels = moved.select("node", "root")
        if moved.filter("was <> root").isEmpty():
            return labels
