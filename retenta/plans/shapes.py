"""Physical plan shapes of the registered queries, as a Markdown table.

``python -m retenta.plans.shapes [sf_dir]`` plans every registered query with
automatic broadcasts switched off (the shape a query takes when its inputs are
far larger than any broadcast threshold) and counts the physical operators that
matter for scale: shuffles, join strategies, windows, group limits, top-k and
subqueries. Only explicitly broadcast inputs (fixed-size tables) stay broadcast.
"""

from __future__ import annotations

import sys

import re

# (column title, plan node prefix); a node counts once per plan line that starts with it
NODES = [
    ("hash shuffles", "Exchange hashpartitioning"),
    ("range shuffles", "Exchange rangepartitioning"),
    ("to one partition", "Exchange SinglePartition"),
    ("reused shuffles", "ReusedExchange"),
    ("sort-merge joins", "SortMergeJoin"),
    ("broadcast joins", "BroadcastHashJoin"),
    ("nested-loop joins", "BroadcastNestedLoopJoin"),
    ("windows", "Window ["),
    ("group limits", "WindowGroupLimit"),
    ("top-k", "TakeOrderedAndProject"),
    ("scalar subqueries", "Subquery scalar-subquery"),
    ("scans", "FileScan parquet"),
]
TREE = re.compile(r"^[\s:|+\-]*(\*\(\d+\)\s*)?")


def node_counts(plan: str) -> list[int]:
    names = [TREE.sub("", line) for line in plan.splitlines()]
    return [sum(1 for n in names if n.startswith(key)) for _, key in NODES]


def shapes(spark, sf_dir: str) -> str:
    from .catalog import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    head = "| query | " + " | ".join(n for n, _ in NODES) + " |"
    rule = "|---|" + "---|" * len(NODES)
    lines = [head, rule]
    for name, fn in QUERIES.items():
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        lines.append(f"| `{name}` | " + " | ".join(str(c) for c in node_counts(plan)) + " |")
    return "\n".join(lines)


def main() -> None:
    from ..session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    print(shapes(spark, sf_dir))
    spark.stop()


if __name__ == "__main__":
    main()
