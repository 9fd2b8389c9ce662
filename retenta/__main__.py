"""Command line: list or run the registered queries.

    python -m retenta list
    python -m retenta run high_risk_page --sf /root/testdata/sf0.1 --show 15
    python -m retenta run state_map --sf /root/testdata/sf0.1 --out /tmp/state_map --format json
    python -m retenta train --sf /root/testdata/sf0.01 --out retenta/models/churn_trees.json

``run`` writes the whole result with the Spark writer (null stays null) when
``--out`` is given, and prints the first ``--show`` rows otherwise. ``train`` fits the churn
model on the clients of ``--sf`` that aren't held out and stores its trees as JSON.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="retenta")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="print the registered query names")
    run = sub.add_parser("run", help="run one registered query")
    run.add_argument("query")
    run.add_argument("--sf", default="/root/testdata/sf0.01", help="folder with the input tables")
    run.add_argument("--out", help="write the result here instead of printing it")
    run.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    run.add_argument("--show", type=int, default=20)
    train = sub.add_parser("train", help="fit the churn model and store its trees")
    train.add_argument("--sf", default="/root/testdata/sf0.01", help="folder with the input tables")
    train.add_argument("--out", required=True, help="the JSON file to write")
    args = parser.parse_args(argv)

    from .plans.catalog import QUERIES

    if args.command == "list":
        for name in QUERIES:
            print(name)
        return 0
    if args.command == "train":
        from .operators import trees
        from .plans.catalog import trained
        from .session import build_session

        _, fitted, feats, auc = trained(build_session(), args.sf, numbers_only=True)
        with open(args.out, "w") as f:
            f.write(trees.from_pipeline(fitted, [name for name, _ in feats]).to_json())
        print(f"{args.out}: held-out AUC {auc:.3f}")
        return 0
    if args.query not in QUERIES:
        parser.error(f"unknown query {args.query!r}; see 'list'")
    from .session import build_session
    from .sources.readers import write_records

    spark = build_session()
    df = QUERIES[args.query](spark, args.sf)
    if args.out:
        write_records(df, args.out, fmt=args.format)
        print(args.out)
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
