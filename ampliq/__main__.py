"""Command line: list the queries, or run one into a Parquet folder (ORC-03)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m ampliq")
    sub = ap.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the registered queries and the operators they cover")
    run = sub.add_parser("run", help="run one query over a folder of tables")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("output")
    a = ap.parse_args(argv)
    from .plans import REGISTRY
    if a.command == "list":
        for q in REGISTRY.values():
            print(f"{q.name}\t{' '.join(q.covers)}")
        return 0
    if a.query not in REGISTRY:
        ap.error(f"no query named {a.query}")
    spark = SparkSession.builder.appName(f"ampliq {a.query}").getOrCreate()
    REGISTRY[a.query].run(spark, a.tables).write.mode("overwrite").parquet(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
