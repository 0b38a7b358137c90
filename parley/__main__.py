"""Command line: list the queries, show a plan, or run one and write its rows.

python -m parley list | explain QUERY DIR | run QUERY DIR OUT [--format parquet|csv|json]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import registry


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="parley")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("explain", "run"):
        one = sub.add_parser(name)
        one.add_argument("query")
        one.add_argument("tables")
        if name == "run":
            one.add_argument("out")
            one.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    a = p.parse_args(args)
    queries, sql = registry.queries(), registry.oracle_sql()
    if a.command == "list":
        for name, f in sorted(queries.items()):
            print(f"{name}\t{'sql' if name in sql else '-'}\t{(f.__doc__ or '').strip().splitlines()[0]}")
        return 0
    if a.query not in queries:
        p.error(f"no query {a.query}")
    spark = SparkSession.builder.appName("parley").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = queries[a.query](spark, a.tables)
    if a.command == "explain":
        df.explain("formatted")
    else:
        df.write.mode("errorifexists").format(a.format).save(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
