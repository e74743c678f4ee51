"""Command line: ``python -m quernstone list`` and ``python -m quernstone run QUERY --data FOLDER --out FOLDER``.

Exit codes: 0 done, 1 the query failed, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None, queries: dict | None = None) -> int:
    """Over the core's queries, or those that are given."""
    parser = argparse.ArgumentParser(prog="quernstone", description="Run a query over a folder of parquet tables.")
    todo = parser.add_subparsers(dest="todo", required=True)
    todo.add_parser("list", help="names of all queries")
    run = todo.add_parser("run", help="run a query and write its rows as parquet")
    run.add_argument("query")
    run.add_argument("--data", required=True)
    run.add_argument("--out", required=True)
    try:
        given = parser.parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    if queries is None:
        from quernstone.plans import catalog

        queries = catalog.QUERIES
    if given.todo == "list":
        print("\n".join(sorted(queries)))
        return 0
    if given.query not in queries:
        print(f"no query is called {given.query}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from quernstone.runtime import release

    spark = SparkSession.builder.appName(f"quernstone {given.query}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        queries[given.query](spark, given.data).write.mode("overwrite").parquet(given.out)
    except Exception as e:
        print(f"{given.query} failed: {e}", file=sys.stderr)
        return 1
    finally:
        release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
