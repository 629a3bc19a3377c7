"""python -m quillon list | run QUERY FOLDER OUT: the queries from the command line."""

from __future__ import annotations

import argparse

from quillon.plans import catalog


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon", description="Runs queries over a folder of Parquet tables.")
    todo = parser.add_subparsers(dest="todo", required=True)
    todo.add_parser("list", help="names of all queries")
    one = todo.add_parser("run", help="writes a query's rows as Parquet")
    one.add_argument("query")
    one.add_argument("folder", help="folder of the tables")
    one.add_argument("out", help="folder to write to")
    given = parser.parse_args(argv)
    if given.todo == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    if given.query not in catalog.queries():
        parser.error(f"unknown query: {given.query}")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(given.query).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog.queries()[given.query](spark, given.folder).write.mode("overwrite").parquet(given.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
