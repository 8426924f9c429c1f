"""Command line: list queries, run one to Parquet, show its plan, or print its first rows.

    python -m strata list
    python -m strata run geometry_ratios --data /data/sf1 --out /data/out/geometry
    python -m strata explain similarity_pairs --data /data/sf1
    python -m strata show data_summary --data /data/sf1
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from strata.plans import registry
from strata.sources import results


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strata", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("action", choices=["list", "run", "explain", "show"])
    parser.add_argument("query", nargs="*")
    parser.add_argument("--data", help="folder of the tables")
    parser.add_argument("--out", help="folder for results")
    parser.add_argument("--overwrite", action="store_true", help="replace a result that is there")
    parser.add_argument("--revision", default="", help="noted with the result")
    given = parser.parse_args(arguments)
    queries = registry.queries()
    if given.action == "list":
        for name in sorted(queries):
            print(name, "" if name in registry.oracle_sql() else "(no SQL twin)")
        return
    if unknown := [q for q in given.query if q not in queries]:
        parser.error(f"unknown queries: {', '.join(unknown)}")
    if not given.query or not given.data or given.action == "run" and not given.out:
        parser.error("name a query, --data and, to run, --out")
    spark = SparkSession.builder.getOrCreate()
    for name in given.query:
        df = queries[name](spark, given.data)
        if given.action == "explain":
            df.explain("formatted")
        elif given.action == "show":
            print(results.to_markdown(df.limit(50)))
        elif results.exists(spark, f"{given.out}/{name}") and not given.overwrite:
            parser.error(f"{given.out}/{name} is there; --overwrite replaces it")
        else:
            results.write_result(df, given.out, name, config=given.data, revision=given.revision)


if __name__ == "__main__":
    main()
