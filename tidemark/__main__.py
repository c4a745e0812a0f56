"""Runs a query over a folder of tables: ``python -m tidemark NAME --tables DIR --out DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemark.plans import queries
from tidemark.tables import scratch


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("name", choices=sorted(queries.QUERIES), metavar="NAME")
    parser.add_argument("--tables", required=True, help="folder of the Parquet tables")
    parser.add_argument("--out", required=True, help="folder of the result")
    parser.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"tidemark {given.name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with scratch(spark):
        result = queries.QUERIES[given.name](spark, given.tables)
        result.write.mode("overwrite").format(given.format).save(given.out)


if __name__ == "__main__":
    main()
