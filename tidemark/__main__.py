"""``python -m tidemark RAW_FOLDER EMPLOYEES OUT_FOLDER [--raw-format csv] [--format csv]``

Runs the whole batch over raw tables and prints the rows saved per table. Use
``spark-submit`` to run it on a cluster.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemark.plans import catalogue
from tidemark.session import tune
from tidemark.sources import readers


def main() -> None:
    args = argparse.ArgumentParser(prog="tidemark")
    args.add_argument("raw_folder", help="holds customers, products, orders and order_items")
    args.add_argument("employees", help="the raw employee table")
    args.add_argument("out_folder")
    args.add_argument("--raw-format", default="csv")
    args.add_argument("--format", default="csv", help="format of the saved reports")
    given = args.parse_args()
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    tune(spark)
    saved = catalogue.run_all(
        spark,
        readers.read_sales(spark, given.raw_folder, given.raw_format),
        readers.read_employees(spark, given.employees, given.raw_format),
        given.out_folder.rstrip("/"),
        given.format,
    )
    for name, n in saved.items():
        print(f"{name:32s} {n:>12d} rows")


if __name__ == "__main__":
    main()
