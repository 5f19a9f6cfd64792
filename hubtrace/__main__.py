"""``python -m hubtrace report|export TABLES OUT [ROLE ...]``

TABLES holds one Parquet table per role (``hub``, ``incident``, ...). ``report``
writes the JSON reports to OUT, ``export`` copies the tables there as typed parts.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from hubtrace.plans.construction import SPECS
from hubtrace.plans.report import write_report_set
from hubtrace.sources import export_tables, load_tables


def main() -> None:
    parser = argparse.ArgumentParser(prog="hubtrace")
    parser.add_argument("command", choices=["report", "export"])
    parser.add_argument("tables")
    parser.add_argument("out")
    parser.add_argument("roles", nargs="*")
    args = parser.parse_args()
    spark = (
        SparkSession.builder.appName("hubtrace").config("spark.ui.enabled", "false").getOrCreate()
    )
    tables = load_tables(spark, args.tables, args.roles or SPECS, suffix="")
    if args.command == "report":
        done = write_report_set(spark, tables, args.out)
    else:
        done = export_tables(spark, tables, args.out)
    done.show(len(tables) * 10 + 50, truncate=False)


if __name__ == "__main__":
    main()
