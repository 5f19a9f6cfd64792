"""Incident queries on a star with a hot key and with incident ids that occur at many places.

    python benchmarks/hot_star.py FOLDER [QUERY ...] [--times N]

Writes role tables below FOLDER if they are not there: one key holds a third of all rows, and 2 % of the incident rows
share 100 x N ids. N = 1: 3 million log rows, 300,000 incidents, 2,000 keys, 3,000 vendors; N multiplies all of it.
Prints seconds of single runs, and of the whole suite with and without shared event sites.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from hubtrace.plans.incidents import INCIDENT, INCIDENT_QUERIES, LOGGED, OBSERVED, OCCURRED  # noqa: E402
from hubtrace.plans.construction import KEY  # noqa: E402
from hubtrace.plans.suite import run_suite, with_kept_incidents  # noqa: E402
from hubtrace.sources import load_tables  # noqa: E402


def pick(seed: int, many: int):
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(many))


def rows(spark: SparkSession, seed: int, many: int, keys: int) -> DataFrame:
    hot = pick(seed, 3) == 0
    return spark.range(many).select(
        "id", F.when(hot, F.lit(0)).otherwise(pick(seed + 1, keys)).alias(KEY),
        F.date_add(F.lit("2022-01-01").cast("date"), pick(seed + 2, 730).cast("int")).alias("day"),
    )


def tables(spark: SparkSession, n: int) -> dict[str, DataFrame]:
    keys = 2_000 * n
    logs = rows(spark, 10, 3_000_000 * n, keys)
    seen = rows(spark, 20, 300_000 * n, keys)
    found = rows(spark, 30, 300_000 * n, keys)
    shared = F.concat(F.lit("shared"), pick(33, 100 * n).cast("string"))
    history = rows(spark, 40, 200_000 * n, keys)
    level = lambda seed, names: F.element_at(F.array(*map(F.lit, names)), (pick(seed, len(names)) + 1).cast("int"))
    return {
        "hub": spark.range(keys).select(F.col("id").alias(KEY)),
        "project_daily": history.select(
            KEY, F.col("day").alias("dt_fact"), level(41, "ABCDE").alias("cat_market_sector"),
            level(42, "XYZ").alias("cat_phase"), level(43, "NS").alias("cat_region"),
            (pick(44, 2000) * 100_000).cast("double").alias("amt_contract"),
        ),
        "incident": found.select(
            F.when(pick(34, 50) == 0, shared).otherwise(F.concat(F.lit("i"), F.col("id").cast("string"))).alias(INCIDENT),
            KEY, F.col("day").alias(OCCURRED), level(35, "ab").alias("cat_incident_type"),
            level(36, "cd").alias("cat_osha_status"), (pick(37, 2) == 0).alias("is_trir"), (pick(38, 9) == 0).alias("is_ltir"),
        ),
        "site_log": logs.select(
            KEY, F.col("day").alias(LOGGED), F.concat(F.lit("t"), pick(13, 40).cast("string")).alias("cat_trade"),
            F.concat(F.lit("v"), pick(14, 3_000 * n).cast("string")).alias("ids_vendor"),
            pick(15, 50).cast("decimal(18,2)").alias("n_workers_total"),
        ),
        "observation": seen.select(
            F.col("id").alias("ids_observation"), KEY, F.col("day").alias(OBSERVED), level(23, "lmh").alias("cat_severity"),
            (pick(24, 2) == 0).alias("is_overdue"), pick(25, 30).cast("double").alias("amt_days_to_close_actual"),
        ),
        "task_update": rows(spark, 50, 300_000 * n, keys).select(
            KEY, F.col("day").alias("dt_effective_from"), (pick(53, 40) - 20).cast("double").alias("amt_float"),
            (pick(54, 3) > 0).alias("is_active_record"),
        ),
        "timecard": rows(spark, 60, 300_000 * n, keys).select(KEY, F.col("day").alias("dt_item_date")),
    }


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("folder")
    args.add_argument("--times", type=int, default=1)
    args.add_argument("queries", nargs="*")
    args = args.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.local.dir", f"{args.folder}/local")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made = tables(spark, args.times)
    for name, df in made.items():
        if not os.path.exists(f"{args.folder}/{name}/_SUCCESS"):
            df.write.parquet(f"{args.folder}/{name}")
    star = load_tables(spark, args.folder, list(made), suffix="")
    names = args.queries or [*INCIDENT_QUERIES, "suite", "suite_shared"]
    for name in names:
        start = time.perf_counter()
        if name in ("suite", "suite_shared"):
            used = with_kept_incidents(spark, star) if name == "suite_shared" else star
            done = run_suite(spark, {n: (lambda q=q: q(used)) for n, q in INCIDENT_QUERIES.items()})
            assert all(r["status"] == "ok" for r in done.collect()), done.collect()
        else:
            INCIDENT_QUERIES[name](star).write.format("noop").mode("overwrite").save()
        print(f"{name:45s} {time.perf_counter() - start:8.1f}", flush=True)


if __name__ == "__main__":
    main()
