"""Table, category and number profiles. Each reads a table once or a few times,
never once per column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubtrace.functions import text_of
from hubtrace.operators.percentiles import (
    PERCENTILES,
    distributions,
    long_numbers,
    percentile_name,
)


def table_stats(
    tables: Mapping[str, DataFrame], key: str, time_cols: Mapping[str, str]
) -> DataFrame:
    """Rows, distinct keys and date range of every table, one scan each.

    Tables without the key or without a time column show NULL there.
    """

    def stats(name: str, df: DataFrame) -> DataFrame:
        time = time_cols.get(name)
        nothing = F.lit(None)
        keys = F.countDistinct(key) if key in df.columns else nothing.cast("bigint")
        day = F.col(time).cast("date") if time else None
        return df.agg(
            F.count("*").alias("row_count"),
            keys.alias("distinct_keys"),
            (F.min(day) if time else nothing.cast("date")).alias("min_time"),
            (F.max(day) if time else nothing.cast("date")).alias("max_time"),
        ).select(
            F.lit(name).alias("table"),
            "row_count",
            "distinct_keys",
            F.lit(time).cast("string").alias("time_col"),
            "min_time",
            "max_time",
        )

    return reduce(DataFrame.unionByName, [stats(n, d) for n, d in tables.items()])


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column name, type and comment of every table, next to its row count."""

    def columns(name: str, df: DataFrame) -> DataFrame:
        lines = [
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit((f.metadata or {}).get("comment")).cast("string").alias("comment"),
            )
            for i, f in enumerate(df.schema.fields, start=1)
        ]
        counted = df.agg(F.count("*").alias("row_count"))
        return counted.select(
            F.lit(name).alias("table"), "row_count", F.inline(F.array(*lines))
        ).select("table", "ordinal", "column", "type", "comment", "row_count")

    return reduce(DataFrame.unionByName, [columns(n, d) for n, d in tables.items()])


def categorical_profile(df: DataFrame, cols: Sequence[str], k: int = 100) -> DataFrame:
    """The ``k`` most frequent values of each column as text; NULL is a value too.

    One scan turns all columns to (column, value) and counts them together.
    Before ranking, every task keeps only its own best ``k`` per column, so a
    column with very many values never gathers in one place.
    """
    names = [F.col(f"`{c}`") for c in cols]
    cells = df.select(*[text_of(c).alias(n) for c, n in zip(names, cols)]).unpivot(
        [], names, "column", "value"
    )
    counts = cells.groupBy("column", "value").agg(F.count("*").alias("count"))
    best = Window.partitionBy("column").orderBy(
        F.desc("count"), F.asc_nulls_last("value")
    )
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def numeric_profile(
    df: DataFrame, cols: Sequence[str], accuracy: int | None = None
) -> DataFrame:
    """Count, NULLs, range, mean, sample deviation and percentiles per column.

    ``accuracy=None`` finds the percentiles exactly (see ``distributions``). A
    number uses Spark's approximate percentile with that accuracy instead: one
    scan for everything, but each task then ships a summary of up to ``accuracy``
    entries per column to a single merge.
    """
    if accuracy is None:
        return numeric_profiles({"": (df, cols)}).drop("table")
    cols = list(cols)
    measures = [F.count("*").alias("_rows")]
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        measures += [
            F.count(x).alias(f"_n{i}"),
            F.min(x).alias(f"_lo{i}"),
            F.max(x).alias(f"_hi{i}"),
            F.avg(x).alias(f"_mean{i}"),
            F.stddev_samp(x).alias(f"_std{i}"),
            F.percentile_approx(x, list(PERCENTILES), accuracy).alias(f"_p{i}"),
        ]
    lines = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"_n{i}").alias("count"),
            (F.col("_rows") - F.col(f"_n{i}")).alias("null_count"),
            F.col(f"_lo{i}").alias("min"),
            F.col(f"_hi{i}").alias("max"),
            F.col(f"_mean{i}").alias("mean"),
            F.col(f"_std{i}").alias("std"),
            *[
                F.get(f"_p{i}", j).alias(percentile_name(p))
                for j, p in enumerate(PERCENTILES)
            ],
        )
        for i, c in enumerate(cols)
    ]
    return df.agg(*measures).select(F.inline(F.array(*lines)))


def numeric_profiles(
    columns: Mapping[str, tuple[DataFrame, Sequence[str]]],
) -> DataFrame:
    """Exact ``numeric_profile`` of columns of several tables, in the same three scans."""
    series = ["table", "column"]
    parts, names = [], []
    for table, (df, cols) in columns.items():
        parts.append(long_numbers(df, cols).select(F.lit(table).alias("table"), "*"))
        names += [F.struct(F.lit(table).alias("table"), F.lit(c).alias("column")) for c in cols]
    long = reduce(DataFrame.unionByName, parts)
    found = distributions(long, series)
    # Columns of empty tables have no values to count and get their line here.
    every = long.sparkSession.range(1).select(F.inline(F.array(*names)))
    return every.join(found, series, "left").fillna(0, subset=["count", "null_count"])
