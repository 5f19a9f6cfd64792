"""Profiles and samples over all tables of a star."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubtrace.operators import categorical_profile, numeric_profiles, sample_for_keys, top_keys
from hubtrace.sources.schema import TableSpec, categorical_columns, numeric_columns


Tables = Mapping[str, DataFrame]
Specs = Mapping[str, TableSpec]


def _chosen(tables: Tables, specs: Specs, columns_of) -> dict[str, tuple[DataFrame, list[str]]]:
    chosen = {n: (df, columns_of(df, specs.get(n, TableSpec()))) for n, df in tables.items()}
    return {n: (df, cols) for n, (df, cols) in chosen.items() if cols}


def profile_categories(tables: Tables, specs: Specs, k: int = 100) -> DataFrame:
    """Top ``k`` values of every categorical column of every table; no rows if there is none."""
    parts = [
        categorical_profile(df, cols, k).select(F.lit(name).alias("table"), "*")
        for name, (df, cols) in _chosen(tables, specs, categorical_columns).items()
    ]
    return reduce(DataFrame.unionByName, parts) if parts else _nothing(_CATEGORY_LINE)


def profile_numbers(tables: Tables, specs: Specs) -> DataFrame:
    """Distribution of every numerical column of every table; no rows if there is none."""
    chosen = _chosen(tables, specs, numeric_columns)
    return numeric_profiles(chosen) if chosen else _nothing(_NUMBER_LINE)


_CATEGORY_LINE = "table string, column string, value string, count bigint, rank int"
_NUMBER_LINE = (
    "table string, column string, count bigint, null_count bigint, min double, max double, "
    "mean double, std double, p25 double, p50 double, p75 double, p95 double, p99 double"
)


def _nothing(schema: str) -> DataFrame:
    return SparkSession.active().createDataFrame([], schema)


def sample_top_projects(
    tables: Tables, events: DataFrame, key: str,
    k: int = 5, n: int = 200, order: Mapping[str, list[str]] | None = None,
) -> dict[str, DataFrame]:
    """Rows of each table that belong to the ``k`` keys with most events."""
    busiest = top_keys(events, key, k)
    order = order or {}
    return {
        name: sample_for_keys(df, busiest, key, n, order.get(name, []))
        for name, df in tables.items()
        if key in df.columns
    }
