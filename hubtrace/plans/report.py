"""Everything there is to know about a star, as one folder of JSON reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from hubtrace.operators import key_match, sample_for_keys, sample_rows, table_inventory, table_stats
from hubtrace.operators.keys import top_keys
from hubtrace.plans.construction import HUB, KEY, SPECS, TIME_COLS
from hubtrace.plans.incidents import INCIDENT_QUERIES
from hubtrace.plans.overview import profile_categories, profile_numbers
from hubtrace.plans.suite import Once, run_suite, with_kept_incidents


def write_report_set(
    spark: SparkSession, tables: Mapping[str, DataFrame], path: str, at_once: int = 4
) -> DataFrame:
    """Statistics, profiles, incident queries and samples; one status line per report.

    ``tables`` are the role tables at hand. Statistics, profiles and samples are made table by
    table, so one that cannot be read fails in its own lines alone, as does a query that needs it.
    """
    shared = with_kept_incidents(spark, tables)
    busiest = Once(lambda: _at_hand(top_keys(tables["incident"], KEY, 5)))
    named = {
        "key_match": lambda: key_match(tables[HUB], _facts(tables), KEY),
        "top_incident_projects": busiest,
    }
    for name, query in INCIDENT_QUERIES.items():
        named[name] = partial(query, shared)
    for name in tables:
        one = partial(_only, tables, name)
        named[f"table_stats_{name}"] = lambda one=one: table_stats(one(), KEY, TIME_COLS)
        named[f"table_inventory_{name}"] = lambda one=one: table_inventory(one())
        named[f"categorical_distributions_{name}"] = lambda one=one: profile_categories(one(), SPECS)
        named[f"numerical_distributions_{name}"] = lambda one=one: profile_numbers(one(), SPECS)
        named[f"sample_{name}"] = partial(_some_rows, tables, name)
        named[f"sample_top_projects_{name}"] = partial(_of_top_projects, tables, name, busiest)
    return run_suite(spark, named, path, at_once)


def _at_hand(df: DataFrame) -> DataFrame:
    """A table cut to a few rows, as a table of the driver."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _only(tables: Mapping[str, DataFrame], name: str) -> dict[str, DataFrame]:
    return {name: tables[name]}


def _facts(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {n: df for n, df in _readable(tables).items() if n != HUB and KEY in df.columns}


def _readable(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    opened = {}
    for name in tables:
        try:
            opened[name] = tables[name]
        except AnalysisException:
            continue
    return opened


def _some_rows(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    return sample_rows(tables[name], 20)


def _of_top_projects(tables: Mapping[str, DataFrame], name: str, busiest: Once) -> DataFrame:
    return sample_for_keys(tables[name], busiest(), KEY, 200)
