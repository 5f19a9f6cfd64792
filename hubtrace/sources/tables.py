"""Named tables: alias -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession


class Tables(Mapping[str, DataFrame]):
    """Tables that are opened when they are first asked for."""

    def __init__(self, openers: Mapping[str, Callable[[], DataFrame]]):
        self._openers = dict(openers)
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self._openers[name]()
        return self._open[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._openers)

    def __len__(self) -> int:
        return len(self._openers)


def load_tables(
    spark: SparkSession,
    base: str,
    names: Iterable[str],
    suffix: str = ".parquet",
    schemas: Mapping[str, str] | None = None,
) -> Tables:
    """Parquet tables ``base/name + suffix``; a directory of parts or a single file.

    ``suffix=""`` reads what ``export_tables`` writes. A table with a known schema
    (a DDL string) is opened without looking into its files.
    """
    known = schemas or {}

    def read(name: str) -> DataFrame:
        reader = spark.read.schema(known[name]) if name in known else spark.read
        return reader.parquet(f"{base.rstrip('/')}/{name}{suffix}")

    return Tables({n: partial(read, n) for n in names})


def catalog_tables(spark: SparkSession, paths: Mapping[str, str]) -> Tables:
    """Catalog tables by alias, e.g. ``{"incident": "models.incident"}``."""
    return Tables({alias: partial(spark.table, path) for alias, path in paths.items()})
