"""Semantic column types: what a column means decides how it is typed and profiled."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The semantic types and the name prefixes that announce them.
SEMANTIC_TYPES = ("ID", "categorical", "multicategorical", "numerical", "text", "timestamp")
PREFIXES = {
    "ids": "ID",
    "id": "ID",
    "is": "categorical",
    "cat": "categorical",
    "amt": "numerical",
    "val": "numerical",
    "n": "numerical",
    "str": "text",
    "dt": "timestamp",
}
# Columns named outside the prefixes.
WHOLE_NAMES = {"pkey_columns": "multicategorical", "project_key": "ID"}

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class TableSpec:
    """What is known about a table beyond its column types.

    ``semantic`` overrides the naming rule; ``unprofiled`` columns are left out of
    the category and number profiles. A primary key is not assumed to be unique.
    """

    primary_key: str | None = None
    foreign_keys: Mapping[str, str] = field(default_factory=dict)
    time_col: str | None = None
    end_time_col: str | None = None
    semantic: Mapping[str, str] = field(default_factory=dict)
    unprofiled: frozenset[str] = frozenset()


def semantic_type(name: str, dtype: T.DataType, spec: TableSpec = TableSpec()) -> str:
    """Meaning of a column: override, then whole name, then prefix, then data type."""
    if name in spec.semantic:
        return spec.semantic[name]
    if name in WHOLE_NAMES:
        return WHOLE_NAMES[name]
    prefix = name.split("_", 1)[0] if "_" in name else ""
    if prefix in PREFIXES:
        return PREFIXES[prefix]
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "numerical" if isinstance(dtype, T.NumericType) else "categorical"


def ingested_type(stype: str, dtype: T.DataType) -> T.DataType:
    """Type a column is stored as, given its meaning and its source type."""
    if stype == "timestamp":
        return T.TimestampNTZType()
    if isinstance(dtype, _INTEGRAL):
        return T.LongType()
    if stype == "numerical":
        return T.DoubleType()
    if stype != "ID" and isinstance(dtype, T.BooleanType):
        return T.BooleanType()
    return T.StringType()


def annotate(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """The same data with ``semantic_type`` in the metadata of every column."""
    columns = []
    for f in df.schema.fields:
        meta = {**(f.metadata or {}), "semantic_type": semantic_type(f.name, f.dataType, spec)}
        columns.append(F.col(f"`{f.name}`").alias(f.name, metadata=meta))
    return df.select(*columns)


def conform(df: DataFrame, spec: TableSpec = TableSpec()) -> DataFrame:
    """Cast every column to its ingested type."""
    return df.select(
        *[
            F.col(f"`{f.name}`")
            .cast(ingested_type(semantic_type(f.name, f.dataType, spec), f.dataType))
            .alias(f.name)
            for f in df.schema.fields
        ]
    )


def _role(name: str, spec: TableSpec) -> str:
    if name == spec.primary_key:
        return "primary_key"
    if name in spec.foreign_keys:
        return "foreign_key"
    if name == spec.time_col:
        return "time"
    return "end_time" if name == spec.end_time_col else "feature"


def feature_columns(df: DataFrame, spec: TableSpec) -> list[str]:
    """Columns that are neither key nor time."""
    return [c for c in df.columns if _role(c, spec) == "feature"]


def categorical_columns(df: DataFrame, spec: TableSpec) -> list[str]:
    """Columns for ``categorical_profile``."""
    return _of_type(df, spec, "categorical")


def numeric_columns(df: DataFrame, spec: TableSpec) -> list[str]:
    """Columns for ``numeric_profile``."""
    return _of_type(df, spec, "numerical")


def _of_type(df: DataFrame, spec: TableSpec, stype: str) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if semantic_type(f.name, f.dataType, spec) == stype and f.name not in spec.unprofiled
    ]


def describe_columns(
    tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]
) -> DataFrame:
    """Every column with its meaning, source type, stored type and role."""

    def lines(name: str, df: DataFrame) -> DataFrame:
        spec = specs.get(name, TableSpec())
        rows = []
        for i, f in enumerate(df.schema.fields, start=1):
            stype = semantic_type(f.name, f.dataType, spec)
            texts = {
                "column": f.name,
                "semantic_type": stype,
                "source_type": f.dataType.simpleString(),
                "ingested_type": ingested_type(stype, f.dataType).simpleString(),
                "role": _role(f.name, spec),
                "references": spec.foreign_keys.get(f.name),
            }
            rows.append(
                F.struct(
                    F.lit(i).alias("ordinal"),
                    *[F.lit(v).cast("string").alias(k) for k, v in texts.items()],
                )
            )
        one = df.sparkSession.range(1).select(F.lit(name).alias("table"), F.array(*rows).alias("r"))
        return one.select("table", F.inline("r"))

    return reduce(DataFrame.unionByName, [lines(n, d) for n, d in tables.items()])
