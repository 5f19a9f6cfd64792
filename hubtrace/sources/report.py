"""Results as JSON lines, written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write one JSON document per row. NULL fields are kept as ``null``."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read a report back with its known schema, so nothing is inferred."""
    return spark.read.schema(schema).json(path)
