from hubtrace.sources.export import conform_for_export, export_table, export_tables, part_files
from hubtrace.sources.report import read_report, write_report
from hubtrace.sources.schema import (
    TableSpec,
    annotate,
    categorical_columns,
    conform,
    describe_columns,
    feature_columns,
    numeric_columns,
    semantic_type,
)
from hubtrace.sources.scratch import scratch_dir
from hubtrace.sources.tables import Tables, catalog_tables, load_tables

__all__ = [
    "TableSpec",
    "Tables",
    "annotate",
    "catalog_tables",
    "categorical_columns",
    "conform",
    "conform_for_export",
    "describe_columns",
    "export_table",
    "export_tables",
    "feature_columns",
    "load_tables",
    "numeric_columns",
    "part_files",
    "read_report",
    "scratch_dir",
    "semantic_type",
    "write_report",
]
