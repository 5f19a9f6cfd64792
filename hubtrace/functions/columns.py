"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucketize(
    value: Column,
    steps: Sequence[tuple[str, float, str]],
    other: str,
    null_label: str | None = None,
) -> Column:
    """Label a number by the first step it satisfies.

    ``steps`` holds ``("<" or "<=", edge, label)`` in ascending order. NULL
    takes ``null_label`` when one is given, else it falls through to ``other``.
    """
    out = F.when(value.isNull(), null_label) if null_label is not None else None
    for op, edge, label in steps:
        if op not in ("<", "<="):
            raise ValueError(f"step operator must be < or <=, not {op!r}")
        hit = value < edge if op == "<" else value <= edge
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(other) if out is None else out.otherwise(other)


def safe_ratio(num: Column, den: Column, digits: int | None = None) -> Column:
    """``num / den`` as double, NULL where the denominator is zero or NULL."""
    den = den.cast("double")
    ratio = num.cast("double") / F.when(den != 0, den)
    return ratio if digits is None else F.round(ratio, digits)


def day_number(day: Column) -> Column:
    """Days since 1970-01-01. Timestamps are cut to their date first."""
    return F.unix_date(day.cast("date"))


def text_of(value: Column) -> Column:
    """Printable form of a value; NULL stays NULL, booleans print as true/false."""
    return value.cast("string")


def known(*cols: str) -> Column:
    """No column is NULL, in the form Parquet scans can take over as a filter."""
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in cols])
