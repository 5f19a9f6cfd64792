"""Small readable extracts of large tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubtrace.functions import known, text_of


def sample_rows(df: DataFrame, n: int = 20, order: Sequence[str] = ()) -> DataFrame:
    """``n`` rows with every value as text.

    Without ``order`` any rows do and Spark stops after the first partitions;
    with it the extract is repeatable and each task sends at most ``n`` rows.
    """
    picked = df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order]) if order else df
    return picked.limit(n).select(*[text_of(F.col(f"`{c}`")).alias(c) for c in df.columns])


def sample_for_keys(
    df: DataFrame, keys: DataFrame, key: str, n: int = 200, order: Sequence[str] = ()
) -> DataFrame:
    """Up to ``n`` rows whose key is among ``keys``, as text.

    ``keys`` usually comes from ``top_keys``; its limit tells Spark that it is short
    enough to broadcast, so the table itself is not shuffled.
    """
    chosen = keys.where(known(key)).select(key)
    return sample_rows(df.join(chosen, key, "left_semi"), n, order)
