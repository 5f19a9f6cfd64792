"""Newest value per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """One row per key with ``cols`` taken from the row that is last by ``order``.

    NULL order values come first, so they lose to any dated row; a NULL *value*
    in the newest row is kept. Rows that tie on ``order`` are settled by the
    greatest ``cols``, which keeps the answer independent of the partitioning.

    A maximum over one struct combines inside each map task, so a key that owns
    a large share of the history leaves each task as a single row. A ranking
    window would ship and sort every row of that key in one task.
    """
    newest = F.max(F.struct(*[F.col(c) for c in (*order, *cols)])).alias("_newest")
    return df.groupBy(key).agg(newest).select(
        key, *[F.col("_newest").getField(c).alias(c) for c in cols]
    )
