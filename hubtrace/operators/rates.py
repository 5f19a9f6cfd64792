"""Event rates per key and per attribute, daily activity, period overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubtrace.functions import known, safe_ratio
from hubtrace.operators.sites import Events, KeptSites, sites_by_key


def top_k(df: DataFrame, by: Sequence[str], k: int, ties: Sequence[str]) -> DataFrame:
    """First ``k`` rows by ``by`` descending; ``ties`` ascending makes the cut stable."""
    order = [F.desc_nulls_last(c) for c in by] + [F.asc_nulls_last(c) for c in ties]
    return df.orderBy(*order).limit(k)


def events_per_key(
    events: Events, key: str, event_id: str, name: str = "n_events"
) -> DataFrame:
    """Distinct event ids per key. NULL keys are left out: they match nothing."""
    if isinstance(events, KeptSites):
        return events.per_key(name)
    return (
        events.where(known(key))
        .groupBy(key)
        .agg(F.countDistinct(event_id).alias(name))
    )


def _with_event_count(
    df: DataFrame, events: Events, key: str, event_id: str, name: str
) -> DataFrame:
    counted = df.join(events_per_key(events, key, event_id, name), key, "left")
    return counted.fillna(0, subset=[name])


def event_rate_by_key(
    hub: DataFrame,
    events: Events,
    key: str,
    event_id: str,
    day: str,
    n_events: str = "n_events",
    first: str = "first_event",
    last: str = "last_event",
) -> DataFrame:
    """Every hub key with its distinct events, first and last day; zeros kept."""
    if isinstance(events, KeptSites):
        per_key = events.per_key(n_events, first, last)
    else:
        per_key = (
            events.where(known(key))
            .groupBy(key)
            .agg(
                F.countDistinct(event_id).alias(n_events),
                F.min(day).alias(first),
                F.max(day).alias(last),
            )
        )
    keys = hub.select(key).distinct()
    return keys.join(per_key, key, "left").fillna(0, subset=[n_events])


def event_rate_by_attr(
    attrs: DataFrame,
    events: Events,
    key: str,
    event_id: str,
    attr: str,
    n_keys: str = "n_keys",
    n_events: str = "n_events",
    ratio: str | None = None,
) -> DataFrame:
    """Keys and distinct events per attribute value.

    ``attrs`` has one row per key (see ``latest_per_key``). Events are condensed
    per key first, so the join carries one row per key, and a busy key costs no
    more than a quiet one; the few ids that occur under several keys are added apart.
    """
    attrs = attrs.select(key, attr)
    # Always true, and it keeps the counts in both branches, so that they share one shuffle.
    sites, roaming = (x.where("_rows >= 0") for x in sites_by_key(events, key, event_id))
    out = attrs.join(sites, key, "left").groupBy(attr).agg(
        F.count(key).alias(n_keys), F.coalesce(F.sum("_ids"), F.lit(0)).alias(n_events)
    )
    met = attrs.join(roaming, key).groupBy(attr)
    met = met.agg(F.lit(0).alias(n_keys), F.countDistinct(event_id).alias(n_events))
    out = out.unionByName(met).groupBy(attr)
    out = out.agg(*[F.sum(c).alias(c) for c in (n_keys, n_events)])
    if ratio:
        out = out.withColumn(ratio, safe_ratio(F.col(n_events), F.col(n_keys), 2))
    return out


def activity_density(
    logs: DataFrame,
    events: Events,
    key: str,
    day: str,
    value: str,
    event_id: str,
    mean: str = "mean_value",
    peak: str = "max_value",
    days: str = "active_days",
    n_events: str = "n_events",
) -> DataFrame:
    """Mean and peak of a logged value, active days, and distinct events per key.

    The mean is rounded once, to one digit. A sum of doubles depends on the order of its parts in
    the last bits; a decimal value column makes it exact.

    Rows combine to (key, day) and then to the key before the events are joined;
    a join on the key alone would only repeat rows and leave mean and peak as they are.
    """
    daily = logs.groupBy(key, day).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n"), F.max(value).alias("_max")
    )
    per_key = daily.groupBy(key).agg(
        safe_ratio(F.sum("_sum"), F.sum("_n"), 1).alias(mean),
        F.round(F.max("_max").cast("double"), 1).alias(peak),
        F.count(day).alias(days),
    )
    return _with_event_count(per_key, events, key, event_id, n_events)


def burstiness(
    logs: DataFrame,
    events: Events,
    key: str,
    day: str,
    value: str,
    event_id: str,
    min_days: int = 10,
    n_events: str = "n_events",
) -> DataFrame:
    """Mean, sample deviation and their ratio of the daily totals of each key."""
    daily = logs.groupBy(key, day).agg(F.sum(value).alias("_daily"))
    stats = (
        daily.groupBy(key)
        .agg(
            F.avg("_daily").cast("double").alias("avg_daily"),
            F.stddev_samp("_daily").alias("std_daily"),
            F.count("*").alias("n_days"),
        )
        .where(F.col("n_days") >= min_days)
    )
    cv = safe_ratio(F.col("std_daily"), F.col("avg_daily"), 2).alias("cv")
    stats = stats.select(key, "avg_daily", "std_daily", cv, "n_days")
    return _with_event_count(stats, events, key, event_id, n_events)


def period_overlap(
    events: Events,
    activity: DataFrame,
    key: str,
    event_day: str,
    activity_day: str,
    unit: str = "week",
    both: str = "periods_with_activity",
    total: str = "total_periods",
) -> DataFrame:
    """How many (key, period) pairs with events also hold activity; one row.

    Weeks start on Monday. The two ``distinct`` steps leave both sides
    partitioned the way the join needs, so the join adds no shuffle.
    """

    def periods(df: DataFrame, day: str) -> DataFrame:
        start = F.trunc(F.col(day).cast("date"), unit).alias("_start")
        return df.where(known(key, day)).select(key, start).distinct()

    if isinstance(events, KeptSites):
        events = events.sites
    busy = periods(activity, activity_day).withColumn("_busy", F.lit(1))
    return (
        periods(events, event_day)
        .join(busy, [key, "_start"], "left")
        .agg(F.count("_busy").alias(both), F.count("*").alias(total))
    )
