"""How incidents relate to projects, activity, observations and schedules.

Every query takes the role tables of ``construction.SPECS`` as ``{role: DataFrame}`` and
returns an ordered DataFrame. Cuts and orders carry a tie-break, so that equal counts
do not make the result depend on the run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubtrace.functions import bucketize
from hubtrace.operators import (
    activity_density,
    band_rates,
    burstiness,
    cooccurrence,
    event_rate_by_attr,
    event_rate_by_key,
    latest_per_key,
    period_overlap,
    top_k,
)
from hubtrace.operators.sites import Events, KeptSites
from hubtrace.plans.construction import KEY

Tables = Mapping[str, DataFrame]

INCIDENT = "ids_incident_number"
OCCURRED = "dt_incident_occurred"
LOGGED = "dt_log_date"
OBSERVED = "dt_observation_created"

#: Where the condensed incidents stand among the tables, if a suite has made them.
SITES = "incident_sites"

# Bucket edges and labels.
CLOSE_STEPS = [("<=", 1, "0-1d"), ("<=", 3, "1-3d"), ("<=", 7, "3-7d"), ("<=", 14, "7-14d")]
FLOAT_STEPS = [
    ("<", -10, "very_behind"), ("<", 0, "behind"), ("<=", 0, "on_track"), ("<=", 10, "ahead"),
]
SIZE_STEPS = [
    ("<", 1_000_000, "<1M"), ("<", 10_000_000, "1M-10M"),
    ("<", 50_000_000, "10M-50M"), ("<", 100_000_000, "50M-100M"),
]


def keep_incidents(incident: DataFrame, path: str) -> KeptSites:
    """Incidents condensed to (project, day), for all queries that count distinct ids."""
    return KeptSites.write(incident, KEY, OCCURRED, INCIDENT, path)


def _incidents(t: Tables) -> Events:
    return t[SITES] if SITES in t else t["incident"]


def _ranked(df: DataFrame, by: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), *[F.asc_nulls_last(c) for c in ties])


def _few(df: DataFrame, *order: Column) -> DataFrame:
    """Order a result of a dozen rows at most, without sampling it for ranges first."""
    return df.repartition(1).sortWithinPartitions(*order)


def _few_ranked(df: DataFrame, by: str, tie: str) -> DataFrame:
    return _few(df, F.desc_nulls_last(by), F.asc_nulls_last(tie))


def rate_by_project(t: Tables) -> DataFrame:
    rates = event_rate_by_key(
        t["hub"], _incidents(t), KEY, INCIDENT, OCCURRED,
        n_events="n_incidents", first="first_incident", last="last_incident",
    )
    return _ranked(rates, "n_incidents", KEY)


def _rate_by_latest(
    t: Tables, attr: str, ratio: str | None = None,
    lookup: tuple[str, DataFrame] | None = None,
) -> DataFrame:
    """Rates by an attribute of the newest project row.

    ``lookup = (column, table)`` fetches the attribute from a dimension table by
    that column, after the history has shrunk to one row per project.
    """
    source = lookup[0] if lookup else attr
    newest = latest_per_key(t["project_daily"], KEY, ["dt_fact"], [source])
    if lookup:
        newest = newest.join(lookup[1], source, "left").select(KEY, attr)
    rates = event_rate_by_attr(
        newest, _incidents(t), KEY, INCIDENT, attr, "n_projects", "n_incidents", ratio
    )
    return _ranked(rates, "n_incidents", attr)


def rate_by_market_sector(t: Tables) -> DataFrame:
    return _rate_by_latest(t, "cat_market_sector", "incidents_per_project")


def rate_by_phase(t: Tables) -> DataFrame:
    return _rate_by_latest(t, "cat_phase")


def rate_by_region(t: Tables, lookup: tuple[str, DataFrame] | None = None) -> DataFrame:
    return _rate_by_latest(t, "cat_region", lookup=lookup)


def worker_density(t: Tables) -> DataFrame:
    density = activity_density(
        t["site_log"], _incidents(t), KEY, LOGGED, "n_workers_total", INCIDENT,
        mean="avg_daily_workers", peak="max_daily_workers", n_events="n_incidents",
    )
    return top_k(density, ["n_incidents"], 200, [KEY])


def _near_site_logs(t: Tables, dim: str, logs: DataFrame, dedupe: bool) -> DataFrame:
    near = band_rates(
        logs, _incidents(t), key=KEY, fact_day=LOGGED, event_day=OCCURRED,
        event_id=INCIDENT, dims=[dim], lo=-7, hi=7, entity=KEY, n_entities="n_projects",
        n_events="n_incidents", weight="n_workers_total", weight_sum="total_workers",
        dedupe=dedupe,
    )
    return top_k(near, ["n_incidents"], 50, [dim])


def by_trade(t: Tables, dedupe: bool = False) -> DataFrame:
    return _near_site_logs(t, "cat_trade", t["site_log"], dedupe)


def by_vendor(t: Tables, dedupe: bool = False) -> DataFrame:
    logs = t["site_log"].where(F.col("ids_vendor").isNotNull())
    return _near_site_logs(t, "ids_vendor", logs, dedupe)


def trade_cooccurrence(t: Tables) -> DataFrame:
    pairs = cooccurrence(
        t["site_log"], KEY, LOGGED, "cat_trade", 10, ("trade_a", "trade_b"),
        n_keys="n_projects",
    )
    return top_k(pairs, ["cooccurrence_days"], 100, ["trade_a", "trade_b"])


def _after_observations(t: Tables, observations: DataFrame, dims: list[str]) -> DataFrame:
    after = band_rates(
        observations, _incidents(t), key=KEY, fact_day=OBSERVED, event_day=OCCURRED,
        event_id=INCIDENT, dims=dims, lo=0, hi=14, entity="ids_observation",
        n_entities="n_observations", n_events="n_incidents_within_14d",
    )
    return _ranked(after, "n_incidents_within_14d", *dims)


def after_severity(t: Tables) -> DataFrame:
    return _after_observations(t, t["observation"], ["cat_severity", "is_overdue"])


def after_close_time(t: Tables) -> DataFrame:
    bucket = bucketize(
        F.col("amt_days_to_close_actual"), CLOSE_STEPS, "14d+", null_label="still_open"
    )
    observations = t["observation"].withColumn("close_bucket", bucket)
    return _after_observations(t, observations, ["close_bucket"])


def after_schedule_float(t: Tables) -> DataFrame:
    bucket = bucketize(F.col("amt_float"), FLOAT_STEPS, "very_ahead", null_label="null")
    tasks = t["task_update"].where("is_active_record").withColumn("float_bucket", bucket)
    after = band_rates(
        tasks, _incidents(t), key=KEY, fact_day="dt_effective_from", event_day=OCCURRED,
        event_id=INCIDENT, dims=["float_bucket"], lo=0, hi=14, entity=KEY,
        n_entities="n_projects", n_events="n_incidents",
    )
    return _few_ranked(after, "n_incidents", "float_bucket")


def _by_calendar(t: Tables, part: str, name: str) -> DataFrame:
    dated = t["incident"].where(F.col(OCCURRED).isNotNull())
    day = F.col(OCCURRED)
    unit = F.month(day) if part == "month" else F.dayofweek(day)
    counts = dated.groupBy(unit.alias(name)).agg(F.count("*").alias("n_incidents"))
    return _few(counts, F.col(name))


def by_month(t: Tables) -> DataFrame:
    return _by_calendar(t, "month", "month")


def by_day_of_week(t: Tables) -> DataFrame:
    """Day 1 is Sunday."""
    return _by_calendar(t, "dayofweek", "dow")


def activity_burstiness(t: Tables) -> DataFrame:
    bursts = burstiness(
        t["site_log"], _incidents(t), KEY, LOGGED, "n_workers_total", INCIDENT,
        min_days=10, n_events="n_incidents",
    )
    return top_k(bursts, ["n_incidents"], 200, [KEY])


def type_distribution(t: Tables) -> DataFrame:
    dims = ["cat_incident_type", "cat_osha_status", "is_trir", "is_ltir"]
    return _ranked(t["incident"].groupBy(*dims).agg(F.count("*").alias("cnt")), "cnt", *dims)


def by_contract_size(t: Tables) -> DataFrame:
    known = t["project_daily"].where(F.col("amt_contract").isNotNull())
    newest = latest_per_key(known, KEY, ["dt_fact"], ["amt_contract"])
    sizes = newest.select(
        KEY, bucketize(F.col("amt_contract"), SIZE_STEPS, "100M+").alias("size_bucket")
    )
    rates = event_rate_by_attr(
        sizes, _incidents(t), KEY, INCIDENT, "size_bucket",
        "n_projects", "n_incidents", "incidents_per_project",
    )
    return _few_ranked(rates, "incidents_per_project", "size_bucket")


def timecard_overlap(t: Tables) -> DataFrame:
    return period_overlap(
        _incidents(t), t["timecard"], KEY, OCCURRED, "dt_item_date", "week",
        both="incident_weeks_with_timecard", total="total_incident_weeks",
    )


# The names of the queries.
INCIDENT_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "incident_rate_by_project": rate_by_project,
    "incident_rate_by_market_sector": rate_by_market_sector,
    "incident_rate_by_phase": rate_by_phase,
    "incident_rate_by_region": rate_by_region,
    "worker_density_vs_incidents": worker_density,
    "incidents_by_trade": by_trade,
    "trade_cooccurrence_daily": trade_cooccurrence,
    "observation_severity_vs_incidents": after_severity,
    "observation_close_time_vs_incidents": after_close_time,
    "schedule_float_vs_incidents": after_schedule_float,
    "incidents_by_vendor": by_vendor,
    "incidents_by_month": by_month,
    "incidents_by_day_of_week": by_day_of_week,
    "activity_burstiness_vs_incidents": activity_burstiness,
    "incident_type_distribution": type_distribution,
    "contract_size_vs_incidents": by_contract_size,
    "timecard_activity_overlap_with_incidents": timecard_overlap,
}
