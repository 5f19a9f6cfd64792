"""The construction star seen through the shared test tables.

Orders give the project history; events give everything with a date window,
split by event type into the fact roles.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubtrace.plans.construction import KEY
from hubtrace.sources import Tables, load_tables

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# The schemas of the relational tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def raw(spark: SparkSession, base: str, *names: str) -> Tables:
    return load_tables(spark, base, names or TABLES, schemas=SCHEMAS)


def star(spark: SparkSession, base: str) -> Tables:
    """All role tables of ``construction.SPECS``, filled from the test tables."""
    t = raw(spark, base, "customer", "orders", "events")
    return Tables({role: partial(view, t) for role, view in _VIEWS.items()})


def _events(t: Tables, where: str, *columns: str) -> DataFrame:
    key = f"user_id AS {KEY}"
    return t["events"].where(where).selectExpr(key, *columns)


def _day(name: str) -> str:
    return f"CAST(ts AS DATE) AS {name}"


_LEVEL = "CASE WHEN value < 20 THEN 'low' WHEN value < 80 THEN 'mid' ELSE 'high' END"


def _hub(t: Tables) -> DataFrame:
    return t["customer"].selectExpr(f"c_custkey AS {KEY}")


def _project_daily(t: Tables) -> DataFrame:
    return t["orders"].selectExpr(
        f"o_custkey AS {KEY}",
        "o_custkey AS ids_customer",
        "CAST(o_orderdate AS DATE) AS dt_fact",
        "o_orderpriority AS cat_market_sector",
        "o_orderstatus AS cat_phase",
        "CASE WHEN o_totalprice >= 20000 THEN o_totalprice * 400 END AS amt_contract",
    )


def _incident(t: Tables) -> DataFrame:
    return _events(
        t,
        "event_type = 'error'",
        "event_id AS ids_incident_number",
        _day("dt_incident_occurred"),
        f"{_LEVEL} AS cat_incident_type",
        "get_json_object(props, '$.k') AS cat_osha_status",
        "value > 50 AS is_trir",
        "value > 100 AS is_ltir",
    )


def _site_log(t: Tables) -> DataFrame:
    return _events(
        t,
        "event_type <> 'error'",
        _day("dt_log_date"),
        "event_type AS cat_trade",
        "CAST(floor(value / 10) AS INT) AS ids_vendor",
        "CAST(value AS DECIMAL(18, 6)) AS n_workers_total",  # sums do not depend on their order
    )


def _observation(t: Tables) -> DataFrame:
    return _events(
        t,
        "event_type = 'view'",
        "event_id AS ids_observation",
        _day("dt_observation_created"),
        f"{_LEVEL} AS cat_severity",
        "value > 50 AS is_overdue",
        "CASE WHEN value <= 100 THEN value / 5 END AS amt_days_to_close_actual",
    )


def _task_update(t: Tables) -> DataFrame:
    return _events(
        t,
        "event_type = 'signup'",
        _day("dt_effective_from"),
        "CASE WHEN event_id % 3 > 0 THEN date_add(CAST(ts AS DATE), CAST(event_id % 40 AS INT)) END AS dt_effective_to",
        "round(value - 50, 0) AS amt_float",
        "event_id % 2 = 0 AS is_active_record",
    )


def _timecard(t: Tables) -> DataFrame:
    return _events(t, "event_type = 'purchase'", _day("dt_item_date"))


def _hours_weekly(t: Tables) -> DataFrame:
    return _events(t, "event_type = 'click'", _day("dt_date"), "value AS n_hours")


def _schedules(t: Tables, status: str, day: str) -> DataFrame:
    return t["orders"].where(f"o_orderstatus = '{status}'").selectExpr(
        "CAST(o_orderkey AS STRING) AS cat_schedule_code",
        f"o_custkey AS {KEY}",
        f"CAST(o_orderdate AS DATE) AS {day}",
        "CASE WHEN o_orderkey % 4 > 0 THEN date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 90 AS INT)) END"
        " AS dt_effective_to",
        "o_totalprice AS amt_cost",
    )


def _schedule_update(t: Tables) -> DataFrame:
    return _schedules(t, "O", "dt_snapshot")


def _schedule_baseline(t: Tables) -> DataFrame:
    return _schedules(t, "F", "dt_effective_from")


_VIEWS = {
    "hub": _hub,
    "project_daily": _project_daily,
    "incident": _incident,
    "site_log": _site_log,
    "observation": _observation,
    "task_update": _task_update,
    "timecard": _timecard,
    "hours_weekly": _hours_weekly,
    "schedule_update": _schedule_update,
    "schedule_baseline": _schedule_baseline,
}


def region_lookup(spark: SparkSession, base: str) -> tuple[str, DataFrame]:
    """Region name by customer, for ``incidents.rate_by_region``."""
    t = raw(spark, base, "customer", "nation", "region")
    nations = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    regions = t["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return "ids_customer", regions.select(
        F.col("c_custkey").alias("ids_customer"), F.col("r_name").alias("cat_region")
    )
