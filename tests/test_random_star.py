"""The condensed plans against plain joins, on rows with NULLs, ties, repeats and skew."""

import datetime
import random

import duckdb
import pytest

from compare import canonical, of_frame
from hubtrace.plans import incidents
from hubtrace_oracle import CORRELATIONS, STAR

KEY = "ids_project_number"
DAY0 = datetime.date(1969, 12, 20)  # block and week arithmetic must hold below zero too

# registered name -> (query name, columns the SQL rounds, digits)
CASES = {
    "event_rate_by_key": ("incident_rate_by_project", [], 0),
    "event_rate_by_attr_ratio": ("incident_rate_by_market_sector", [], 0),
    "event_rate_by_phase": ("incident_rate_by_phase", [], 0),
    "event_rate_by_region": ("incident_rate_by_region", [], 0),
    "density_vs_events": ("worker_density_vs_incidents", [], 0),
    "events_by_category_window": ("incidents_by_trade", ["total_workers"], 2),
    "cooccurrence": ("trade_cooccurrence_daily", [], 0),
    "severity_vs_events": ("observation_severity_vs_incidents", [], 0),
    "closetime_vs_events": ("observation_close_time_vs_incidents", [], 0),
    "slack_vs_events": ("schedule_float_vs_incidents", [], 0),
    "events_by_vendor_window": ("incidents_by_vendor", ["total_workers"], 2),
    "events_by_month": ("incidents_by_month", [], 0),
    "events_by_dow": ("incidents_by_day_of_week", [], 0),
    "burstiness_vs_events": (
        "activity_burstiness_vs_incidents", ["avg_daily", "std_daily"], 6,
    ),
    "size_vs_events": ("contract_size_vs_incidents", [], 0),
    "period_overlap": ("timecard_activity_overlap_with_incidents", [], 0),
}

# role -> [(domain column, short column in the SQL, type)]
LAYOUT = {
    "hub": [(KEY, "pid", "string")],
    "project_daily": [
        (KEY, "pid", "string"), ("dt_fact", "d", "date"),
        ("cat_market_sector", "sector", "string"), ("cat_phase", "phase", "string"),
        ("cat_region", "region", "string"), ("amt_contract", "contract", "double"),
    ],
    "incident": [
        ("ids_incident_number", "iid", "string"), (KEY, "pid", "string"),
        ("dt_incident_occurred", "d", "date"),
    ],
    "site_log": [
        (KEY, "pid", "string"), ("dt_log_date", "d", "date"), ("cat_trade", "trade", "string"),
        ("ids_vendor", "vendor", "string"), ("n_workers_total", "workers", "double"),
    ],
    "observation": [
        ("ids_observation", "oid", "string"), (KEY, "pid", "string"),
        ("dt_observation_created", "d", "date"), ("cat_severity", "sev", "string"),
        ("is_overdue", "overdue", "boolean"), ("amt_days_to_close_actual", "close_days", "double"),
    ],
    "task_update": [
        (KEY, "pid", "string"), ("dt_effective_from", "d", "date"),
        ("amt_float", "slack", "double"), ("is_active_record", "active", "boolean"),
    ],
    "timecard": [(KEY, "pid", "string"), ("dt_item_date", "d", "date")],
}


def make_rows(seed):
    r = random.Random(seed)
    keys = [f"p{i}" for i in range(12)]

    def maybe(value, share=0.06):
        return None if r.random() < share else value

    def key():  # one key holds about a third of all rows
        return maybe("p0" if r.random() < 0.33 else r.choice(keys))

    def day(span=60):
        return maybe(DAY0 + datetime.timedelta(days=r.randrange(span)))

    def some(n, make):
        rows = [make() for _ in range(n)]
        return rows + r.sample(rows, n // 10)  # exact copies, as in a full history

    return {
        "hub": [(k,) for k in [*keys, "p0", None, "quiet"]],
        "project_daily": some(300, lambda: (
            key(), day(8), maybe(r.choice("ABC")), maybe(r.choice("XY")), maybe(r.choice("NS")),
            maybe(r.choice([5e5, 1e6, 9.9e6, 1e7, 5e7, 1e8, 2e8]), 0.3),
        )),
        "incident": some(120, lambda: (maybe(f"i{r.randrange(70)}"), key(), day())),
        "site_log": some(400, lambda: (
            key(), day(), maybe(r.choice(["a", "b", "c", "d", "e"])), maybe(f"v{r.randrange(60)}"),
            maybe(float(r.randrange(0, 40)) / 4),
        )),
        "observation": some(150, lambda: (
            maybe(f"o{r.randrange(100)}"), key(), day(), maybe(r.choice(["low", "high"])),
            maybe(r.random() < 0.5), maybe(r.choice([0.5, 1.0, 3.0, 7.0, 14.0, 14.5]), 0.2),
        )),
        "task_update": some(150, lambda: (
            key(), day(), maybe(r.choice([-11.0, -10.0, -0.5, 0.0, 10.0, 10.5]), 0.2),
            maybe(r.random() < 0.7),
        )),
        "timecard": some(80, lambda: (key(), day())),
    }


@pytest.fixture(scope="module", params=[1, 2, 3])
def star(request, spark):
    rows = make_rows(request.param)
    con = duckdb.connect()
    frames = {}
    for role, layout in LAYOUT.items():
        schema = ", ".join(f"{c} {t}" for c, _, t in layout)
        frames[role] = spark.createDataFrame(rows[role], schema).repartition(4)
        short = ", ".join(
            f"{s} {'VARCHAR' if t == 'string' else t}" for _, s, t in layout
        )
        name = "all_tasks" if role == "task_update" else role
        con.execute(f"CREATE TABLE {name} ({short})")
        marks = ", ".join("?" for _ in layout)
        con.executemany(f"INSERT INTO {name} VALUES ({marks})", rows[role])
    con.execute("CREATE VIEW task_update AS SELECT * FROM all_tasks WHERE active")
    yield frames, con
    con.close()


def on_roles(sql):
    rest = sql[len(STAR):].lstrip()
    return "WITH " + rest[1:] if rest.startswith(",") else rest


@pytest.mark.parametrize("name", sorted(CASES))
def test_matches_plain_join(star, name):
    from pyspark.sql import functions as F

    frames, con = star
    query, rounded, digits = CASES[name]
    out = incidents.INCIDENT_QUERIES[query](frames)
    out = out.withColumns({c: F.round(c, digits) for c in rounded}) if rounded else out
    found = con.execute(on_roles(CORRELATIONS[name]))
    theirs = canonical([c[0] for c in found.description], found.fetchall())
    assert of_frame(out) == theirs


def test_shared_event_sites_change_nothing(star, spark, tmp_path):
    """Every query that counts events gives the same from sites that were written once."""
    frames, _ = star
    shared = {**frames, incidents.SITES: incidents.keep_incidents(frames["incident"], str(tmp_path / "sites"))}
    for name, (query, _, _) in CASES.items():
        if name not in ("cooccurrence", "events_by_month", "events_by_dow"):
            one, other = (incidents.INCIDENT_QUERIES[query](t) for t in (frames, shared))
            assert of_frame(one) == of_frame(other), name


def test_fact_counts_once_on_request(star):
    frames, con = star
    out = incidents.by_trade(frames, dedupe=True).select("cat_trade", "total_workers")
    found = con.execute(
        "SELECT trade AS cat_trade, sum(workers) AS total_workers FROM site_log GROUP BY trade"
    )
    assert of_frame(out) == canonical(["cat_trade", "total_workers"], found.fetchall())
