"""What Spark makes of the plans, and the whole report on the test star."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hubtrace import operators as ops
from hubtrace.plans import INCIDENT_QUERIES, testdata, write_report_set
from hubtrace.plans.suite import with_kept_incidents
from hubtrace.sources import Tables

SF = "/root/testdata/sf0.001"
QUERIES = {**entry.CORRELATIONS, **entry.PREPARATION}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan, column):
    """Scans of Parquet files that read a column, reused ones not counted."""
    return [
        s for s in re.findall(r"FileScan parquet .*", plan) if re.search(rf"\b{column}\b", s)
    ]


@pytest.fixture
def shuffled(spark):
    """Plans as for tables too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"suite_status", "export_summary"}))
def test_no_products_and_no_python_rows(shuffled, name):
    plan = plan_of(QUERIES[name](shuffled, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "EvalPython" not in plan and "InPandas" not in plan


@pytest.fixture
def jobs(spark):
    """Counts the jobs that a call starts."""
    tracker = spark.sparkContext.statusTracker()

    def count(call):
        spark.sparkContext.setJobGroup("counted", "")
        try:
            call()
            return len(tracker.getJobIdsForGroup("counted"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    return count


@pytest.mark.parametrize(
    "name", sorted(set(entry.CORRELATIONS) | {"band_join", "cooccurrence_brands", "label_table", "fk_edges"})
)
def test_building_a_plan_runs_no_job(spark, jobs, name):
    assert jobs(lambda: QUERIES[name](spark, SF)) == 0


@pytest.mark.parametrize("name", ["severity_vs_events", "slack_vs_events", "events_by_vendor_window", "event_rate_by_attr_ratio"])
def test_events_are_shuffled_on_their_id_once(shuffled, name):
    """All branches read one shuffle of (id, site) pairs; ids are looked up among those pairs."""
    shuffled.conf.set("spark.sql.adaptive.enabled", "false")  # else an empty branch is cut out before
    try:
        plan = plan_of(QUERIES[name](shuffled, SF))
    finally:
        shuffled.conf.set("spark.sql.adaptive.enabled", "true")
    pairs = re.findall(r"(?m)^[ :+-]*Exchange hashpartitioning\(ids_incident_number#\d+L?, ids_project_number", plan)
    assert len(pairs) == 1 and plan.count("ReusedExchange") >= 2


def test_a_suite_reads_incidents_once(shuffled):
    """With shared sites, no query that counts ids scans or shuffles the incidents themselves."""
    star = with_kept_incidents(shuffled, testdata.star(shuffled, SF))
    counting = set(entry.CORRELATIONS) - {"cooccurrence", "events_by_month", "events_by_dow", "event_type_freq"}
    for name in sorted(counting):
        plan = plan_of(entry.CORRELATIONS[name](shuffled, SF, star))
        assert "EqualTo(event_type,error)" not in plan.replace("Not(EqualTo(event_type,error))", ""), name


def test_cooccurrence_has_one_plan(spark):
    df = spark.createDataFrame([("a", 1, "x")], "k string, t int, x string").withColumn("t", F.current_date())
    one, many = (
        re.sub(r"#\d+L?|plan_id=\d+|/ \d+", "", plan_of(ops.cooccurrence(df, "k", "t", "x", 8, crowd=c))) for c in (1, 1000)
    )
    assert one == many


def test_labels_are_distinct_before_they_meet_the_anchors(shuffled):
    plan = plan_of(QUERIES["label_table"](shuffled, SF)).split("== Initial Plan ==")[-1]
    for part in re.findall(r"Exchange hashpartitioning\(_day#.*", plan):
        assert part
    assert re.search(r"Exchange hashpartitioning\(ids_project_number#\d+L?, _day#", plan)


def test_profile_reads_a_table_once(spark):
    lines = testdata.raw(spark, SF, "lineitem")["lineitem"]
    cols = ["l_returnflag", "l_linestatus", "l_shipdate"]
    assert len(scans(plan_of(ops.categorical_profile(lines, cols)), "l_shipdate")) == 1
    numbers = ["l_quantity", "l_tax"]
    assert len(scans(plan_of(ops.numeric_profile(lines, numbers, 10_000)), "l_tax")) == 1


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(QUERIES["event_rate_by_key"](spark, SF))
    (scan,) = scans(plan, "user_id")
    schema = re.search(r"ReadSchema: struct<(.*)>", scan).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"event_id", "ts", "user_id", "event_type"}
    assert "EqualTo(event_type,error)" in scan and "IsNotNull(user_id)" in scan


def test_latest_combines_before_it_shuffles(spark):
    history = testdata.star(spark, SF)["project_daily"]
    plan = plan_of(ops.latest_per_key(history, "ids_project_number", ["dt_fact"], ["cat_phase"]))
    assert "partial_max" in plan and "Window" not in plan
    assert plan.split("== Initial Plan ==")[0].count("Exchange") == 1


def test_top_categories_are_limited_before_the_final_rank(spark):
    parts = testdata.raw(spark, SF, "part")["part"]
    plan = plan_of(ops.categorical_profile(parts, ["p_name"]))
    assert plan.count("WindowGroupLimit") == 2


def test_few_keys_are_broadcast_by_their_limit(spark):
    plan = plan_of(QUERIES["sample_top_keys"](spark, SF))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_report_set(spark, tmp_path):
    star = testdata.star(spark, SF)
    newest = star["project_daily"].withColumn("cat_region", F.lit("all"))
    tables = {**star, "project_daily": newest}
    done = {r["name"]: r for r in write_report_set(spark, tables, str(tmp_path)).collect()}
    assert {r["status"] for r in done.values()} == {"ok"}
    assert set(INCIDENT_QUERIES) <= set(done)
    assert all(spark.read.json(str(tmp_path / f"table_stats_{t}")).count() == 1 for t in tables)
    assert spark.read.json(str(tmp_path / "sample_top_projects_hub")).count() == 5


def test_report_set_without_a_table(spark, tmp_path):
    star = testdata.star(spark, SF)
    gone = lambda: spark.read.parquet(str(tmp_path / "gone"))
    some = Tables(
        {"hub": lambda: star["hub"], "incident": lambda: star["incident"], "site_log": gone}
    )
    done = {r["name"]: r["status"] for r in write_report_set(spark, some, str(tmp_path)).collect()}
    assert done["incident_rate_by_project"] == "ok"
    assert done["table_stats_incident"] == done["categorical_distributions_hub"] == "ok"
    assert done["incidents_by_trade"] == done["sample_site_log"] == done["table_stats_site_log"] == "error"


def test_report_set_with_a_corrupt_file(spark, tmp_path):
    star = testdata.star(spark, SF)
    bad = tmp_path / "bad"
    star["site_log"].write.parquet(str(bad))
    for part in bad.glob("*.parquet"):
        part.write_bytes(b"PAR1 this is no file PAR1")
    tables = {"hub": star["hub"], "incident": star["incident"], "site_log": spark.read.schema(star["site_log"].schema).parquet(str(bad))}
    done = {r["name"]: r["status"] for r in write_report_set(spark, tables, str(tmp_path / "out")).collect()}
    assert done["numerical_distributions_site_log"] == done["sample_site_log"] == "error"
    assert done["categorical_distributions_incident"] == done["table_stats_hub"] == "ok"
