
from __future__ import annotations

import importlib
import importlib.util
import os
import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import hubtrace_oracle as oracle  # noqa: E402
from hubtrace import operators as ops  # noqa: E402
from hubtrace import sources  # noqa: E402
from hubtrace.plans import incidents, overview, testdata  # noqa: E402
from hubtrace.plans.construction import END_COLS, KEY, SPECS, TIME_COLS  # noqa: E402
from hubtrace.plans.suite import run_suite, with_kept_incidents  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; both engines are cut alike."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def _incidents(name: str, *double_sums: str, digits: int = 2) -> Query:
    def run(spark: SparkSession, sf_dir: str, star=None) -> DataFrame:
        out = incidents.INCIDENT_QUERIES[name](star or testdata.star(spark, sf_dir))
        return _rounded(out, digits, *double_sums) if double_sums else out

    return run


def event_rate_by_region(spark: SparkSession, sf_dir: str, star=None) -> DataFrame:
    lookup = testdata.region_lookup(spark, sf_dir)
    return incidents.rate_by_region(star or testdata.star(spark, sf_dir), lookup)


CORRELATIONS: dict[str, Query] = {
    "event_rate_by_key": _incidents("incident_rate_by_project"),
    "event_rate_by_attr_ratio": _incidents("incident_rate_by_market_sector"),
    "event_rate_by_phase": _incidents("incident_rate_by_phase"),
    "event_rate_by_region": event_rate_by_region,
    "density_vs_events": _incidents("worker_density_vs_incidents"),
    "events_by_category_window": _incidents("incidents_by_trade", "total_workers"),
    "cooccurrence": _incidents("trade_cooccurrence_daily"),
    "severity_vs_events": _incidents("observation_severity_vs_incidents"),
    "closetime_vs_events": _incidents("observation_close_time_vs_incidents"),
    "slack_vs_events": _incidents("schedule_float_vs_incidents"),
    "events_by_vendor_window": _incidents("incidents_by_vendor", "total_workers"),
    "events_by_month": _incidents("incidents_by_month"),
    "events_by_dow": _incidents("incidents_by_day_of_week"),
    "burstiness_vs_events": _incidents(
        "activity_burstiness_vs_incidents", "avg_daily", "std_daily", digits=6
    ),
    "event_type_freq": _incidents("incident_type_distribution"),
    "size_vs_events": _incidents("contract_size_vs_incidents"),
    "period_overlap": _incidents("timecard_activity_overlap_with_incidents"),
}


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.raw(spark, sf_dir, *[name for name, _, _ in oracle.STATS])
    keyed = {
        name: t[name].withColumnRenamed(key, KEY) if key else t[name]
        for name, key, _ in oracle.STATS
    }
    return ops.table_stats(keyed, KEY, {name: time for name, _, time in oracle.STATS})


def table_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.table_inventory(testdata.raw(spark, sf_dir))


def key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.raw(spark, sf_dir)
    hub = t["customer"].withColumnRenamed("c_custkey", KEY)
    facts = {n: t[table].withColumnRenamed(key, KEY) for n, table, key in oracle.FACT_KEYS}
    return ops.key_match(hub, facts, KEY)


def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.describe_columns(testdata.raw(spark, sf_dir), {})


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [
        sources.part_files(spark, f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("table"), "*")
        for t in oracle.ALL_TABLES
    ]
    every = reduce(DataFrame.unionByName, files).groupBy("table")
    return every.agg((F.count("*") > 0).alias("has_files"), (F.min("bytes") > 0).alias("has_bytes"))


def _described(columns: dict[str, list[str]], stype: str) -> dict[str, sources.TableSpec]:
    return {t: sources.TableSpec(semantic=dict.fromkeys(c, stype)) for t, c in columns.items()}


def categorical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.raw(spark, sf_dir, *oracle.CATEGORIES)
    narrow = {n: df.select(*oracle.CATEGORIES[n]) for n, df in t.items()}
    return overview.profile_categories(narrow, _described(oracle.CATEGORIES, "categorical"))


def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.raw(spark, sf_dir, *oracle.NUMBERS)
    narrow = {n: df.select(*oracle.NUMBERS[n]) for n, df in t.items()}
    profile = overview.profile_numbers(narrow, _described(oracle.NUMBERS, "numerical"))
    return _rounded(profile, 4, "mean", "std")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = testdata.star(spark, sf_dir)["project_daily"]
    return ops.latest_per_key(history, KEY, ["dt_fact"], ["cat_market_sector", "cat_phase"])


def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.star(spark, sf_dir)
    seen = t["observation"].select("ids_observation", KEY, "dt_observation_created")
    found = t["incident"].select("ids_incident_number", KEY, "dt_incident_occurred")
    return ops.band_join(
        seen, found, KEY, "dt_observation_created", "dt_incident_occurred", 0, 14, "left"
    )


def cooccurrence_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.raw(spark, sf_dir, "lineitem", "part")
    sold = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    pairs = ops.cooccurrence(
        sold, "l_suppkey", "l_shipdate", "p_brand", 10, ("brand_a", "brand_b"),
        n_keys="n_suppliers",
    )
    return ops.top_k(pairs, ["cooccurrence_days"], 100, ["brand_a", "brand_b"])


def _as_lines(table: str, sampled: DataFrame, columns: list[str]) -> DataFrame:
    """Extracts of different tables under one schema: the named columns joined by |."""
    return sampled.select(F.lit(table).alias("table"), F.concat_ws("|", *columns).alias("line"))


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sample_rows(testdata.raw(spark, sf_dir, "orders")["orders"], 20, ["o_orderkey"])


def sample_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.raw(spark, sf_dir, *oracle.SAMPLES)
    parts = [
        _as_lines(name, ops.sample_rows(t[name], 20, keys), columns)
        for name, (keys, columns) in oracle.SAMPLES.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def top_event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_keys(testdata.star(spark, sf_dir)["incident"], KEY, 5)


def sample_top_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = testdata.raw(spark, sf_dir, "events")["events"]
    errors = events.where("event_type = 'error'")
    sampled = overview.sample_top_projects(
        {"events": events}, errors, "user_id", 5, 200, {"events": ["event_id"]}
    )
    return sampled["events"]


def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = sources.scratch_dir(spark)
    orders = testdata.raw(spark, sf_dir, "orders")["orders"]
    sources.export_table(orders, f"{base}/orders")
    return sources.load_tables(spark, base, ["orders"], suffix="")["orders"]


def export_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = testdata.raw(spark, sf_dir, "lineitem")["lineitem"]
    path = f"{sources.scratch_dir(spark)}/coerced"
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    sources.export_table(
        lines.select(
            "l_orderkey",
            "l_linenumber",
            price.alias("l_extendedprice"),
            F.col("l_returnflag").cast("binary").alias("l_returnflag"),
            F.col("l_shipdate").cast("date").alias("l_shipdate"),
            F.col("l_shipdate").alias("shipped_at"),
            F.convert_timezone(F.lit("UTC"), F.current_timezone(), "l_shipdate").cast("timestamp").alias("zoned"),
            F.array(F.struct(price.alias("p"))).alias("nested"),
        ),
        path,
    )
    return spark.read.parquet(path).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate", "shipped_at",
        F.unix_micros("zoned").alias("zoned_micros"), F.col("nested")[0]["p"].alias("nested_price"),
    )


def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = testdata.raw(spark, sf_dir, "nation", "orders", "events")
    summary = sources.export_tables(spark, tables, sources.scratch_dir(spark))
    return summary.select("table", "rows", (F.col("bytes") > 0).alias("has_bytes"), "status")


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sources.scratch_dir(spark)}/report"
    result = CORRELATIONS["event_type_freq"](spark, sf_dir)
    sources.write_report(result, path)
    return sources.read_report(spark, path, result.schema)


def suite_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = with_kept_incidents(spark, testdata.star(spark, sf_dir))
    named = {n: (lambda q=q: q(spark, sf_dir, star)) for n, q in CORRELATIONS.items()}
    return run_suite(spark, named)


def conform_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = dict.fromkeys(["l_orderkey", "l_partkey", "l_suppkey"], "ID")
    spec = sources.TableSpec(semantic=ids)
    return sources.conform(testdata.raw(spark, sf_dir, "lineitem")["lineitem"], spec)


def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.star(spark, sf_dir)
    facts = {name: t[name] for name in t if name != "hub"}
    return ops.fk_edges(t["hub"], facts, KEY, TIME_COLS)


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.star(spark, sf_dir)
    anchors = spark.createDataFrame([(a,) for a in oracle.ANCHORS], "anchor date")
    return ops.label_table(
        t["hub"], t["incident"], t["timecard"], anchors, KEY,
        "dt_incident_occurred", "dt_item_date",
    )


def edges_with_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.star(spark, sf_dir)
    facts = {name: t[name] for name in t if name != "hub"}
    return ops.fk_edges(t["hub"], facts, KEY, TIME_COLS, end_cols=END_COLS)


def edges_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = spark.createDataFrame([(a,) for a in oracle.ANCHORS], "anchor date")
    return ops.edges_at(edges_with_end(spark, sf_dir), anchors, KEY)


def label_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.star(spark, sf_dir)
    anchors = spark.createDataFrame([(a,) for a in oracle.ANCHORS], "anchor date")
    return ops.label_windows(
        t["hub"], t["incident"], t["timecard"], anchors, KEY,
        "dt_incident_occurred", "dt_item_date", oracle.WINDOWS,
    )


def registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.check_registry(testdata.star(spark, sf_dir), SPECS)


def exported_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table exported with a limit per part, and the parts that break a promise."""
    path = f"{sources.scratch_dir(spark)}/parts"
    lines = testdata.raw(spark, sf_dir, "lineitem")["lineitem"]
    sources.export_table(lines, path, max_rows=oracle.PART_ROWS)
    name = F.element_at(F.split("path", "/"), -1)
    listed = sources.part_files(spark, path).select(name.alias("_file"), "bytes")
    held = spark.read.parquet(path).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("n"))
    met = held.select(name.alias("_file"), "n").join(listed, "_file", "full")
    return met.agg(
        F.sum("n").alias("rows"), F.count_if(F.col("n") > oracle.PART_ROWS).alias("too_large"),
        F.count_if(F.col("bytes").isNull()).alias("unlisted"), F.count_if(F.col("n").isNull()).alias("empty"),
    )


def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = sources.TableSpec(
        primary_key="o_orderkey", foreign_keys={"o_custkey": "customer"}, time_col="o_orderdate"
    )
    orders = testdata.raw(spark, sf_dir, "orders")["orders"]
    return orders.select(*sources.feature_columns(orders, spec))


PREPARATION: dict[str, Query] = {
    f.__name__: f
    for f in (
        table_stats, table_inventory, describe_columns, part_files, key_match,
        categorical_profile, numeric_profile, latest_per_key, band_join, cooccurrence_brands,
        sample_rows, sample_all_rows, top_event_keys,
        sample_top_keys, export_roundtrip, export_coercion, export_summary,
        report_roundtrip, suite_status, conform_types, fk_edges, label_table,
        feature_projection, edges_with_end, edges_at, label_windows, registry_check, exported_parts,
    )
}


def _extra() -> list:
    """Modules that may be absent with their folders; only absence is tolerated, no error inside them."""
    present = lambda m: (spec := importlib.util.find_spec(m)) is not None and spec.origin is not None
    if not present("hubtrace.llm"):
        return []
    names = ["hubtrace.llm.queries", *filter(present, ["corpus_pipeline"])]
    return [importlib.import_module(m) for m in names]


def entry(spark: SparkSession) -> DataFrame:
    """Distinct events with first and last day for every hub key."""
    return CORRELATIONS["event_rate_by_key"](spark, SMOKE_DIR)


def queries() -> dict[str, Query]:
    found = {**CORRELATIONS, **PREPARATION}
    for module in _extra():
        found |= module.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(oracle.ORACLE)
    for module in _extra():
        found |= module.oracle_sql()
    return found
