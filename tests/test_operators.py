"""Edge rows for each operator."""

import datetime
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from compare import of_frame
from hubtrace import operators as ops
from hubtrace import sources
from hubtrace.operators import percentiles
from hubtrace.functions import bucketize, safe_ratio
from hubtrace.plans import incidents


def d(n):
    return datetime.date(2024, 3, 1) + datetime.timedelta(days=n)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=repr)


# --- functions ---------------------------------------------------------------------


def test_bucket_edges(spark):
    df = spark.createDataFrame([(x,) for x in (None, 1.0, 1.1, 3.0, 7.0, 14.0, 14.1)], "x double")
    close = bucketize(F.col("x"), incidents.CLOSE_STEPS, "14d+", "still_open")
    assert [r[0] for r in df.select(close).collect()] == [
        "still_open", "0-1d", "1-3d", "1-3d", "3-7d", "7-14d", "14d+",
    ]
    df = spark.createDataFrame([(x,) for x in (None, -10.5, -10.0, 0.0, 0.5, 10.0, 11.0)], "x double")
    slack = bucketize(F.col("x"), incidents.FLOAT_STEPS, "very_ahead", "null")
    assert [r[0] for r in df.select(slack).collect()] == [
        "null", "very_behind", "behind", "on_track", "ahead", "ahead", "very_ahead",
    ]
    df = spark.createDataFrame([(x,) for x in (9e5, 1e6, 1e7, 5e7, 1e8)], "x double")
    size = bucketize(F.col("x"), incidents.SIZE_STEPS, "100M+")
    assert [r[0] for r in df.select(size).collect()] == [
        "<1M", "1M-10M", "10M-50M", "50M-100M", "100M+",
    ]


def test_bucket_without_steps_and_bad_step(spark):
    assert spark.range(1).select(bucketize(F.col("id"), [], "all")).first()[0] == "all"
    with pytest.raises(ValueError):
        bucketize(F.col("id"), [(">", 1, "x")], "y")


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (1, 3)], "n int, m int")
    got = [r[0] for r in df.select(safe_ratio(F.col("n"), F.col("m"), 2)).collect()]
    assert got == [None, None, 0.33]


def test_means_are_rounded_once(spark):
    """As ROUND does it: just below a half goes down."""
    logs = spark.createDataFrame([("a", d(0), 0.0499999999999), ("b", d(0), 0.05)], "k string, t date, w double")
    none = spark.createDataFrame([], "k string, i string")
    got = ops.activity_density(logs, none, "k", "t", "w", "i")
    assert rows(got.select("k", "mean_value")) == [("a", 0.0), ("b", 0.1)]


# --- latest ------------------------------------------------------------------------


def test_latest_keeps_null_value_and_ranks_null_date_last(spark):
    df = spark.createDataFrame(
        [
            ("a", d(1), "old"), ("a", d(2), None), ("a", None, "undated"),
            ("b", None, "only"), ("c", d(1), "x"), ("c", d(1), "y"), (None, d(1), "z"),
        ],
        "k string, t date, v string",
    )
    assert rows(ops.latest_per_key(df, "k", ["t"], ["v"])) == sorted(
        [("a", None), ("b", "only"), ("c", "y"), (None, "z")], key=repr
    )


# --- band --------------------------------------------------------------------------


@pytest.mark.parametrize("lo,hi", [(-7, 7), (0, 14), (1, 3), (0, 0), (-30, -2)])
def test_band_join_meets_exactly_the_pairs_in_range(spark, lo, hi):
    r = random.Random(lo * 100 + hi)
    origin = datetime.date(1970, 1, 3)

    def make(n):
        return [
            (i, r.choice(["a", "b", None]),
             r.choice([None] + [origin + datetime.timedelta(days=x) for x in range(-40, 40)]))
            for i in range(n)
        ]

    left, right = make(80), make(80)
    want = sorted(
        (i, j)
        for (i, k, t), (j, m, e) in itertools.product(left, right)
        if k and k == m and t and e and lo <= (e - t).days <= hi
    )
    lf = spark.createDataFrame(left, "i int, k string, t date")
    rf = spark.createDataFrame(right, "j int, k string, e date")
    got = ops.band_join(lf, rf, "k", "t", "e", lo, hi)
    assert sorted(rows(got, "i", "j")) == want
    kept = ops.band_join(lf, rf, "k", "t", "e", lo, hi, "left")
    alone = {i for i, _, _ in left} - {i for i, _ in want}
    assert {r.i for r in kept.where("j IS NULL").collect()} == alone
    semi = ops.band_join(lf, rf, "k", "t", "e", lo, hi, "left_semi")
    assert {r.i for r in semi.collect()} == {i for i, _ in want}
    assert semi.columns == ["i", "k", "t"]


def test_band_join_rejects_bad_arguments(spark):
    df = spark.createDataFrame([], "k string, t date")
    with pytest.raises(ValueError):
        ops.band_join(df, df, "k", "t", "t", 1, 0)
    with pytest.raises(ValueError):
        ops.band_join(df, df, "k", "t", "t", 0, 1, "full")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_band_join_is_the_same_however_it_is_split(spark, how):
    r = random.Random(9)
    left = [(i, None if i % 50 == 0 else "hot" if i % 3 else r.choice("ab"), d(r.randrange(6))) for i in range(400)]
    left += [left[1]] * 20
    right = [(j, r.choice(["hot", "a", "c", None]), d(r.randrange(30))) for j in range(60)]
    lf = spark.createDataFrame(left, "i int, k string, t date")
    rf = spark.createDataFrame(right, "j int, k string, e date")
    whole = rows(ops.band_join(lf, rf, "k", "t", "e", 0, 4, how, crowd=None))
    assert whole
    for crowd in (1, 7, 100):
        assert rows(ops.band_join(lf, rf, "k", "t", "e", 0, 4, how, crowd=crowd)) == whole


def test_busy_places_are_dealt_over_join_tasks(spark):
    """3,000 rows of one key and block: without a limit in one task, else in about as many as it takes."""
    key = F.format_string("hot%d", F.pmod("id", F.lit(1)))
    left = spark.range(3_000).select("id", key.alias("k"), F.date_add(F.lit(d(0)), F.pmod("id", F.lit(1)).cast("int")).alias("t"))
    right = spark.createDataFrame([("hot0", d(0))], "k string, e date")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {n: spark.conf.get(n) for n in settings}
    try:
        for n, v in settings.items():
            spark.conf.set(n, v)

        def fullest(crowd):
            met = ops.band_join(left, right, "k", "t", "e", 0, 4, crowd=crowd)
            counts = [x["count"] for x in met.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(counts) == 3_000
            return max(counts)

        assert fullest(None) == 3_000
        assert fullest(100) <= 500
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def test_masks_tell_ids_apart(spark):
    """300 ids at several of 40 sites: the union of any sites' masks has as many bits as they have ids."""
    r = random.Random(11)
    pairs = {(f"i{n}", f"s{r.randrange(40)}") for n in range(300) for _ in range(4)}
    events = spark.createDataFrame(sorted(pairs), "i string, s string")
    sites, roaming = ops.event_sites(events, ["s"], "i")
    masks = [tuple(x) for x in ops.id_masks(roaming, ["s"], "i").collect()]
    listed = {tuple(x) for x in roaming.select("i", "s").collect()}
    for _ in range(20):
        some = set(r.sample([f"s{n}" for n in range(40)], r.randrange(1, 40)))
        union = {}
        for s, chunk, mask in masks:
            if s in some:
                union[chunk] = union.get(chunk, 0) | (mask & (2**64 - 1))
        assert sum(m.bit_count() for m in union.values()) == len({i for i, s in listed if s in some})


def test_timestamps_are_cut_to_their_day(spark):
    late = datetime.datetime(2024, 3, 15, 23, 59)
    left = spark.createDataFrame([("a", datetime.datetime(2024, 3, 1, 8))], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", late)], "k string, e timestamp_ntz")
    assert ops.band_join(left, right, "k", "t", "e", 0, 14).count() == 1
    assert ops.band_join(left, right, "k", "t", "e", 0, 13).count() == 0


def test_sites_add_up_to_distinct_ids(spark):
    events = spark.createDataFrame(
        [
            ("one", "a", d(0)), ("one", "a", d(0)), ("two", "a", d(0)), ("two", "b", d(0)),
            ("three", "b", d(1)), (None, "b", d(1)), ("lost", None, d(1)), ("lost", "b", None),
        ],
        "i string, k string, t date",
    )
    sites, roaming = ops.event_sites(events, ["k", "t"], "i", with_unnamed=True)
    assert rows(sites, "k", "t", "_ids", "_rows") == [
        ("a", d(0), 1, 3), ("b", d(0), 0, 1), ("b", d(1), 1, 2),
    ]
    assert rows(roaming, "i", "k", "t", "_rows") == [("two", "a", d(0), 1), ("two", "b", d(0), 1)]
    assert ops.event_sites(events.where("i = 'one'"), ["k", "t"], "i")[1].count() == 0


def test_weight_repeats_per_matching_event_row(spark):
    logs = spark.createDataFrame([("a", d(0), "x", 3.0), ("a", d(40), "x", 5.0)], "k string, t date, g string, w double")
    events = spark.createDataFrame([("e1", "a", d(7)), ("e2", "a", d(-7)), ("e3", "a", d(8))], "i string, k string, e date")
    got = ops.band_rates(
        logs, events, key="k", fact_day="t", event_day="e", event_id="i", dims=["g"],
        lo=-7, hi=7, entity="k", n_entities="n_k", n_events="n_e", weight="w", weight_sum="s",
    )
    assert rows(got) == [("x", 1, 11.0, 2)]


# --- cooccurrence ------------------------------------------------------------------


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_cooccurrence_is_the_same_however_it_is_divided(spark, crowd):
    r = random.Random(7)
    data = [
        (r.choice(["a", "b", None]), r.choice([d(i) for i in range(12)] + [None]),
         r.choice([f"t{i}" for i in range(9)] + [None]))
        for _ in range(400)
    ]
    cells = {}
    for k, t, item in data:
        if k and t and item:
            cells.setdefault((k, t), set()).add(item)
    want = {}
    for (k, _), items in cells.items():
        for pair in itertools.combinations(sorted(items), 2):
            n, keys = want.setdefault(pair, [0, set()])
            want[pair] = [n + 1, keys | {k}]
    want = sorted((a, b, n, len(k)) for (a, b), (n, k) in want.items() if n >= 8)
    df = spark.createDataFrame(data, "k string, t date, x string")
    got = ops.cooccurrence(df, "k", "t", "x", 8, crowd=crowd)
    assert want and rows(got) == want


def test_repeated_rows_of_a_day_count_once(spark):
    df = spark.createDataFrame([("a", d(0), "x"), ("a", d(0), "x"), ("a", d(0), "y")], "k string, t date, x string")
    assert rows(ops.cooccurrence(df, "k", "t", "x", 1)) == [("x", "y", 1, 1)]


@pytest.mark.parametrize("crowd, width", [(1000, 1), (2, 3)])
def test_days_with_the_same_items_are_one_set(spark, crowd, width):
    """However many days repeat a set, pairs are expanded from one row of the key and set (or pair of its groups)."""
    marks = [(k, i, x) for k in "ab" for i in range(200) for x in ("xyzuvw" if i % 2 else "xy")]
    marks += [("a", 500 + i, f"lone{i}") for i in range(50)]
    df = spark.createDataFrame(marks, "k string, _day int, _item string")
    sets = ops.item_sets(df, "k", crowd).collect()
    assert len(sets) <= 2 * (1 + width * (width + 1) // 2) and {r["_days"] for r in sets} == {100}
    seen = {}
    for r in sets:
        for a, b in itertools.product(r["_left"], r["_right"]):
            if not r["_same"] or a < b:
                seen[r["k"], *sorted((a, b))] = seen.get((r["k"], *sorted((a, b))), 0) + r["_days"]
    want = {(k, a, b): 200 if (a, b) == ("x", "y") else 100 for k in "ab" for a, b in itertools.combinations("uvwxyz", 2)}
    assert seen == want


# --- rates -------------------------------------------------------------------------


def test_burstiness_needs_enough_days_and_guards_zero_mean(spark):
    data = [(k, d(i), v) for k, n, v in (("nine", 9, 1.0), ("ten", 10, 1.0), ("zero", 11, 0.0)) for i in range(n)]
    logs = spark.createDataFrame(data, "k string, t date, v double")
    events = spark.createDataFrame([("e", "ten", d(0)), ("e", "ten", d(1))], "i string, k string, t date")
    got = ops.burstiness(logs, events, "k", "t", "v", "i")
    assert rows(got) == [("ten", 1.0, 0.0, 0.0, 10, 1), ("zero", 0.0, 0.0, None, 11, 0)]


def test_calendar(spark):
    events = spark.createDataFrame(
        [("a", datetime.date(2023, 12, 31)), ("b", datetime.date(2024, 1, 1)), ("b", datetime.date(2024, 1, 1)), ("c", None)],
        "ids_incident_number string, dt_incident_occurred date",
    )
    t = {"incident": events}
    assert rows(incidents.by_day_of_week(t)) == [(1, 1), (2, 2)]
    assert rows(incidents.by_month(t)) == [(1, 2), (12, 1)]


def test_weeks_start_on_monday(spark):
    sunday, monday = datetime.date(2024, 1, 7), datetime.date(2024, 1, 8)
    events = spark.createDataFrame([("a", sunday), ("a", monday), (None, monday)], "k string, t date")
    busy = spark.createDataFrame([("a", datetime.date(2024, 1, 1))], "k string, t date")
    assert rows(ops.period_overlap(events, busy, "k", "t", "t")) == [(1, 2)]


def test_type_distribution_counts_rows_and_keeps_nulls(spark):
    events = spark.createDataFrame(
        [("x", None, True, False), ("x", None, True, False), (None, "s", None, None)],
        "cat_incident_type string, cat_osha_status string, is_trir boolean, is_ltir boolean",
    )
    got = [tuple(r) for r in incidents.type_distribution({"incident": events}).collect()]
    assert got == [("x", None, True, False, 2), (None, "s", None, None, 1)]


# --- profiles ----------------------------------------------------------------------


def test_table_stats_without_key_or_time(spark):
    a = spark.createDataFrame([("p", d(0)), ("p", d(5)), (None, None)], "k string, t date")
    b = spark.createDataFrame([(1,)], "x int")
    got = ops.table_stats({"a": a, "b": b}, "k", {"a": "t"})
    assert rows(got) == [("a", 3, 1, "t", d(0), d(5)), ("b", 1, None, None, None, None)]


def test_categorical_cut_and_ties(spark):
    data = [(f"v{i:03d}", i % 2 == 0) for i in range(150)] + [("v149", None)] * 2 + [(None, True)]
    df = spark.createDataFrame(data, "c string, flag boolean")
    got = ops.categorical_profile(df, ["c", "flag"], 100)
    c = sorted((tuple(r) for r in got.where("column = 'c'").collect()), key=lambda r: r[3])
    assert len(c) == 100
    assert c[0] == ("c", "v149", 3, 1) and c[1] == ("c", "v000", 1, 2)
    assert rows(got.where("column = 'flag'"), "value", "count") == sorted(
        [("true", 76), ("false", 75), (None, 2)], key=repr
    )


def nth(values, p):
    ordered = sorted(values)
    return ordered[math.ceil(round(p * 1000) * len(ordered) / 1000) - 1]


def test_exact_percentiles(spark):
    r = random.Random(3)
    data = []
    for i in range(997):
        data.append((
            r.gauss(0, 1) * 10 ** r.randrange(-8, 8), r.choice([0.0, -0.0, 1.0, None]),
            None, 7 if i == 0 else None, r.randrange(-5, 5),
        ))
    df = spark.createDataFrame(data, "wide double, few double, none double, one bigint, ints int").repartition(5)
    cols = ["wide", "few", "none", "one", "ints"]
    got = {r["column"]: r for r in ops.numeric_profile(df, cols).collect()}
    approx = {r["column"]: r for r in ops.numeric_profile(df, cols, accuracy=1_000_000).collect()}
    assert set(got) == set(cols)
    for i, c in enumerate(cols):
        values = [row[i] for row in data if row[i] is not None]
        line = got[c]
        assert line["count"] == len(values) and line["null_count"] == len(data) - len(values)
        for p in (0.25, 0.5, 0.75, 0.95, 0.99):
            want = float(nth(values, p)) if values else None
            assert line[f"p{round(p * 100)}"] == want
        for name in ("count", "null_count", "min", "max"):
            assert line[name] == approx[c][name]
        for name in ("mean", "std"):
            if approx[c][name] is None:
                assert line[name] is None
            else:
                assert math.isclose(line[name], approx[c][name], rel_tol=1e-9, abs_tol=1e-12)
    assert got["one"]["std"] is None and got["one"]["p50"] == 7.0


def test_percentiles_of_crowded_values(spark):
    values = [1.0 + k * 1e-12 for k in range(300)] * 2 + [1.0105] * 5
    df = spark.createDataFrame([(x, -x) for x in values], "x double, y double")
    up, down = ops.numeric_profile(df, ["x", "y"]).orderBy("column").collect()
    for p in (0.25, 0.5, 0.75, 0.95, 0.99):
        assert up[f"p{round(p * 100)}"] == nth(values, p)
        assert down[f"p{round(p * 100)}"] == nth([-x for x in values], p)


def test_percentiles_of_a_crowd_next_to_one_outlier(spark, monkeypatch):
    """No step counts the single values of a part: each has at most 2^16 counters."""
    n = 200_000
    df = spark.range(n).select((1 + F.col("id") * 1e-14).alias("x")).union(spark.createDataFrame([(1.01,)], "x double"))
    most, real = [], percentiles._locate

    def seen(values, at, inside, *part):
        counters = values.groupBy(*inside, *part).count().groupBy(*inside, *part[:-1]).count()
        most.append(counters.agg(F.max("count")).first()[0])
        return real(values, at, inside, *part)

    monkeypatch.setattr(percentiles, "_locate", seen)
    line = ops.numeric_profile(df, ["x"]).first()
    values = [1 + k * 1e-14 for k in range(n)] + [1.01]
    assert [line[f"p{p}"] for p in (25, 50, 75, 95, 99)] == [nth(values, p / 100) for p in (25, 50, 75, 95, 99)]
    assert most and max(most) <= 1 << 16


def test_percentiles_hold_whatever_the_sketch_says(spark, monkeypatch):
    """Brackets that miss their rank cost another cut, never the result."""
    r = random.Random(13)
    values = [r.gauss(0, 1) * 10 ** r.randrange(-3, 9) for _ in range(5_000)]
    df = spark.createDataFrame([(x,) for x in values], "x double").repartition(6)
    real = percentiles._summary
    for wrong in ([-1.0] * 10, [1e12] * 10, sorted(r.sample(values, 10)), [values[0], values[0] + 1e-9] * 5):
        likely = F.array(*[F.lit(float(x)) for x in wrong])
        monkeypatch.setattr(percentiles, "_summary", lambda *a, x=likely: real(*a).withColumn("_likely", x))
        line = ops.numeric_profile(df, ["x"]).first()
        assert [line[f"p{p}"] for p in (25, 50, 75, 95, 99)] == [nth(values, p / 100) for p in (25, 50, 75, 95, 99)]


def test_percentiles_take_two_rounds(spark):
    """Many values, spread and discrete: a sketch and one count settle all ranks."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("percentiles", "")
    try:
        df = spark.range(100_000).select(
            (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1000).alias("spread"), F.pmod("id", F.lit(50)).cast("double").alias("steps")
        )
        calls, real = [], percentiles._locate
        percentiles._locate = lambda *a: calls.append(1) or real(*a)
        found = ops.numeric_profile(df, ["spread", "steps"])
    finally:
        percentiles._locate = real
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(calls) == 1 and tracker.getJobIdsForGroup("percentiles")
    want = sorted(x["spread"] for x in df.select("spread").collect())
    line = found.where("column = 'spread'").first()
    assert line["p99"] == nth(want, 0.99) and line["p25"] == nth(want, 0.25)


def test_percentiles_of_special_values_and_empty_table(spark):
    inf = float("inf")
    data = [(x,) for x in (-inf, -1e308, -5e-324, 0.0, 5e-324, 2.0, 1.7e308, inf, float("nan"))]
    df = spark.createDataFrame(data, "x double")
    line = ops.numeric_profile(df, ["x"]).first()
    assert line["min"] == -inf and math.isnan(line["max"])
    assert (line["p25"], line["p50"], line["p75"]) == (-5e-324, 5e-324, 1.7e308)
    assert math.isnan(line["p99"])
    empty = ops.numeric_profile(df.limit(0), ["x"]).first()
    assert (empty["count"], empty["null_count"], empty["p50"]) == (0, 0, None)


def test_percentile_probs_are_checked(spark):
    long = spark.createDataFrame([("a", 1.0)], "column string, x double")
    with pytest.raises(ValueError):
        ops.distributions(long, ["column"], [0.12345])


def test_inventory(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    df = df.select(F.col("x").alias("x", metadata={"comment": "a number"}), "y")
    assert rows(ops.table_inventory({"t": df})) == [
        ("t", 1, "x", "int", "a number", 1), ("t", 2, "y", "string", None, 1),
    ]


def test_key_match(spark):
    hub = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "k string")
    facts = {
        "f": spark.createDataFrame([("a",), ("a",), ("x",), ("x",), (None,), (None,)], "k string"),
        "empty": spark.createDataFrame([], "k string"),
    }
    assert rows(ops.key_match(hub, facts, "k")) == [
        ("empty", 3, 0, 0.0, 0, 0), ("f", 3, 1, 0.3333, 2, 1),
    ]


# --- samples -----------------------------------------------------------------------


def test_samples(spark):
    df = spark.createDataFrame([(i, None if i % 2 else True) for i in range(30)], "i int, b boolean")
    got = ops.sample_rows(df, 3, ["i"])
    assert [tuple(r) for r in got.collect()] == [("0", "true"), ("1", None), ("2", "true")]
    assert ops.sample_rows(df, 7).count() == 7


def test_top_keys_cut_inside_a_tie_and_null_key(spark):
    keys = ["a"] * 2 + ["b"] * 2 + ["c"] * 2 + [None] * 3
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    top = ops.top_keys(df, "k", 3)
    assert [tuple(r) for r in top.collect()] == [(None, 3), ("a", 2), ("b", 2)]
    got = ops.sample_for_keys(df, top, "k", 3, ["i"])
    assert [r.i for r in got.collect()] == ["0", "1", "2"]


# --- graph -------------------------------------------------------------------------


def test_edges_drop_unknown_keys_and_keep_undated(spark):
    hub = spark.createDataFrame([("a",), ("a",)], "k string")
    f = spark.createDataFrame([("a", d(0)), ("a", d(0)), ("a", None), ("x", d(0)), (None, d(0))], "k string, t date")
    got = ops.fk_edges(hub, {"f": f, "g": f.select("k")}, "k", {"f": "t"})
    day = (d(0) - datetime.date(1970, 1, 1)).days
    assert rows(got) == sorted(
        [("f", "hub", "a", d(0), day, 2), ("f", "hub", "a", None, None, 1), ("g", "hub", "a", None, None, 4 - 1)],
        key=repr,
    )


def test_label_window_ends(spark):
    hub = spark.createDataFrame([(k,) for k in "abcdef"], "k string")
    anchors = spark.createDataFrame([(d(0),), (d(0),), (None,)], "anchor date")
    active = spark.createDataFrame(
        [("a", d(0)), ("b", d(-6)), ("c", d(-7)), ("d", d(1)), ("e", d(-1)), ("x", d(0))], "k string, t date"
    )
    target = spark.createDataFrame([("a", d(0)), ("a", d(8)), ("b", d(7)), ("e", d(1))], "k string, t date")
    got = ops.label_table(hub, target, active, anchors, "k", "t", "t")
    assert rows(got) == [("a", d(0), False), ("b", d(0), True), ("e", d(0), True)]


def test_edges_hold_from_their_beginning_to_the_day_before_their_end(spark):
    """Facts that begin, end, stay open, end as they begin, end before, or never begin; against day by day."""
    r = random.Random(17)
    facts = [
        (r.choice(["a", "b", "c", None]), r.choice([None, d(r.randrange(40))]), r.choice([None, d(r.randrange(-5, 60))]))
        for _ in range(300)
    ]
    hub = spark.createDataFrame([("a",), ("b",)], "k string")
    days = [d(x) for x in (-3, 0, 1, 2, 17, 39, 70)]
    f = spark.createDataFrame(facts, "k string, t date, e date")
    edges = ops.fk_edges(hub, {"f": f, "g": f.select("k", "t")}, "k", {"f": "t", "g": "t"}, end_cols={"f": "e"})
    anchors = spark.createDataFrame([(a,) for a in [*days, days[0], None]], "anchor date")
    want = []
    for table, ends in (("f", True), ("g", False)):
        for k in "ab":
            for a in days:
                n = sum(x == k and t is not None and t <= a and (not ends or e is None or a < e) for x, t, e in facts)
                want += [(table, "hub", k, a, n)] * (n > 0)
    assert rows(ops.edges_at(edges, anchors, "k")) == sorted(want, key=repr)
    assert ops.edges_at(edges, anchors.limit(0), "k").count() == 0


def test_labels_for_many_windows(spark):
    """Against one anchor, key and window at a time; dense and sparse anchors."""
    r = random.Random(19)
    some = lambda n: [(r.choice(["a", "b", "c", "x", None]), r.choice([None, d(r.randrange(60))])) for _ in range(n)]
    hub = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "k string")
    active, target = some(25), some(25)
    days = [d(x) for x in [*range(10, 20), 35, 59, 64]]
    windows = [(1, 1), (7, 7), (3, 40), (30, 2), (7, 7)]
    got = ops.label_windows(
        hub, spark.createDataFrame(target, "k string, t date"), spark.createDataFrame(active, "k string, u date"),
        spark.createDataFrame([(a,) for a in days], "anchor date"), "k", "t", "u", windows,
    )
    want = []
    for h, b in dict.fromkeys(windows):
        for k in "abc":
            for a in days:
                if any(x == k and u and 0 <= (a - u).days < b for x, u in active):
                    want.append((h, b, k, a, any(x == k and t and 0 < (t - a).days <= h for x, t in target)))
    assert rows(got) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        ops.label_windows(hub, hub, hub, hub, "k", "t", "u", [])


def test_registry_against_data(spark):
    spec = {
        "hub": sources.TableSpec(primary_key="k"),
        "f": sources.TableSpec(foreign_keys={"k": "hub"}, time_col="t", end_time_col="e"),
        "bare": sources.TableSpec(foreign_keys={"k": "hub"}, time_col="gone"),
    }
    tables = {
        "hub": spark.createDataFrame([("a",), ("a",), (None,)], "k string"),
        "f": spark.createDataFrame([("a", d(0), d(0)), ("x", d(1), d(0)), (None, None, None)], "k string, t date, e date"),
        "bare": spark.createDataFrame([(1,), (2,)], "v int"),
        "other": spark.range(3),
    }
    assert rows(ops.check_registry(tables, spec)) == sorted([
        ("hub", "k", "primary_key", 3, 2, 1), ("f", "t", "time", 3, 2, 2), ("f", "e", "end_time", 3, 2, 2),
        ("f", "k", "foreign_key", 3, 2, 1), ("bare", "gone", "time", 2, 0, 0), ("bare", "k", "foreign_key", 2, 0, 0),
    ], key=repr)


def test_latest_matches_a_ranking_window(spark):
    r = random.Random(5)
    data = [(r.choice("abc"), r.choice([None, d(0), d(1)]), r.choice([None, "x", "y"])) for _ in range(60)]
    df = spark.createDataFrame(data, "k string, t date, v string").repartition(6)
    df.createOrReplaceTempView("history")
    want = spark.sql(
        "SELECT DISTINCT k, first_value(v) OVER "
        "(PARTITION BY k ORDER BY t DESC NULLS LAST, v DESC NULLS LAST) AS v FROM history"
    )
    assert of_frame(ops.latest_per_key(df, "k", ["t"], ["v"])) == of_frame(want)
