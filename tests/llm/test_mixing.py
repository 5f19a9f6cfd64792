import hashlib
import math
import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import canonical, of_frame
from hubtrace.llm import queries
from hubtrace.llm.mixing import cycled_weights, mix, running_totals, targets, time_of, training_order
from llm_docs import CLASHING

SCHEDULES = queries.SCHEDULES


def water_filled(sizes, weights, most=3):
    """Shares of the whole by weight; what is above a cap is shared anew until nothing is."""
    total = sum(sizes.values())
    target, capped = {}, set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_weight = sum(w for s, w in weights.items() if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * w / open_weight for s, w in weights.items()}
        above = {s for s in weights if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def brute(rows, seed=42):
    """(id, size, source_size, target, taken) of rows (id, text, source), word by word."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = [(i, size(t), s) for i, t, s in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: 1 + k % 3 for k, s in enumerate(sources)}
    sizes = {s: sum(n for _, n, x in rows if x == s) for s in sources}
    target = water_filled(sizes, weights) if sum(sizes.values()) else dict.fromkeys(sources, 0.0)
    out = []
    for s in sources:
        own = sorted(
            (hashlib.md5(f"{seed}:{'null' if i is None else i}:{n}".encode()).hexdigest(), i is not None, i or 0, n)
            for i, n, x in rows if x == s
        )
        left, taken = math.floor(target[s] + 0.5), [0] * len(own)
        for _ in range(3):
            for k, (_, _, _, n) in enumerate(own):
                taken[k] += min(n, left)
                left -= min(n, left)
        out += [
            (i if known else None, n, sizes[s], round(float(target[s]), 6), t)
            for (_, known, i, n), t in zip(own, taken)
        ]
    return out


def mixed(spark, rows, extra=()):
    names = "".join(f", `{c}` string" for c in extra)
    docs = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "doc_id bigint, text string, source string" + names)
    return mix(docs, cycled_weights(docs, (1, 2, 3), SCHEDULES))


def plain(df):
    return sorted(
        ((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect()), key=repr
    )


def test_against_word_by_word(spark):
    rng = random.Random(1)
    for trial in range(3):
        rows = []
        for source, many in zip(["b", "a", "Z", "é", "😀", None, ""], [400, 3, 30, 1, 60, 9, 2]):
            rows += [
                (rng.choice([None, rng.randrange(300)]), rng.choice([None, "", "w " * rng.randrange(40)]), source)
                for _ in range(many)
            ]
        rows += [(7, "the same row", "b")] * 50
        assert plain(mixed(spark, rows)) == sorted(brute(rows), key=repr)


def test_defined_cases(spark):
    assert mixed(spark, []).count() == 0
    assert plain(mixed(spark, [(1, None, None), (None, "", "a")])) == [(1, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)]
    # one source: everything once
    assert plain(mixed(spark, [(1, "a b", "s"), (1, "a b", "s")])) == [(1, 2, 4, 4.0, 2)] * 2
    clash = [c for c in CLASHING if c != "size"] + ["size", "target", "taken", "weight", "levels", "_copies", "_start", "_of"]
    rows = [(k, "w " * k, "ab"[k % 2]) for k in range(20)] + [(3, "long " * 50_000, "c")]
    assert plain(mixed(spark, rows, clash)) == sorted(brute(rows), key=repr)


def test_many_copies_are_spread(spark):
    """25,000 equal rows are one key, expanded again in stretches."""
    docs = spark.range(25_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    docs = docs.unionByName(spark.createDataFrame([(6, "d", "t")], docs.schema))
    out = mix(docs, cycled_weights(docs, (1, 2, 3), SCHEDULES)).where("source = 's'")
    found = out.agg(F.count("*"), F.sum("taken"), F.count_distinct("positions"), F.max(F.size("positions"))).first()
    # the other source stops at three words, so this one gets the rest
    assert tuple(found) == (25_000, 74_998, 25_000, 1)
    assert out.where("taken > 3 * size").isEmpty()


def test_times_follow_the_schedules(spark):
    """Among the positions of a source, the share before time t is the integral of its schedule."""
    rows = [(k, "w " * 5, "abc"[k % 3]) for k in range(3000)]
    times = defaultdict(list)
    for r in mixed(spark, rows).collect():
        times[r["source"]] += r["positions"]
    for source, (a, b) in zip("abc", SCHEDULES):
        own = times[source]
        assert min(own) >= 0 and max(own) < 1
        for t in (0.1, 0.25, 0.5, 0.8):
            share = (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
            assert sum(x < t for x in own) / len(own) == pytest.approx(share, abs=0.005)


def test_inverse_of_any_schedule(spark):
    def demand(levels, t):
        n, done = len(levels) - 1, 0.0
        for k in range(n):
            part = min(max(t * n - k, 0), 1)
            done += levels[k] * part + (levels[k + 1] - levels[k]) * part * part / 2
        return done

    cases = [
        (q / 10, levels) for q in range(11)
        for levels in ([1.0, 1.0], [0.0, 2.0], [2.0, 0.0], [1.0, 0.0, 0.0, 4.0], [3.0, 1.0, 2.0], [0.0, 0.0, 1.0])
    ]
    frame = spark.createDataFrame(cases, "q double, levels array<double>")
    for r in frame.select("q", "levels", time_of(F.col("q"), F.col("levels")).alias("t")).collect():
        assert demand(r["levels"], r["t"]) == pytest.approx(r["q"] * demand(r["levels"], 1.0), abs=1e-9)
    flat = spark.createDataFrame([(0.3, [0.0, 0.0])], "q double, levels array<double>")
    assert flat.select(time_of(F.col("q"), F.col("levels"))).first()[0] == 0.3


def test_caps_are_reshared(spark):
    rng = random.Random(2)
    sizes = {f"s{k}": rng.choice([0, 1, 5, 100, 4000]) for k in range(40)}
    weights = {s: rng.choice([1, 2, 3, 10]) for s in sizes}
    frame = spark.createDataFrame([(s, sizes[s], float(weights[s])) for s in sizes], "source string, source_size long, weight double")
    found = {r["source"]: r["target"] for r in targets(frame).collect()}
    wanted = water_filled(sizes, weights)
    assert found == {s: pytest.approx(wanted[s]) for s in sizes}


def test_training_order_and_reruns(spark):
    rows = [(k, "w " * (k % 7), "abcd"[k % 4]) for k in range(500)]
    out = mixed(spark, rows)
    order = [tuple(r) for r in training_order(out).collect()]
    assert [r[3] for r in order] == sorted(r[3] for r in order)
    per_doc = defaultdict(int)
    for doc, _, _, _, n in order:
        per_doc[doc] += n
    assert per_doc == {r["doc_id"]: r["taken"] for r in out.collect() if r["taken"]}
    again = [tuple(r) for r in training_order(mixed(spark, rows[::-1])).collect()]
    assert order == again


def test_running_totals(spark):
    frame = spark.range(1000).select(F.col("id"), F.pmod(F.col("id") * 37, F.lit(11)).alias("v"))
    found = {r["id"]: r["s"] for r in running_totals(frame, [F.col("id")], {"s": F.col("v")}).collect()}
    done = 0
    for k in range(1000):
        assert found[k] == done
        done += k * 37 % 11


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.execute(queries.oracle_sql()["op12_mixing"])
    theirs = canonical([c[0] for c in found.description], found.fetchall())
    assert of_frame(queries.op12_mixing(spark, sf)) == theirs
