import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hubtrace.llm.packing import optimal_bounds, pack
from llm_docs import docs_of


def padding(histogram, bounds):
    return sum(n * (next(b for b in bounds if b >= x) - x) for x, n in histogram.items())


def test_bounds_are_optimal():
    rng = random.Random(0)
    for _ in range(60):
        histogram = {rng.randint(0, 30): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        k = rng.randint(1, 5)
        top, rest = max(histogram), sorted(histogram)[:-1]
        best = min(
            padding(histogram, [*c, top]) for n in range(min(k, len(histogram))) for c in itertools.combinations(rest, n)
        )
        bounds = optimal_bounds(histogram, k)
        assert len(bounds) <= k and bounds == sorted(set(bounds)) and padding(histogram, bounds) == best
    assert optimal_bounds({}, 3) == []


@pytest.mark.parametrize("task_rows", [3, 1000])
def test_batches(spark, task_rows):
    rng = random.Random(2)
    lengths = {i: rng.choice([1, 2, 3, 5, 40, 100, 101, 260]) for i in range(300)}
    docs = spark.createDataFrame(list(lengths.items()), "doc_id bigint, n bigint")
    rows = pack(docs, F.col("n"), max_length=100, n_buckets=3, token_budget=400, task_rows=task_rows).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["n_tokens"]))
    for i, n in lengths.items():
        assert sorted(pieces[i]) == [(s, min(100, n - s)) for s in range(0, n, 100)]
    histogram = defaultdict(int)
    for r in rows:
        histogram[r["n_tokens"]] += 1
    assert sum(r["padding"] for r in rows) == padding(histogram, optimal_bounds(histogram, 3))
    batches = defaultdict(list)
    for r in rows:
        assert r["n_tokens"] <= r["bucket"]
        batches[r["bucket"], r["batch"]].append(r["slot"])
    for bucket in {b for b, _ in batches}:
        full, last = 400 // bucket, max(n for b, n in batches if b == bucket)
        for n in range(last + 1):
            slots = sorted(batches[bucket, n])
            assert slots == list(range(len(slots))) and (len(slots) == full or n == last)


def test_odd_rows(odd_docs, no_docs):
    rows = pack(odd_docs, F.length("text"), max_length=50_000).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_docs.collect()}
    assert sum(r["n_tokens"] for r in rows) == sum(len(r["text"] or "") for r in odd_docs.collect())
    assert pack(no_docs, F.length("text")).count() == 0
    zero = pack(odd_docs, F.lit(None)).collect()
    assert len(zero) == odd_docs.count() and {(r["bucket"], r["n_tokens"]) for r in zero} == {(0, 0)}


def test_repeated_ids(spark):
    docs = docs_of(spark, [(1, "a b"), (1, "a b"), (None, "c")])
    assert pack(docs, F.length("text")).count() == 3


def test_equal_rows_are_dealt_over_tasks(spark):
    """5,000 rows without an id and of one length: no task numbers more than a few times task_rows."""
    docs = spark.range(5_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"))
    old = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = pack(docs, F.lit(4), task_rows=100, token_budget=40)
        rows = out.select("batch", "slot", F.spark_partition_id().alias("task")).collect()
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
    assert max(Counter(r["task"] for r in rows).values()) <= 600
    assert sorted((r["batch"], r["slot"]) for r in rows) == [(k // 10, k % 10) for k in range(5_000)]
