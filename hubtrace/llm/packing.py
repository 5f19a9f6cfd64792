"""Packing into optimal length buckets.

Bucket bounds come from the histogram of all lengths by dynamic programming: of
all ways to choose at most `n_buckets` bounds, the one with the least padding in
total. Inside a bucket, batches take as many sequences as a token budget
allows. Documents longer than `max_length` are cut into pieces, so the histogram has at
most max_length + 1 lines and nothing is dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubtrace.llm.common import settle

MAX_LENGTH, N_BUCKETS, TOKEN_BUDGET = 4096, 8, 65_536
#: Rows that one task numbers, about.
TASK_ROWS = 50_000


def optimal_bounds(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """Ascending bounds (each an occurring length, the last the greatest) with the least padding.

    Among equally good choices the one with fewer buckets, then with smaller
    bounds from the top. An empty histogram has no bounds.
    """
    lengths = sorted(k for k, n in histogram.items() if n > 0)
    if not lengths:
        return []
    size = np.array(lengths, dtype=np.int64)
    count = np.array([histogram[x] for x in lengths], dtype=np.int64)
    rows = np.concatenate(([0], np.cumsum(count)))
    tokens = np.concatenate(([0], np.cumsum(count * size)))
    m = len(lengths)
    # best[j]: least padding of the j smallest lengths in k buckets; cut[k][j]: where the last one begins.
    big = np.iinfo(np.int64).max // 4
    best = np.full(m + 1, big)
    best[0] = 0
    cuts, totals = [], []
    for _ in range(min(n_buckets, m)):
        base = best + tokens
        new, cut = np.full(m + 1, big), np.zeros(m + 1, dtype=np.int64)
        for j in range(1, m + 1):
            cost = base[:j] + size[j - 1] * (rows[j] - rows[:j]) - tokens[j]
            cut[j] = int(cost.argmin())
            new[j] = min(int(cost[cut[j]]), big)
        best = new
        cuts.append(cut)
        totals.append(int(best[m]))
    k = int(np.argmin(totals))
    bounds, j = [], m
    while j > 0:
        bounds.append(int(size[j - 1]))
        j = int(cuts[k][j])
        k -= 1
    return bounds[::-1]


def pack(
    docs: DataFrame,
    length: Column,
    id_col: str = "doc_id",
    max_length: int = MAX_LENGTH,
    n_buckets: int = N_BUCKETS,
    token_budget: int = TOKEN_BUDGET,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """One row per piece of a document: id, piece, start, n_tokens, bucket, batch, slot, padding.

    bucket is its bound; batch numbers from 0 within a bucket, slot from 0 within a
    batch. A batch holds max(1, token_budget // bucket) rows; only the last one of a
    bucket may hold fewer. A null, zero or negative length gives one piece of length 0
    (bound 0 if all are). Ids may be null or repeat: every row is packed.
    Other columns are not used; an empty table gives no rows.
    """
    whole = docs.select(
        F.col(id_col).alias("_id"),
        F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("_n"),
    )
    last = F.greatest(F.ceil(F.col("_n") / max_length) - 1, F.lit(0)).cast("long")
    pieces = settle(whole.select("_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "_id", "piece", (F.col("piece") * max_length).alias("start"),
        F.least(F.col("_n") - F.col("piece") * max_length, F.lit(max_length)).alias("n_tokens"),
    ))
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    bounds = optimal_bounds(histogram, n_buckets)
    if not bounds:
        bounds = [0]
    held = {b: 0 for b in bounds}
    for n, many in histogram.items():
        held[next(b for b in bounds if n <= b)] += many

    def by_bound(value) -> Column:
        return F.coalesce(*[F.when(F.col("bucket") == b, F.lit(value(b))) for b in bounds])

    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in bounds]).cast("long")
    # Pieces are settled, so a row's place in its file is its own: equal rows are dealt to different salts too.
    hashed = F.xxhash64("_id", "piece", "n_tokens", F.monotonically_increasing_id())
    dealt = pieces.withColumn("bucket", bucket).withColumn("_hash", hashed).withColumn(
        "_salt", F.pmod("_hash", by_bound(lambda b: max(1, -(-held[b] // task_rows))).cast("long"))
    )
    # Numbers run on over the salts of a bucket, so that batches fill up across them. One column names a bucket's salt:
    # were it two, Spark could bring the rows together by bucket alone.
    dealt = dealt.withColumn("_cell", F.shiftleft("bucket", 32) + F.col("_salt"))
    sizes = dealt.groupBy("bucket", "_salt", "_cell").agg(F.count("*").alias("_many"))
    before = F.sum("_many").over(Window.partitionBy("bucket").orderBy("_salt")) - F.col("_many")
    offsets = sizes.select("_cell", before.alias("_before"))
    order = Window.partitionBy("_cell").orderBy("_hash", "_id", "piece", "n_tokens")
    numbered = dealt.withColumn("_row", F.row_number().over(order) - 1).join(offsets, "_cell")
    place = F.col("_before") + F.col("_row")
    fits = by_bound(lambda b: max(1, token_budget // max(b, 1))).cast("long")
    return numbered.select(
        F.col("_id").alias(id_col), "piece", "start", "n_tokens", "bucket",
        F.floor(place / fits).alias("batch"), F.pmod(place, fits).alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
