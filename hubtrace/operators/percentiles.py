"""Exact distributions of numbers by counting, without sorting the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERCENTILES = (0.25, 0.50, 0.75, 0.95, 0.99)
_PARTS = 1 << 16
_CUTS = 4
#: Size of the sketch that brackets the ranks, and the share of ranks a bracket reaches to either side: several
#: times the sketch's usual error. Only speed hangs on it.
_SKETCH, _REACH = 4096, 0.004


def long_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, x)`` with every number as double and -0.0 folded into 0.0."""
    names = [F.col(f"`{c}`") for c in cols]
    doubles = df.select(*[(c.cast("double") + 0.0).alias(n) for c, n in zip(names, cols)])
    return doubles.unpivot([], names, "column", "x")


def distributions(
    long: DataFrame, series: Sequence[str], probs: Sequence[float] = PERCENTILES
) -> DataFrame:
    """Count, NULLs, range, mean, sample deviation and percentiles of each series of ``x``.

    The value at percentile ``p`` of ``n`` values is the one at rank
    ``ceil(p * n)``. Ranks are found by counting, in two scans as a rule:

    1. a quantile sketch of each series, with the other statistics, gives two values that the
       value at a rank very likely lies between;
    2. values are counted by bracket: between brackets all together, inside a bracket by 2^16 equal parts. The
       counts, which are exact, tell which part holds the rank.

    A part whose least and greatest value agree is done. One that holds several values, or a stretch
    outside the brackets should the sketch have missed, is cut into 2^16 parts again, with those
    parts alone. No step counts single values, and no task and no merge ever holds the values of a series.

    Each round is a job that runs while the plan is built: what it finds, a line per series and
    percentile, comes to the driver and shapes the next one. Nothing is written.
    """
    series = list(series)
    thousandths = [round(p * 1000) for p in probs]
    if any(abs(p * 1000 - t) > 1e-9 or not 0 < t <= 1000 for p, t in zip(probs, thousandths)):
        raise ValueError("probs must be whole thousandths in (0, 1]")

    lines = _summary(long, series, thousandths).collect()
    summary = long.sparkSession.createDataFrame(lines, _summary_type(long, series))
    inside = [*series, "_bracket", "_part"]
    values = _bracketed(long.where("x IS NOT NULL"), lines, series, len(thousandths))
    asked = summary.select(*series, F.explode(F.array(*[
        F.struct(F.lit(t).alias("_t"), F.expr(f"(count * {t} + 999) div 1000").alias("_rank")) for t in thousandths
    ])).alias("_a")).select(*series, "_a.*").where("_rank > 0")
    at = _at_hand(_locate(values, asked, series, "_bracket", "_part"))
    found = [_settled(at, series)]
    for cut in range(_CUTS):
        at = at.where("_lo < _hi")
        if at.isEmpty():
            break
        values = _split(values, at, inside, f"_part{cut}")
        at = _at_hand(_locate(values, at, inside, f"_part{cut}"))
        inside = [*inside, f"_part{cut}"]
        found.append(_settled(at, series))
    wide = reduce(DataFrame.unionByName, found).groupBy(*series).agg(
        *[
            F.max(F.when(F.col("_t") == t, F.col("x"))).alias(percentile_name(p))
            for p, t in zip(probs, thousandths)
        ]
    )
    return summary.drop("_likely").join(wide, series, "left")


def _settled(at: DataFrame, series: list[str]) -> DataFrame:
    """Ranks whose bin, part or value leaves one possible answer."""
    return at.where("_lo = _hi").select(*series, "_t", F.col("_lo").alias("x"))


def percentile_name(p: float) -> str:
    return f"p{p * 100:g}"


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def _summary(long: DataFrame, series: list[str], thousandths: list[int]) -> DataFrame:
    """One line per series: its statistics, and two values around each percentile in ``_likely``."""
    x = F.col("x")
    ranks = [min(max(t / 1000 + d, 0.0), 1.0) for t in thousandths for d in (-_REACH, _REACH)]
    sketch = F.kll_sketch_agg_double(F.when(_finite(x), x), F.lit(_SKETCH))
    lines = long.groupBy(*series).agg(
        F.count(x).alias("count"),
        F.count_if(x.isNull()).alias("null_count"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.count_if(_finite(x)).alias("_finite"),
        sketch.alias("_sketch"),
    )
    likely = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(r) for r in ranks]))
    return lines.select(
        *series, "count", "null_count", "min", "max", "mean", "std",
        F.when(F.col("_finite") > 0, likely).alias("_likely"),
    )


def _summary_type(long: DataFrame, series: list[str]) -> T.StructType:
    names = {"count": T.LongType(), "null_count": T.LongType()}
    names |= dict.fromkeys(["min", "max", "mean", "std"], T.DoubleType())
    names["_likely"] = T.ArrayType(T.DoubleType())
    return T.StructType([long.schema[c] for c in series] + [T.StructField(n, t) for n, t in names.items()])


def _bracketed(long: DataFrame, lines: list[Row], series: list[str], asked: int) -> DataFrame:
    """Values with their bracket, an integer that never falls as ``x`` rises, and their part of it.

    The ends of all brackets of a series, in order, are brackets of their own, as are the infinities and NaN, which
    sorts above them. What lies between two ends is cut into parts only where a bracket covers it.
    """
    bounds = []
    for line in lines:
        likely = line["_likely"] or []
        pairs = list(zip(likely[::2], likely[1::2]))
        ends = sorted(likely)
        covered = [any(lo <= a and b <= hi for lo, hi in pairs) for a, b in zip(ends, ends[1:])]
        bounds.append((*[line[c] for c in series], ends, [False, *covered, False]))
    schema = T.StructType(
        [long.schema[c] for c in series]
        + [T.StructField("_ends", T.ArrayType(T.DoubleType())), T.StructField("_cut", T.ArrayType(T.BooleanType()))]
    )
    # One line a series.
    known = F.broadcast(long.sparkSession.createDataFrame(bounds, schema))
    x, k = F.col("x"), F.col("_k")
    passed = reduce(Column.__add__, [(x > F.get("_ends", F.lit(i))).cast("int") for i in range(2 * asked)])
    met = long.join(known, series).withColumn("_k", F.coalesce(F.when(_finite(x), passed), F.lit(0)))
    low, high = F.get("_ends", k - 1), F.get("_ends", k)
    on_end = F.coalesce(x == high, F.lit(False))
    bracket = 2 * k + on_end.cast("int")
    top = 4 * asked
    bracket = F.when(F.isnan(x), F.lit(top + 2)).when(x == float("inf"), F.lit(top + 1)).when(
        x == -float("inf"), F.lit(-1)
    ).otherwise(bracket)
    place = F.greatest(F.least(F.floor((x - low) / (high - low) * _PARTS), F.lit(_PARTS - 1)), F.lit(0))
    inner = _finite(x) & F.get("_cut", k) & ~on_end
    return met.select(
        *series, "x", bracket.alias("_bracket"), F.coalesce(F.when(inner, place), F.lit(0)).cast("int").alias("_part")
    )


def _at_hand(df: DataFrame) -> DataFrame:
    """A few lines, a bounded number per column profiled, as a table of the driver."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _split(values: DataFrame, at: DataFrame, inside: list[str], part: str) -> DataFrame:
    """The values of the asked parts, each with its place when the part is cut into equal ones."""
    # At most one part per series and percentile, so this list can be broadcast.
    asked = F.broadcast(at.select(*inside, "_lo", "_hi").distinct())
    share = (F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    place = F.least(F.floor(share * _PARTS), F.lit(_PARTS - 1))
    return values.join(asked, inside).select(
        *inside, "x", F.greatest(place, F.lit(0)).cast("int").alias(part)
    )


def _locate(values: DataFrame, asked: DataFrame, group: list[str], *item: str) -> DataFrame:
    """For each asked rank within a group, the item holding it and the rank inside it."""
    counts = values.groupBy(*group, *item).agg(
        F.count("*").alias("_n"), F.min("x").alias("_lo"), F.max("x").alias("_hi")
    )
    running = (
        Window.partitionBy(*group)
        .orderBy(*item)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = counts.withColumn("_upto", F.sum("_n").over(running))
    return (
        upto.join(F.broadcast(asked.select(*group, "_t", "_rank")), group)
        .where("_rank <= _upto AND _rank > _upto - _n")
        .select(
            *group, *item, "_lo", "_hi", "_t", F.expr("_rank - (_upto - _n)").alias("_rank")
        )
    )
