"""Mixing sources to target weights along a curriculum.

A source has a weight, which fixes how many words the mix takes of it, and a schedule, which says
when: the density of its words over the training time from 0 to 1. The integral of the
schedule is the cumulative demand; inverting it gives each document the time at which the source's
demand reaches its first word. Sorting by that time is the order of training.

Built-in functions only. No source is gathered: running totals are taken over range-sorted tables, so a
source that holds a third of all rows is spread over as many tasks as its rows ask for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubtrace.llm.common import let, settle, words_of

MAX_REPEATS = 3
#: Equal rows that one task expands at a time.
COPIES = 10_000


def running_totals(df: DataFrame, order: Sequence[Column], values: Mapping[str, Column]) -> DataFrame:
    """The rows of `df` with the totals of `values` over all rows before, in the given order.

    Rows are sorted by range and settled, so that a row keeps its range. A range adds what the ranges
    before it hold: one line per range meets in one task, never one per row.
    """
    placed = settle(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in values.items()])
    ahead = Window.orderBy("_range")
    offsets = sums.select(
        "_range", *[(F.sum(f"_sum_{n}").over(ahead) - F.col(f"_sum_{n}")).alias(f"_before_{n}") for n in values]
    )
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row a range: as many as the shuffle has partitions.
    return placed.join(F.broadcast(offsets), "_range").select(
        *df.columns, *[(F.col(f"_before_{n}") + F.sum(c).over(own) - c).alias(n) for n, c in values.items()]
    )


def cycled_weights(
    docs: DataFrame, weights: Sequence[float], schedules: Sequence[Sequence[float]], source_col: str = "source"
) -> DataFrame:
    """Rows (source, weight, levels): sources in order of code points, null last, take the weights in turn.

    `levels` are the heights of a source's schedule at evenly spaced times from 0 to 1, two or more; the
    schedule runs straight between them.
    """
    sources = docs.select(F.col(source_col).cast("string").alias("source")).distinct()
    ranked = running_totals(sources, [F.asc_nulls_last("source")], {"_rank": F.lit(1).cast("long")})
    turn = F.pmod("_rank", F.lit(len(weights)).cast("long")).cast("int")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    levels = F.get(F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules]), turn)
    return ranked.select("source", weight.alias("weight"), levels.alias("levels"))


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds `target` to rows (source, source_size, weight): shares of all words by weight, capped and reshared.

    A target stops at `max_repeats` times its source's size; the excess goes to the others by weight,
    until none is above. That is one level that all uncapped sources share: with sources in order of cap over weight, it
    is the greatest of (total - caps before) / (weights from here on). Sources
    without a positive weight get 0.
    """
    cap = F.col("source_size") * max_repeats
    positive = sources.where("weight > 0").withColumn("_cap", cap)
    total = sources.agg(F.sum("source_size").alias("words"), F.sum(F.when(F.col("weight") > 0, F.col("weight"))).alias("w")).first()
    if not total["words"] or not total["w"]:
        return sources.withColumn("target", F.lit(0.0))
    ahead = running_totals(
        positive, [F.col("_cap") / F.col("weight"), F.asc_nulls_last("source")],
        {"_caps": F.col("_cap"), "_weights": F.col("weight")},
    )
    level = ahead.agg(F.max(
        (F.lit(total["words"]).cast("long") - F.col("_caps")).cast("double") / (F.lit(total["w"]) - F.col("_weights"))
    )).first()[0]
    share = F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    return sources.withColumn("target", F.when(F.col("weight") > 0, share).otherwise(F.lit(0.0)))


def time_of(share: Column, levels: Column) -> Column:
    """The time at which a schedule has reached a share (0 to 1) of its whole demand.

    Between two levels the demand is a parabola; its inverse is written so that level and sloping
    stretches need no cases. A schedule that is 0 everywhere counts as level.
    """

    def along(own: Column) -> Column:
        many = F.size(own) - 1
        step = F.lit(1.0) / many
        area = lambda k: (F.get(own, k) + F.get(own, k + 1)) / 2
        pieces = F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.struct(
            k.alias("k"),
            F.aggregate(F.slice(own, 1, k + 1), F.lit(0.0), lambda a, x: a + x).alias("upto"),
            F.get(own, k).alias("a"), F.get(own, k + 1).alias("b"),
        ))
        # Trapezoids before stretch k: all levels up to k, the outer two by half.
        before = lambda s: s["upto"] - F.get(own, 0) / 2 - s["a"] / 2
        whole = F.aggregate(F.sequence(F.lit(0), many - 1), F.lit(0.0), lambda a, k: a + area(k))

        def inside(s: Column, asked: Column) -> Column:
            rest = F.greatest(asked - before(s), F.lit(0.0))
            root = s["a"] + F.sqrt(F.greatest(s["a"] * s["a"] + 2 * (s["b"] - s["a"]) * rest, F.lit(0.0)))
            part = F.when(root > 0, F.least(2 * rest / root, F.lit(1.0))).otherwise(F.lit(0.0))
            return (s["k"] + part) * step

        found = let(share * whole, lambda asked: let(
            F.element_at(F.filter(pieces, lambda s: before(s) <= asked), -1), lambda s: inside(s, asked)
        ))
        return F.when(whole > 0, found).otherwise(share)

    return let(levels, along)


def mix(
    docs: DataFrame,
    weights: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: int = MAX_REPEATS,
    seed: int = 42,
) -> DataFrame:
    """One row per row of `docs`: id, size, source, source_size, target, taken, takes, positions.

    `size` counts words. A source's documents stand in the order of a seeded hash and are read round and
    round, at most `max_repeats` times, until the target is reached; the last one may be
    cut. `takes` lists the words of each pass in which the document is met, `taken` is their sum, and `positions` are the
    times at which the passes reach it. `weights` has rows (source, weight, levels), see cycled_weights;
    sources that it lacks are not taken.

    Null and empty texts have size 0 and are not taken. Ids may be null or repeat; equal rows (id, source,
    size) are counted before they are ordered, and follow each other. Null is a source like others. Other
    columns are not used; an empty table gives no rows. Reruns agree, whatever the partitions.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"),
        F.size(words_of(F.col(text_col).cast("string"))).cast("long").alias("size"),
    )
    keys = rows.groupBy("_id", "source", "size").agg(F.count(F.lit(1)).alias("_copies"))
    label = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size"))
    keys = keys.withColumn("_hash", F.md5(label))
    many = F.col("size") * F.col("_copies")
    by_source = F.asc_nulls_last("source")
    ordered = running_totals(keys, [by_source, F.col("_hash"), F.col("_id"), F.col("size")], {"_start": many})

    named = weights.select(F.col("source").alias("_named"), "weight", "levels")
    sizes = ordered.groupBy("source").agg(F.sum(many).alias("source_size"), F.min("_start").alias("_first"))
    aimed = targets(settle(
        sizes.join(named, F.col("source").eqNullSafe(F.col("_named")), "left").drop("_named")
    ), max_repeats).withColumnRenamed("source", "_of")
    met = ordered.join(aimed, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")

    # Copies of a row are expanded in stretches, dealt over the tasks.
    stretches = met.withColumn("_from", F.explode(F.expr(f"sequence(0L, _copies - 1, {COPIES}L)")))
    single = stretches.repartition("_hash", "_from").withColumn(
        "_nth", F.explode(F.expr(f"sequence(_from, least(_from + {COPIES}L, _copies) - 1)"))
    )
    start = F.col("_start") - F.col("_first") + F.col("_nth") * F.col("size")
    goal = F.round("target").cast("long")
    passes = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(max_repeats - 1).cast("long")),
        lambda p: let(p * F.col("source_size") + F.col("_at"), lambda at: F.struct(
            at.alias("at"), F.greatest(F.least(F.col("size"), F.col("_goal") - at), F.lit(0).cast("long")).alias("n")
        )),
    )
    taken = single.withColumns({"_at": start, "_goal": goal}).withColumn(
        "_passes", F.filter(passes, lambda x: x["n"] > 0)
    )
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return taken.select(
        F.col("_id").alias(id_col), "size", "source", "source_size", "target",
        total(F.transform("_passes", lambda x: x["n"])).alias("taken"),
        F.transform("_passes", lambda x: x["n"]).alias("takes"),
        F.transform("_passes", lambda x: time_of(x["at"].cast("double") / F.col("target"), F.col("levels"))).alias("positions"),
    )


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, source, pass, position, taken) of what mix() takes, range-sorted by position."""
    met = F.arrays_zip(F.col("positions").alias("position"), F.col("takes").alias("taken"))
    rows = mixed.select(id_col, "source", F.posexplode(met).alias("pass", "_met"))
    return rows.select(id_col, "source", "pass", "_met.position", "_met.taken").orderBy(
        "position", F.asc_nulls_last("source"), F.asc_nulls_last(id_col), "pass"
    )
