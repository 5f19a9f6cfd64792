"""Which items occur together under one key on one day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubtrace.functions import day_number, known


def cooccurrence(
    df: DataFrame,
    key: str,
    day: str,
    item: str,
    min_support: int = 10,
    pair: tuple[str, str] = ("item_a", "item_b"),
    n_days: str = "cooccurrence_days",
    n_keys: str = "n_keys",
    crowd: int = 1000,
) -> DataFrame:
    """Item pairs ``a < b`` with the (key, day) and key counts they share.

    Repeated rows of a (key, day, item) vanish in the map tasks. An item seen on fewer than
    ``min_support`` key-days cannot be in a reported pair, so it is dropped
    before pairing; that is exact. Days on which a key has the same items are
    counted as one set (see ``item_sets``), so a pair costs a row per key and set, not per day.
    """
    marks = (
        df.where(known(key, day, item))
        .select(key, F.col(item).alias("_item"), day_number(F.col(day)).alias("_day"))
        .distinct()
    )
    frequent = (
        marks.groupBy("_item")
        .agg(F.count("*").alias("_support"))
        .where(F.col("_support") >= min_support)
        .select("_item")
    )
    sets = item_sets(marks.join(frequent, "_item", "left_semi"), key, crowd)
    a, b = pair
    one, other = F.col("_one"), F.col("_other")
    pairs = (
        sets.select(key, "_days", "_same", "_right", F.explode("_left").alias("_one"))
        .select(key, "_days", "_same", "_one", F.explode("_right").alias("_other"))
        # Inside a group every pair is met from both ends, across two groups from one.
        .where(~F.col("_same") | (one < other))
        .select(F.least(one, other).alias(a), F.greatest(one, other).alias(b), key, "_days")
    )
    return (
        pairs.groupBy(a, b, key)
        .agg(F.sum("_days").alias("_days"))
        .groupBy(a, b)
        .agg(F.sum("_days").alias(n_days), F.count("*").alias(n_keys))
        .where(F.col(n_days) >= min_support)
    )


def item_sets(marks: DataFrame, key: str, crowd: int = 1000) -> DataFrame:
    """Rows (key, _left, _right, _same, _days): the distinct item sets of a key and their days.

    ``marks`` has distinct rows (key, _day, _item). The items of a key and day are hashed to
    ``ceil(items / crowd)`` groups. Two groups of a day make one row, and so does each group
    with itself (``_same``); equal rows of a key add up their days. So any two items of a key and day
    stand opposite each other in exactly one row, a row holds about ``2 * crowd`` items, and a busy
    day is divided over tasks. The plan is the same whatever the sizes.
    """
    counted = marks.groupBy(key, "_day").agg(F.count("*").alias("_n"))
    # A lone item has no partner; its day ends here.
    sizes = counted.where("_n > 1").select(key, "_day", F.ceil(F.col("_n") / crowd).cast("int").alias("_groups"))
    own, at = F.col("_own"), F.col("_at")
    grouped = (
        marks.join(sizes, [key, "_day"])
        .withColumn("_own", F.pmod(F.hash("_item"), F.col("_groups")))
        # Without this a busy day would be gathered where its size was looked up, in one task.
        .repartition(key, "_day", "_own")
        .groupBy(key, "_day", "_own", "_groups")
        .agg(F.sort_array(F.collect_set("_item")).alias("_items"))
    )
    def side(low: str) -> Column:
        return F.max(F.when(own == F.col(low), F.col("_items")))

    cells = (
        grouped.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
        .withColumns({"_low": F.least(own, at), "_high": F.greatest(own, at)})
        .groupBy(key, "_day", "_low", "_high")
        .agg(side("_low").alias("_left"), side("_high").alias("_right"))
    )
    same = (F.col("_low") == F.col("_high")).alias("_same")
    pairable = F.when(F.col("_low") == F.col("_high"), F.size("_left") > 1).otherwise(
        F.col("_left").isNotNull() & F.col("_right").isNotNull()
    )
    return (
        cells.where(pairable)
        .select(key, "_left", "_right", same)
        .groupBy(key, "_left", "_right", "_same")
        .agg(F.count("*").alias("_days"))
    )
