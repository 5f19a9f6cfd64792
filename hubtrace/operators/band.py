"""Joining on a key plus a range of days, and counting over such joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubtrace.functions import day_number, known
from hubtrace.operators.sites import Events, id_masks, sites_by_day

#: Left rows of one (key, block) that meet their matches in one task, about; places that are split at most.
CROWD, _BUSY = 500_000, 10_000
_HOW = ("inner", "left", "left_semi", "left_anti")


def band_join(
    left: DataFrame,
    right: DataFrame,
    key: str | Sequence[str],
    left_day: str,
    right_day: str,
    lo: int,
    hi: int,
    how: str = "inner",
    crowd: int | None = CROWD,
) -> DataFrame:
    """Match rows with equal keys and ``left_day + lo <= right_day <= left_day + hi``.

    Time is cut into blocks as wide as the band. A left row lies in one block; the
    left days that a right row can meet span at most two. Repeating the right
    row for those turns the band into an equality on (key, block) plus a range
    check, so a key with a long history is spread over its blocks rather
    than landing in one task, and each matching pair still meets exactly once.

    Left rows of a (key, block) are counted first. Where there are more than ``crowd``, they are dealt
    by a hash of the whole row to as many parts as it takes, and the right rows of that (key, block) are repeated for
    each part. The list of such places is cut at a fixed length, greatest first, so that it can be broadcast;
    whatever is not on it holds a ten-thousandth of all left rows at most. ``crowd=None`` leaves this out, for left
    rows that were condensed before.
    """
    if how not in _HOW:
        raise ValueError(f"how must be one of {_HOW}, not {how!r}")
    if hi < lo:
        raise ValueError("hi must not be below lo")
    keys = [key] if isinstance(key, str) else list(key)
    width = hi - lo + 1

    def block(day: Column) -> Column:
        return F.floor(day / F.lit(width))

    lhs = left.withColumn("_ln", day_number(F.col(left_day)))
    lhs = lhs.withColumn("_lb", block(F.col("_ln")))
    rhs = right.withColumn("_rn", day_number(F.col(right_day))).where("_rn IS NOT NULL")
    rhs = rhs.withColumn(
        "_rb", F.explode(F.sequence(block(F.col("_rn") - hi), block(F.col("_rn") - lo)))
    )
    for k in keys:
        rhs = rhs.withColumnRenamed(k, f"_r_{k}")
    on = (F.col("_lb") == F.col("_rb")) & F.col("_ln").between(
        F.col("_rn") - hi, F.col("_rn") - lo
    )
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    if crowd is not None:
        counted = lhs.where(known(*keys, "_lb")).groupBy(*keys, "_lb").agg(F.count("*").alias("_many"))
        busy = counted.where(F.col("_many") > crowd).orderBy(F.desc("_many"), *keys, "_lb").limit(_BUSY)
        busy = F.broadcast(busy.select(
            *[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_lb").alias("_bb"),
            F.ceil(F.col("_many") / crowd).cast("int").alias("_parts"),
        ))

        def placed(df: DataFrame, prefix: str, block_col: str) -> DataFrame:
            same = F.col(block_col) == F.col("_bb")
            for k in keys:
                same = same & (F.col(f"{prefix}{k}") == F.col(f"_b_{k}"))
            met = df.join(busy, same, "left").drop("_bb", *[f"_b_{k}" for k in keys])
            return met.withColumn("_parts", F.coalesce("_parts", F.lit(1)))

        # Lambda-free and of the row alone: a task that runs again deals its rows as before.
        own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col("_parts")).cast("int")
        lhs = placed(lhs, "", "_lb").withColumn("_lp", own).drop("_parts")
        every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
        rhs = placed(rhs, "_r_", "_rb").withColumn("_rp", every).drop("_parts")
        on = on & (F.col("_lp") == F.col("_rp"))
    helpers = ["_ln", "_lb", "_lp", "_rn", "_rb", "_rp", *[f"_r_{k}" for k in keys]]
    return lhs.join(rhs, on, how).drop(*helpers)


def band_rates(
    facts: DataFrame,
    events: Events,
    *,
    key: str,
    fact_day: str,
    event_day: str,
    event_id: str,
    dims: Sequence[str],
    lo: int,
    hi: int,
    entity: str,
    n_entities: str,
    n_events: str,
    weight: str | None = None,
    weight_sum: str | None = None,
    dedupe: bool = False,
) -> DataFrame:
    """Per group of facts: distinct entities, and distinct events near those facts.

    Gives what a left band join of facts to events followed by a grouped count
    would give, without materialising that join:

    * facts are first combined to cells of (dims, key, day), events to sites
      of (key, day), so the join pairs days with days and never rows with rows;
    * a site counts for the first day of a group that reaches it: later days look only at what lies beyond the
      last one's reach. So each site meets a group once and ids add up in the map tasks, without a
      shuffle of (group, site);
    * ids that several sites hold come as bits, 64 to a number; their union over a group's sites
      is formed in the same pass (see ``event_sites`` and ``id_masks``). Pairs of a group and an id are
      never listed.

    ``weight_sum`` repeats a fact once per matching event row, as a sum taken
    after the join does; ``dedupe=True`` counts every fact once instead.
    Groups with a NULL dimension are kept. ``events`` may be ``KeptSites``.
    """
    dims = list(dims)
    facts = facts.withColumn(fact_day, F.col(fact_day).cast("date"))
    wanted = [*dims, key, fact_day]
    fans_out = weight is not None and not dedupe
    per_cell = [] if weight is None else [F.sum(weight).alias("_w")]
    cells = facts.groupBy(*wanted).agg(*per_cell) if per_cell else facts.select(*wanted).distinct()
    sites, roaming = sites_by_day(events, key, event_day, event_id)
    masks = id_masks(roaming, [key, event_day], event_id)
    right = sites.where("_ids > 0 AND _rows > 0").select(
        key, F.col(event_day).alias("_event_day"), "_ids",
        F.lit(None).cast("bigint").alias("_chunk"), F.lit(None).cast("bigint").alias("_mask"),
    ).unionByName(masks.select(
        key, F.col(event_day).alias("_event_day"), F.lit(0).cast("bigint").alias("_ids"), "_chunk", "_mask",
    ))
    earlier = F.lag(fact_day).over(Window.partitionBy(*dims, key).orderBy(fact_day))
    left = cells.withColumn("_reached", F.date_add(earlier, hi)).withColumnRenamed(fact_day, "_day")
    joined = band_join(left, right, key, "_day", "_event_day", lo, hi, crowd=None)
    joined = joined.where(F.col("_reached").isNull() | (F.col("_event_day") > F.col("_reached")))
    per_chunk = joined.groupBy(*dims, "_chunk").agg(F.sum("_ids").alias("_ids"), F.bit_or("_mask").alias("_mask"))
    ids = F.sum("_ids") + F.coalesce(F.sum(F.bit_count("_mask")), F.lit(0))
    parts = [per_chunk.groupBy(*dims).agg(ids.alias(n_events))]
    of_cells = [F.countDistinct(key).alias(n_entities)] if entity == key else []
    if fans_out:
        # Event rows near each (key, day) are added up before a fact meets them: one row per cell.
        near = sites.select(
            F.col(key).alias("_near"), "_rows",
            F.explode(F.sequence(F.date_sub(event_day, hi), F.date_sub(event_day, lo))).alias("_near_day"),
        ).groupBy("_near", "_near_day").agg(F.sum("_rows").alias("_rows"))
        met = cells.join(near, (F.col(key) == F.col("_near")) & (F.col(fact_day) == F.col("_near_day")), "left")
        repeated = F.col("_w") * F.coalesce(F.col("_rows"), F.lit(1))
        parts.append(met.groupBy(*dims).agg(F.sum(repeated).alias(weight_sum), *of_cells))
    elif weight is not None:
        parts.append(cells.groupBy(*dims).agg(F.sum("_w").alias(weight_sum), *of_cells))
    elif of_cells:
        parts.append(cells.groupBy(*dims).agg(*of_cells))
    if entity != key:
        parts.append(facts.groupBy(*dims).agg(F.countDistinct(entity).alias(n_entities)))

    # Parts meet by union, which treats NULL groups alike; a join would lose them.
    names = [c for c in (n_entities, weight_sum, n_events) if c]
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    out = out.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in names])
    counted = F.coalesce(F.col(n_events), F.lit(0)).cast("bigint").alias(n_events)
    return out.select(*dims, *names[:-1], counted)
