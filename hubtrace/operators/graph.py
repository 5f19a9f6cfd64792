"""Foreign-key edges and time-anchored training labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubtrace.functions import day_number, known


def fk_edges(
    hub: DataFrame,
    facts: Mapping[str, DataFrame],
    key: str,
    time_cols: Mapping[str, str],
    hub_name: str = "hub",
    end_cols: Mapping[str, str] | None = None,
) -> DataFrame:
    """Edges from fact rows to their hub entity, counted per key and event day.

    ``event_day`` counts days since 1970-01-01 and dates the edge in both directions. With ``end_cols``, edges are
    counted per ``end_time`` too: the day from which a fact no longer holds, NULL while it stays open or where
    its table has no such column. Edges to a key the hub lacks are dropped. Rows are combined before the
    check, so it sees one row per (table, key, day).
    """

    def edges(name: str, df: DataFrame) -> DataFrame:
        day = lambda c: F.col(c).cast("date") if c else F.lit(None).cast("date")
        ends = [] if end_cols is None else [day(end_cols.get(name)).alias("end_time")]
        return df.select(F.lit(name).alias("src_table"), key, day(time_cols.get(name)).alias("event_time"), *ends)

    ends = [] if end_cols is None else ["end_time"]
    rows = reduce(DataFrame.unionByName, [edges(n, d) for n, d in facts.items()])
    counted = (
        rows.where(known(key))
        .groupBy("src_table", key, "event_time", *ends)
        .agg(F.count("*").alias("n_rows"))
    )
    return counted.join(hub.select(key).distinct(), key, "left_semi").select(
        "src_table",
        F.lit(hub_name).alias("dst_table"),
        key,
        "event_time",
        *ends,
        day_number(F.col("event_time")).alias("event_day"),
        "n_rows",
    )


class _Anchors:
    """Distinct anchor days in order, numbered from 0, and for any day how many lie before it.

    The calendar has a line per day between the first anchor and the day after the last; days outside
    are as good as its ends. So it can be broadcast, and no day is looked for among the anchors.
    """

    def __init__(self, anchors: DataFrame, anchor: str):
        self.name = anchor
        self.dates = anchors.select(F.col(anchor).cast("date").alias(anchor)).where(known(anchor)).distinct()
        ends = self.dates.agg(F.min(anchor).alias("_first"), F.max(anchor).alias("_last")).where(known("_first"))
        days = ends.select("_first", "_last", F.explode(F.sequence("_first", F.date_add("_last", 1))).alias("_day"))
        marked = days.join(self.dates, F.col("_day") == F.col(anchor), "left")
        before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
        self.calendar = marked.select("_day", anchor, F.count(anchor).over(before).alias("_place"))

    def first_from(self, rows: DataFrame, **days: Column) -> DataFrame:
        """For each named day, the number of the first anchor not before it; how many anchors there are if none is."""
        first, last = (f(self.name) for f in (F.min, F.max))
        low, high = self.dates.agg(first).scalar(), self.dates.agg(F.date_add(last, 1)).scalar()
        names = rows.columns
        for name, day in days.items():
            placed = rows.select(*names, F.greatest(F.least(day, high), low).alias("_at"))
            line = F.broadcast(self.calendar.select(F.col("_day").alias("_at"), F.col("_place").alias(name)))
            rows = placed.join(line, "_at")
            names = [*names, name]
        return rows.select(*names)

    def running(self, changes: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
        """Running sums of changes at (group, _place), for each anchor where the first one is above 0."""
        at = changes.groupBy(*group, "_place").agg(*[F.sum(n).alias(n) for n in names])
        order = Window.partitionBy(*group).orderBy("_place")
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        held = at.select(
            *group, "_place", F.lead("_place").over(order).alias("_next"), *[F.sum(n).over(upto).alias(n) for n in names]
        ).where((F.col(names[0]) > 0) & (F.col("_next") > F.col("_place")))
        each = held.select(*group, *names, F.explode(F.sequence("_place", F.col("_next") - 1)).alias("_place"))
        dated = F.broadcast(self.calendar.where(known(self.name)).select("_place", self.name))
        return each.join(dated, "_place").select(*group, self.name, *names)


def edges_at(edges: DataFrame, anchors: DataFrame, key: str, anchor: str = "anchor") -> DataFrame:
    """``(src_table, dst_table, key, anchor, n_rows)``: facts that hold on each anchor day.

    A fact holds from its ``event_time`` until the day before its ``end_time``, or for good without one; one
    without a beginning never does, nor does one that ends before it begins. A beginning adds to the first anchor
    it reaches and an end takes away at the first it no longer reaches; the running sum over a key's anchors is
    the number of open facts. An edge is two rows, however many anchors it spans.
    """
    days = _Anchors(anchors, anchor)
    group = ["src_table", "dst_table", key]
    known_edges = edges.where(known("event_time")).where("end_time IS NULL OR end_time > event_time")
    placed = days.first_from(
        known_edges.select(*group, "event_time", "end_time", "n_rows"),
        _from=F.col("event_time"), _until=F.coalesce(F.col("end_time"), F.lit("9999-12-31").cast("date")),
    )
    change = F.explode(F.array(
        F.struct(F.col("_from").alias("_place"), F.col("n_rows").alias("n_rows")),
        F.struct(F.col("_until").alias("_place"), (-F.col("n_rows")).alias("n_rows")),
    ))
    changes = placed.where("_from < _until").select(*group, change.alias("_c")).select(*group, "_c.*")
    return days.running(changes, group, ["n_rows"])


def label_windows(
    hub: DataFrame,
    target: DataFrame,
    active: DataFrame,
    anchors: DataFrame,
    key: str,
    target_day: str,
    active_day: str,
    windows: Sequence[tuple[int, int]],
    anchor: str = "anchor",
) -> DataFrame:
    """Will a key see a target event within ``horizon`` days after each anchor, for several windows at once?

    ``windows`` lists (horizon, lookback). Only keys active in ``(anchor - lookback, anchor]`` are labelled; the label
    is true if a target day lies in ``(anchor, anchor + horizon]``, so nothing at or
    before the anchor can leak into it. Returns ``(horizon, lookback, key, anchor, label)``.

    Hub and anchors are never multiplied, and no day is laid out over a window. Rows are reduced to (key, day) in the
    map tasks. A day is seen by the anchors of one range, so it is one addition where that begins and one
    subtraction where it ends; running sums over a key's anchors tell which of them see activity, and which a target. The
    cost does not depend on the widths. A busy key holds a row per anchor and window at most.
    """
    if not windows or any(h < 1 or b < 1 for h, b in windows):
        raise ValueError("windows must hold pairs of days, 1 at least")
    days = _Anchors(anchors, anchor)
    group = ["horizon", "lookback", key]
    wanted = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(b).alias("lookback")) for h, b in dict.fromkeys(windows)
    ]))

    def changes(df: DataFrame, day: str, first: Column, past: Column, counter: str) -> DataFrame:
        """Anchors in [day + first, day + past) see the day."""
        found = df.where(known(key, day)).select(key, F.col(day).cast("date").alias("_day")).distinct()
        each = found.select(key, "_day", wanted.alias("_w")).select(key, "_day", "_w.*")
        placed = days.first_from(each, _from=F.date_add("_day", first), _until=F.date_add("_day", past))
        point = lambda at, n: F.struct(
            F.col(at).alias("_place"),
            *[F.lit(n if c == counter else 0).cast("bigint").alias(c) for c in ("_active", "_hits")],
        )
        both = F.explode(F.array(point("_from", 1), point("_until", -1)))
        return placed.where("_from < _until").select(*group, both.alias("_c")).select(*group, "_c.*")

    zero = F.lit(0)
    seen = changes(active, active_day, zero, F.col("lookback"), "_active")
    hit = changes(target, target_day, -F.col("horizon"), zero, "_hits")
    labelled = days.running(seen.unionByName(hit), group, ["_active", "_hits"])
    return labelled.join(hub.select(key).distinct(), key, "left_semi").select(
        *group, anchor, (F.col("_hits") > 0).alias("label")
    )


def label_table(
    hub: DataFrame,
    target: DataFrame,
    active: DataFrame,
    anchors: DataFrame,
    key: str,
    target_day: str,
    active_day: str,
    anchor: str = "anchor",
    horizon: int = 7,
    lookback: int = 7,
) -> DataFrame:
    """``label_windows`` for a single window, as ``(key, anchor, label)``."""
    found = label_windows(
        hub, target, active, anchors, key, target_day, active_day, [(horizon, lookback)], anchor
    )
    return found.select(key, anchor, "label")
