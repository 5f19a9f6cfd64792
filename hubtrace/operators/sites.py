"""Events condensed to the places where they happen, so that distinct ids can be added up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubtrace.functions import known

#: Parts in which ids of several sites are numbered.
_PARTS = 16


def event_sites(
    events: DataFrame,
    site: Sequence[str],
    event_id: str,
    with_unnamed: bool = False,
    required: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Condense events so that distinct ids can be *added up* per site.

    A site is a combination of the ``site`` columns, e.g. (key, day). Almost every
    id occurs at one site only. The first result has one row per site with the
    number of such ids in ``_ids`` and of event rows in ``_rows``. An id seen at several
    sites cannot be added up; the second result lists the sites of those ids, and has no row
    if there are none. Distinct ids over any set of sites are then ``sum(_ids)`` plus the
    distinct listed ids, exactly. Rows without an id count in ``_rows`` when
    ``with_unnamed`` is set. Rows with NULL in one of ``required`` (default: all of
    ``site``) are left out.

    Rows combine to (id, site) in the map tasks and are shuffled on both, so an id that holds a
    third of all rows is one row per task and site. Only such pairs are counted and looked up by their id.
    """
    site = list(site)
    placed = events.where(known(*(required or site)))
    pairs = placed.where(known(event_id)).groupBy(event_id, *site).agg(F.count("*").alias("_rows"))
    # The sum says nothing new; it keeps the columns of all branches alike, so that they share one shuffle.
    sizes = pairs.groupBy(event_id).agg(F.count("*").alias("_sites"), F.sum("_rows").alias("_all"))
    roamers = sizes.where("_sites > 1 AND _all > 1").select(F.col(event_id).alias("_roamer"))
    marked = pairs.join(roamers, F.col(event_id) == F.col("_roamer"), "left")
    settled = F.col("_roamer").isNull()
    sites = marked.groupBy(*site).agg(F.count_if(settled).alias("_ids"), F.sum("_rows").alias("_rows"))
    if with_unnamed:
        unnamed = placed.where(F.col(event_id).isNull()).groupBy(*site)
        unnamed = unnamed.agg(F.lit(0).cast("bigint").alias("_ids"), F.count("*").alias("_rows"))
        sites = sites.unionByName(unnamed).groupBy(*site)
        sites = sites.agg(F.sum("_ids").alias("_ids"), F.sum("_rows").alias("_rows"))
    roaming = marked.where(known("_roamer")).select(event_id, *site, "_rows")
    return sites, roaming


def id_masks(roaming: DataFrame, site: Sequence[str], event_id: str) -> DataFrame:
    """``(site, _chunk, _mask)``: the listed ids of each site as bits, 64 ids to a chunk.

    Ids are dealt by hash to a fixed number of parts and numbered in each, which is the same in every run.
    Distinct ids over any set of sites are the bits of the masks' union, so a group reduces its
    (group, id) pairs by ranges of 64 ids while it is still in the map tasks.
    """
    listed = roaming.where("_rows > 0")
    part = F.pmod(F.xxhash64(event_id), F.lit(_PARTS))
    ids = listed.groupBy(event_id).agg(F.sum("_rows").alias("_rows")).where("_rows > 0").withColumn("_part", part)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(event_id)).cast("bigint") - 1
    numbers = ids.select(
        F.col(event_id).alias("_id"), (F.shiftright(place, 6) * _PARTS + F.col("_part")).alias("_chunk"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int")).alias("_bit"),
    )
    met = listed.join(numbers, F.col(event_id) == F.col("_id"))
    return met.groupBy(*site, "_chunk").agg(F.bit_or("_bit").alias("_mask"))


class KeptSites:
    """Event sites by (key, day), written once and read by many queries.

    Stands for the events where an operator only counts distinct ids: rates, activity, band rates
    and period overlap take it instead of the event table.
    """

    def __init__(self, table: DataFrame, key: str, day: str, event_id: str):
        self.key, self.day, self.event_id = key, day, event_id
        self._table = table

    @classmethod
    def write(cls, events: DataFrame, key: str, day: str, event_id: str, path: str) -> KeptSites:
        """One job and one shuffle on the event id. Days that are NULL are a site of their key."""
        dated = events.select(key, F.col(day).cast("date").alias(day), event_id)
        sites, roaming = event_sites(dated, [key, day], event_id, with_unnamed=True, required=[key])
        lines = sites.select(F.lit(None).cast(events.schema[event_id].dataType).alias(event_id), key, day, "_ids", "_rows")
        listed = roaming.select(event_id, key, day, F.lit(0).cast("bigint").alias("_ids"), "_rows")
        lines.unionByName(listed).write.parquet(path)
        return cls(events.sparkSession.read.parquet(path), key, day, event_id)

    @property
    def sites(self) -> DataFrame:
        return self._table.where(F.col(self.event_id).isNull()).drop(self.event_id)

    @property
    def roaming(self) -> DataFrame:
        return self._table.where(known(self.event_id)).drop("_ids")

    def by_day(self) -> tuple[DataFrame, DataFrame]:
        """As ``event_sites`` by (key, day), with rows that have no id."""
        return self.sites.where(known(self.day)), self.roaming.where(known(self.day))

    def by_key(self) -> tuple[DataFrame, DataFrame]:
        """As ``event_sites`` by key: only ids listed by (key, day) can occur under several keys."""
        more, roaming = event_sites(self.roaming, [self.key], self.event_id)
        both = self.sites.select(self.key, "_ids", "_rows").unionByName(more.withColumn("_rows", F.lit(0)))
        return both.groupBy(self.key).agg(F.sum("_ids").alias("_ids"), F.sum("_rows").alias("_rows")), roaming

    def per_key(self, n_events: str, first: str | None = None, last: str | None = None) -> DataFrame:
        """Distinct ids per key, and the first and last day where names for them are given."""
        days = [f(self.day).alias(n) for f, n in ((F.min, first), (F.max, last)) if n]
        counted = self.sites.groupBy(self.key).agg(F.sum("_ids").alias(n_events), *days)
        listed = self.roaming.groupBy(self.key).agg(F.countDistinct(self.event_id).alias(n_events))
        both = counted.unionByName(listed, allowMissingColumns=True).groupBy(self.key)
        days = [f(n).alias(n) for f, n in ((F.min, first), (F.max, last)) if n]
        return both.agg(F.sum(n_events).alias(n_events), *days)


Events = DataFrame | KeptSites


def sites_by_key(events: Events, key: str, event_id: str) -> tuple[DataFrame, DataFrame]:
    return events.by_key() if isinstance(events, KeptSites) else event_sites(events, [key], event_id)


def sites_by_day(events: Events, key: str, day: str, event_id: str) -> tuple[DataFrame, DataFrame]:
    if isinstance(events, KeptSites):
        return events.by_day()
    dated = events.withColumn(day, F.col(day).cast("date"))
    sites, roaming = event_sites(dated, [key, day], event_id, with_unnamed=True)
    # A day that hangs on the count: conditions on it stay above the shuffle, which all branches then share.
    counted = F.when(F.col("_rows") > 0, F.col(day)).alias(day)
    return sites.select(key, counted, "_ids", "_rows"), roaming.select(event_id, key, counted, "_rows")
