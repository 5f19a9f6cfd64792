"""Run a set of named queries, each written by its own job."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hubtrace.plans.incidents import SITES, keep_incidents
from hubtrace.sources import Tables, scratch_dir
from hubtrace.sources.export import message_of
from hubtrace.sources.report import write_report


class Once:
    """A value that several queries use, made by the first that asks; a failure is not kept."""

    def __init__(self, make: Callable):
        self._make, self._lock, self._made = make, Lock(), []

    def __call__(self):
        with self._lock:
            if not self._made:
                self._made.append(self._make())
            return self._made[0]


def with_kept_incidents(spark: SparkSession, tables: Mapping[str, DataFrame]) -> Tables:
    """The tables, and the incidents condensed to their sites for all queries of a suite.

    The first query that needs the sites writes them to a scratch folder; the others wait and read them.
    So the suite shuffles incidents on their id once, however many queries count them.
    """
    kept = Once(lambda: keep_incidents(tables["incident"], scratch_dir(spark)))
    return Tables({**{n: partial(tables.__getitem__, n) for n in tables}, SITES: kept})


def run_suite(
    spark: SparkSession,
    named: Mapping[str, Callable[[], DataFrame]],
    path: str | None = None,
    at_once: int = 4,
) -> DataFrame:
    """Run every query; one that fails is reported and the others still run.

    Results go to ``path/name`` as JSON, or nowhere when no path is given; rows
    are counted by the write itself. ``at_once`` jobs share the cluster, so the
    last tasks of one query do not leave it idle. Returns ``(name, status, row_count, error)``.
    """

    def run(name: str) -> tuple[str, str, int | None, str | None]:
        seen = Observation()
        try:
            out = named[name]().observe(seen, F.count(F.lit(1)).alias("rows"))
            if path is None:
                out.write.format("noop").mode("overwrite").save()
            else:
                write_report(out, f"{path.rstrip('/')}/{name}")
            return name, "ok", seen.get["rows"], None
        except Exception as e:  # noqa: BLE001 - the status line reports it
            return name, "error", None, message_of(e)

    with ThreadPoolExecutor(at_once) as pool:
        lines = list(pool.map(inheritable_thread_target(spark)(run), named))
    return spark.createDataFrame(
        lines, "name string, status string, row_count bigint, error string"
    )
