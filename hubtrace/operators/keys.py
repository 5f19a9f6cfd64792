"""Key statistics across a hub and its fact tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubtrace.functions import safe_ratio
from hubtrace.operators.rates import top_k
from hubtrace.sources.schema import TableSpec


def key_match(hub: DataFrame, facts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Per fact table: hub keys it covers, rows without a key, keys unknown to the hub.

    All tables are counted in one grouped pass over (key, table) tags, so no
    key is joined and a key with most of the rows is combined in the map tasks.
    """
    names = list(facts)

    def tagged(df: DataFrame, tag: int) -> DataFrame:
        return df.select(F.col(key).alias("_key"), F.lit(tag).alias("_tag"))

    parts = [tagged(hub, -1)] + [tagged(facts[n], i) for i, n in enumerate(names)]
    rows = reduce(DataFrame.unionByName, parts)
    is_hub = F.max(F.col("_tag") == -1).alias("_hub")
    per_key = rows.groupBy("_key").agg(
        is_hub, *[F.count_if(F.col("_tag") == i).alias(f"_n{i}") for i in range(len(names))]
    )
    known = F.col("_key").isNotNull()
    in_hub = known & F.col("_hub")
    measures = [F.count_if(in_hub).alias("_hub_keys")]
    for i in range(len(names)):
        here = F.col(f"_n{i}") > 0
        measures += [
            F.count_if(in_hub & here).alias(f"_matched{i}"),
            F.count_if(known & ~F.col("_hub") & here).alias(f"_orphans{i}"),
            F.coalesce(F.sum(F.when(~known, F.col(f"_n{i}"))), F.lit(0)).alias(f"_nulls{i}"),
        ]
    lines = [
        F.struct(
            F.lit(n).alias("table"),
            F.col("_hub_keys").alias("hub_keys"),
            F.col(f"_matched{i}").alias("matched"),
            safe_ratio(F.col(f"_matched{i}"), F.col("_hub_keys"), 4).alias("match_rate"),
            F.col(f"_nulls{i}").alias("null_keys"),
            F.col(f"_orphans{i}").alias("orphans"),
        )
        for i, n in enumerate(names)
    ]
    return per_key.agg(*measures).select(F.inline(F.array(*lines)))


def check_registry(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]) -> DataFrame:
    """What the data say about each declared column: ``(table, column, role, n_rows, n_known, n_ok)``.

    ``n_ok`` counts distinct values of a primary key, rows whose foreign key occurs in the table it names, known
    times, and rows whose end is open or not before their beginning. A declared column that a table lacks has no
    known row; tables without a declaration or that are not at hand are left out. Keys are counted per value
    before they meet the other table.
    """
    parts = []
    for name, df in tables.items():
        spec = specs.get(name)
        if spec is None:
            continue
        declared = [(spec.primary_key, "primary_key"), (spec.time_col, "time"), (spec.end_time_col, "end_time")]
        lines, measures = [], [F.count(F.lit(1)).alias("_rows")]
        for i, (column, role) in enumerate(declared):
            if column is None:
                continue
            value = F.col(column) if column in df.columns else F.lit(None)
            if role == "primary_key":
                ok = F.countDistinct(value)
            elif role == "time":
                ok = F.count(value)
            else:
                begins = F.col(spec.time_col) if spec.time_col in df.columns else F.lit(None)
                ok = F.count_if(value.isNull() | begins.isNull() | (value >= begins))
            measures += [F.count(value).alias(f"_known{i}"), ok.alias(f"_ok{i}")]
            lines.append(F.struct(
                F.lit(name).alias("table"), F.lit(column).alias("column"), F.lit(role).alias("role"),
                F.col("_rows").alias("n_rows"), F.col(f"_known{i}").alias("n_known"), F.col(f"_ok{i}").alias("n_ok"),
            ))
        if lines:
            parts.append(df.agg(*measures).select(F.inline(F.array(*lines))))
        for column, target in spec.foreign_keys.items():
            referred = specs[target].primary_key if target in specs else None
            if target not in tables or referred is None:
                continue
            value = F.col(column) if column in df.columns else F.lit(None).cast(tables[target].schema[referred].dataType)
            counted = df.groupBy(value.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
            there = tables[target].select(F.col(referred).alias("_key")).distinct().withColumn("_there", F.lit(True))
            met = counted.join(there, "_key", "left")
            n = lambda c: F.coalesce(F.sum(c), F.lit(0))
            parts.append(met.agg(
                n(F.col("_n")).alias("n_rows"), n(F.when(F.col("_key").isNotNull(), F.col("_n"))).alias("n_known"),
                n(F.when(F.col("_there"), F.col("_n"))).alias("n_ok"),
            ).select(F.lit(name).alias("table"), F.lit(column).alias("column"), F.lit("foreign_key").alias("role"), "*"))
    return reduce(DataFrame.unionByName, parts)


def top_keys(df: DataFrame, key: str, k: int, name: str = "n_rows") -> DataFrame:
    """The ``k`` keys with most rows, the smaller key first among equals."""
    return top_k(df.groupBy(key).agg(F.count("*").alias(name)), [name], k, [key])
