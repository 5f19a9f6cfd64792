"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the characters that separate words, x20 and x09 to x0D.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A session in one process without the setting gets a temporary folder that is deleted on
    exit; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir() or _temporary()
    return base


def _temporary() -> str:
    path = tempfile.mkdtemp(prefix="hubtrace-llm-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute once, keep in the shared folder, cut the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for a row, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but BLANKS; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " ", -1), "")


def lines_with_words(text: Column) -> Column:
    """Lines between line feeds that hold a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.filter(lines, lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)


def number_table(values: list[float]) -> Column:
    """A constant array, folded by the optimizer to one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
}


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    make: Callable[[], Callable[[list[str]], dict]],
    fields: dict[str, str],
    rows: int = 1000,
) -> DataFrame:
    """Rows (id, *fields) computed from whole texts, in Arrow batches of at most `rows` rows.

    make() runs once a task and returns the function that gets a list of texts
    (null: empty) and returns a column of values for each field. Ids pass unchanged.
    """
    kinds = [_ARROW[x] for x in fields.values()]
    source = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([source.schema[0]] + [
        T.StructField(n, T._parse_datatype_string(x)) for n, x in fields.items()
    ])
    names = [id_col, *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                found = work([x or "" for x in part.column(1).to_pylist()])
                columns = [pa.array(found[n], kind) for n, kind in zip(fields, kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    return source.mapInArrow(run, schema)


def filter_texts(
    docs: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], object]], rows: int = 1000
) -> DataFrame:
    """The rows of `docs` for whose text the function from make() gives true; no column changes."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                yield part.filter(pa.array(list(work([x or "" for x in part.column(at).to_pylist()])), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def replace_texts(
    docs: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list[str]]], rows: int = 1000
) -> DataFrame:
    """The rows of `docs` with each text replaced by what the function from make() gives; null stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                old = part.column(at).to_pylist()
                new = work([x or "" for x in old])
                kept = [None if x is None else y for x, y in zip(old, new)]
                yield part.set_column(at, part.schema.field(at), pa.array(kept, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
