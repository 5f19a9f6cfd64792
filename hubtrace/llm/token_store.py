"""Token ids as files of wavelet matrices.

Documents are dealt by ranges of their id, encoded in that order, and written as
shards: each shard is one row of a Parquet file and holds a wavelet matrix, that
is one bit-plane per bit of an id with counts of ones per block. Access, counting and
occurrence lookup work on the planes of a shard without unpacking the rest. The row also
has the ids and lengths of its documents.

Spark's own writer and reader move the files, so any store that Spark knows
will do, and a task that is run again replaces what its first attempt wrote.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hubtrace.llm.common import fresh_path
from hubtrace.llm.vocabularies import ByteLevel

#: Tokens after which a shard is closed, bits of a rank block.
SHARD_TOKENS = 1 << 20
BLOCK = 512


class WaveletMatrix:
    """A sequence of ids below 2^bits as bit-planes, the highest bit first.

    Plane l holds bit l of all ids in the order after l stable partitions by the bits
    before; `zeros[l]` ids have a 0 there and come first in the next order.
    `ranks[l][b]` counts the ones of plane l before block b.
    """

    def __init__(self, size: int, bits: int, planes: np.ndarray, zeros: np.ndarray, ranks: np.ndarray):
        self.size, self.bits, self.planes, self.zeros, self.ranks = size, bits, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n = len(ids)
        blocks = -(-n // BLOCK)
        planes = np.zeros((bits, blocks * BLOCK // 8), dtype=np.uint8)
        zeros = np.zeros(bits, dtype="<i8")
        order = ids.astype(np.uint32 if bits > 16 else np.uint16)
        for level in range(bits):
            bit = order & order.dtype.type(1 << (bits - 1 - level)) != 0
            packed = np.packbits(bit, bitorder="little")
            planes[level, : len(packed)] = packed
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
            zeros[level] = len(low)
            dealt = np.empty_like(order)
            np.take(order, low, out=dealt[: len(low)], mode="clip")
            np.take(order, high, out=dealt[len(low) :], mode="clip")
            order = dealt
        ones = np.bitwise_count(planes.reshape(bits, blocks, BLOCK // 8)).sum(axis=2, dtype=np.int64)
        ranks = np.zeros((bits, blocks + 1), dtype="<i4")
        np.cumsum(ones, axis=1, out=ranks[:, 1:], dtype="<i4")
        return cls(n, bits, planes, zeros, ranks)

    @classmethod
    def from_row(cls, size: int, bits: int, planes: bytes, zeros: bytes, ranks: bytes) -> WaveletMatrix:
        return cls(
            size, bits, np.frombuffer(planes, dtype=np.uint8).reshape(bits, -1),
            np.frombuffer(zeros, dtype="<i8"), np.frombuffer(ranks, dtype="<i4").reshape(bits, -1),
        )

    def unpack(self) -> np.ndarray:
        """All ids, undoing the partitions from the last plane to the first."""
        order = np.zeros(self.size, dtype=np.uint32 if self.bits > 16 else np.uint16)
        for level in reversed(range(self.bits)):
            bit = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            back = np.empty_like(order)
            back[np.flatnonzero(~bit)] = order[: self.zeros[level]]
            back[np.flatnonzero(bit)] = order[self.zeros[level] :] | order.dtype.type(1 << (self.bits - 1 - level))
            order = back
        return order

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level, i >> 3] >> (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        block = i // BLOCK
        start = block * BLOCK // 8
        ones = int(self.ranks[level, block])
        ones += int(np.bitwise_count(self.planes[level, start : i >> 3]).sum(dtype=np.int64))
        return ones + (int(self.planes[level, i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def _place(self, level: int, nth: int, bit: int) -> int:
        """Position of the nth (from 0) occurrence of a bit in a plane."""
        counts = self.ranks[level].astype(np.int64)
        if not bit:
            counts = np.arange(len(counts)) * BLOCK - counts
        block = int(np.searchsorted(counts, nth, side="right")) - 1
        start = block * BLOCK // 8
        bits = np.unpackbits(self.planes[level, start : start + BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.nonzero(bits == bit)[0][nth - int(counts[block])])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        found = 0
        for level in range(self.bits):
            ones = self._ones(level, i)
            bit = self._bit(level, i)
            found = 2 * found + bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return found

    def _walk(self, token: int, end: int) -> tuple[int, int]:
        """First place of a token in the last order, and the place after its occurrences before `end`."""
        first = 0
        for level in range(self.bits):
            if token >> (self.bits - 1 - level) & 1:
                zero = int(self.zeros[level])
                first, end = zero + self._ones(level, first), zero + self._ones(level, end)
            else:
                first, end = first - self._ones(level, first), end - self._ones(level, end)
        return first, end

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token before position `end`."""
        if not 0 <= token < 1 << self.bits:
            return 0
        first, last = self._walk(token, end)
        return last - first

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of a token."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        i = self._walk(token, 0)[0] + nth
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._place(level, i - int(self.zeros[level]) * bit, bit)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def write_store(
    docs: DataFrame,
    path: str,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 2,
    bits: int = 16,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode whole texts in ascending order of id and write them below `path`.

    Null texts count as empty; `end_id` closes every document. Rows with equal ids are
    ordered by their text; null ids come first. Other columns are not used; an empty
    table gives an empty store. Ids of tokens must be below 2^bits.
    """
    source = open(vocabulary_path, encoding="utf-8").read()
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    id_type = rows.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
         T.StructField("n_tokens", T.LongType()), T.StructField("bits", T.IntegerType()),
         T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("lengths", T.BinaryType())]
        + [T.StructField(n, T.BinaryType()) for n in ("zeros", "ranks", "planes")]
    )
    id_arrow = pa.list_(to_arrow_type(id_type))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), id_arrow] + [pa.binary()] * 4
    end = np.array([] if end_id is None else [end_id], dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = ByteLevel(source, special=True), TaskContext.get().partitionId(), 0
        names, ids, size = [], [], 0

        def shard() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            if len(flat) and int(flat.max()) >> bits:
                raise ValueError(f"a token id does not fit into {bits} bits")
            m = WaveletMatrix.build(flat, bits)
            lengths = np.array([len(x) for x in ids], dtype="<i8")
            values = [part, seq, m.size, bits, names, lengths.tobytes(), m.zeros.tobytes(),
                      m.ranks.tobytes(), m.planes.tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, kinds)], schema.names
            )

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                chunk = batch.slice(k, 1000)
                for name, text in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist()):
                    names.append(name)
                    ids.append(np.concatenate((encoder.encode(text), end)))
                    size += len(ids[-1])
                    if size >= shard_tokens:
                        yield shard()
                        names, ids, size, seq = [], [], 0, seq + 1
        if names:
            yield shard()

    dealt.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files of a store, one per document written.

    start counts the ids of all documents before; ids_crc32 is that of the ids as
    little-endian unsigned 32-bit integers.
    """
    store = spark.read.parquet(path)
    id_type = store.schema["doc_ids"].dataType.elementType
    fields = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
        T.StructField("doc_id", id_type),
        *[T.StructField(n, T.LongType()) for n in ("within", "n_tokens", "ids_crc32")],
    ])
    id_arrow = to_arrow_type(id_type)
    wanted = ["part", "seq", "n_tokens", "bits", "doc_ids", "lengths", "zeros", "ranks", "planes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in wanted}
                matrix = WaveletMatrix.from_row(
                    row["n_tokens"], row["bits"], row["planes"], row["zeros"], row["ranks"]
                )
                ids = matrix.unpack().astype("<u4")
                lengths = np.frombuffer(row["lengths"], dtype="<i8")
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e]) for n, e in zip(lengths.tolist(), ends.tolist())]
                many = len(lengths)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(many, row["part"]), pa.int32()),
                    pa.array(np.full(many, row["seq"]), pa.int32()),
                    pa.array(row["doc_ids"], id_arrow), pa.array(ends - lengths),
                    pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64()),
                ], fields.names)

    heads = store.select("part", "seq", "n_tokens")
    # One row a range of ids, then one a shard of the range: no window sees all shards.
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = Window.partitionBy("part").orderBy("seq")
    starts = heads.join(before, "part").select(
        "part", "seq", (F.col("before") + F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("first")
    )
    return store.select(*wanted).mapInArrow(run, fields).join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_store(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Write a store to the shared folder and read its documents back: see write_store, read_documents."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-store")
    write_store(docs, path, vocabulary_path, id_col, text_col, **options)
    return read_documents(spark, path).withColumnRenamed("doc_id", id_col)
