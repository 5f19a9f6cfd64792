"""Aligning the tokens of two tokenizers.

Each text is tokenised whole by both. Where a space-marked token begins in both, the tokens before
end together: these anchors cut a document into windows of ids, about one a word. Windows repeat, so each distinct
one (a tuple of ids of A and one of B) is aligned once a task and remembered. Aligning means: groups between the byte
offsets where tokens of both end, and links between tokens whose bytes overlap.

How often a pair of ids is linked is counted over the whole corpus. Pairs are combined within each document and written;
counts are a distributed table with a row for each distinct pair. Documents meet the most frequent pairs,
a fixed number of them, in the map tasks, and only the others by a shuffle on the pair. So no pair that many documents
hold is ever gathered, and the counts are exact for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hubtrace.llm.bpe import gather
from hubtrace.llm.common import fresh_path
from hubtrace.llm.vocabularies import ByteLevel, Pieces, Tokens

#: Characters that a step of a task handles at once, whole documents; windows and tokens in windows that a task remembers.
#: A step's arrays take about 80 bytes a character beside those, and an executor runs a worker for each of its cores.
STEP_CHARS = 1 << 19
CACHE, CACHE_TOKENS = 200_000, 4_000_000
#: Pairs that documents meet in the map tasks; bounds what is broadcast.
FREQUENT = 200_000

class Runs:
    """Runs of numbers behind each other; none is empty."""

    def __init__(self, values: np.ndarray | None = None, first: np.ndarray | None = None):
        self.values = np.zeros(0, dtype=np.int64) if values is None else values
        self.first = np.zeros(0, dtype=np.int64) if first is None else first
        self.size = np.diff(self.first, append=len(self.values))

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        self.first = np.concatenate((self.first, len(self.values) + np.cumsum(size) - size))
        self.values = np.concatenate((self.values, values))
        self.size = np.concatenate((self.size, size))

    def of(self, which: np.ndarray) -> np.ndarray:
        return gather(self.values, self.first, self.size, which)

    def some(self, which: np.ndarray) -> Runs:
        size = self.size[which]
        return Runs(self.of(which), np.cumsum(size) - size)

    def hashed(self, salt: int) -> np.ndarray:
        """A hash of each run, of its numbers and their places."""
        place = (np.arange(len(self.values)) - np.repeat(self.first, self.size)).astype(np.uint64)
        x = (self.values.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x += place * np.uint64(0xD1B54A32D192ED03)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return np.add.reduceat(x, self.first)

    def equal(self, other: Runs, which: np.ndarray) -> np.ndarray:
        """Whether each run equals that one of `other`."""
        alike = self.size == other.size[which]
        if not alike.all():
            alike[alike] = self.some(np.flatnonzero(alike)).equal(other, which[alike])
            return alike
        return np.logical_and.reduceat(self.values == other.of(which), self.first) if len(alike) else alike


class Windows:
    """Alignments of windows by their ids: flat arrays of links, and of tokens in the order of their groups.

    A token in group order is its id, and its ending: 0 within a group, 1 last of A, 2 last of B.
    """

    def __init__(self, a: Tokens, b: Tokens, cache: int = CACHE, cache_tokens: int = CACHE_TOKENS):
        self.a, self.b, self.cache, self.cache_tokens = a, b, cache, cache_tokens
        self.ids = max(len(a.tokens), len(b.tokens))
        self.reset()

    def reset(self) -> None:
        none = lambda kind=np.int64: np.zeros(0, dtype=kind)
        # Hashes of known windows in order, and their numbers; the ids themselves, of A and B.
        self.keys, self.numbers = none(np.uint64), none()
        self.ids_a, self.ids_b = Runs(), Runs()
        self.links, self.order, self.n_groups = Runs(), Runs(), none()

    def of(self, flat_a: np.ndarray, flat_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first tokens of A, numbers) of all windows of documents that lie behind each other, with equal bytes."""
        if len(self.n_groups) > self.cache or len(self.order.values) > self.cache_tokens:
            self.reset()
        first_a, first_b = self._anchors(flat_a, flat_b)
        a, b = Runs(flat_a, first_a), Runs(flat_b, first_b)
        key = a.hashed(1) + b.hashed(1 << 33)
        _, distinct, number = np.unique(key, return_index=True, return_inverse=True)
        stand_in = distinct[number]
        if not (a.equal(a, stand_in).all() and b.equal(b, stand_in).all()):
            distinct = number = np.arange(len(key))  # a hash met two windows: take every window as it is
        return first_a, self._numbers(a.some(distinct), b.some(distinct), key[distinct])[number]

    def _numbers(self, a: Runs, b: Runs, key: np.ndarray) -> np.ndarray:
        """Numbers of windows; those are known whose hash and ids are."""
        which = np.full(len(key), -1, dtype=np.int64)
        at = np.searchsorted(self.keys, key)
        hit = np.flatnonzero(np.append(self.keys, np.uint64(0))[at] == key)
        hit = hit[at[hit] < len(self.keys)]
        if len(hit):
            number = self.numbers[at[hit]]
            same = a.some(hit).equal(self.ids_a, number) & b.some(hit).equal(self.ids_b, number)
            which[hit[same]] = number[same]
        new = np.flatnonzero(which < 0)
        if len(new):
            which[new] = len(self.n_groups) + np.arange(len(new))
            # Of equal hashes only the first is found again.
            fresh = new[np.append(self.keys, np.uint64(0))[at[new]] != key[new]]
            fresh = fresh[np.unique(key[fresh], return_index=True)[1]]
            place = np.searchsorted(self.keys, key[fresh])
            self.keys, self.numbers = np.insert(self.keys, place, key[fresh]), np.insert(self.numbers, place, which[fresh])
            self._learn(a.some(new), b.some(new))
        return which

    def _anchors(self, flat_a: np.ndarray, flat_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A and of B that are space-marked and begin at the same byte."""
        start_a = np.cumsum(self.a.size[flat_a]) - self.a.size[flat_a]
        start_b = np.cumsum(self.b.size[flat_b]) - self.b.size[flat_b]
        at_a, at_b = np.flatnonzero(self.a.spaced[flat_a]), np.flatnonzero(self.b.spaced[flat_b])
        near = np.searchsorted(start_b[at_b], start_a[at_a])
        near = np.minimum(near, len(at_b) - 1)
        both = start_b[at_b][near] == start_a[at_a]
        return at_a[both], at_b[near[both]]

    def _learn(self, a: Runs, b: Runs) -> None:
        """Align windows, all at once: each spans as many bytes in A as in B, so offsets run on over them."""
        ids_a, ids_b = a.values, b.values
        end_a, end_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        # A token of A meets the tokens of B from the first that ends behind its start to the first that reaches its end.
        low = np.searchsorted(end_b, end_a - self.a.size[ids_a], side="right")
        high = np.searchsorted(end_b, end_a, side="left")
        links = high - low + 1
        nth = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links)
        pairs = np.repeat(ids_a, links) * len(self.b.tokens) + ids_b[np.repeat(low, links) + nth]
        self.links.add(pairs, np.add.reduceat(links, a.first))
        # Groups end where both end; every window ends with one. Tokens of A stand behind all groups before theirs.
        last_a = end_b[high] == end_a
        last_b = np.zeros(len(ids_b), dtype=bool)
        last_b[high[last_a]] = True
        self.n_groups = np.concatenate((self.n_groups, np.add.reduceat(last_a.astype(np.int64), a.first)))
        upto_a, upto_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        place_a = np.arange(len(ids_a)) + np.concatenate(([0], upto_b))[np.cumsum(last_a) - last_a]
        place_b = np.arange(len(ids_b)) + upto_a[np.cumsum(last_b) - last_b]
        order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        order[place_a] = ids_a + self.ids * last_a
        order[place_b] = ids_b + 2 * self.ids * last_b
        self.order.add(order, a.size + b.size)
        self.ids_a.add(ids_a, a.size)
        self.ids_b.add(ids_b, b.size)


class Aligner:
    """Aligns batches of whole texts."""

    def __init__(self, a: Tokens, b: Tokens, **options):
        self.a, self.b, self.windows = a, b, Windows(a, b, **options)
        self.written = pa.array([f"{k}{end}" for end in ",|;" for k in range(self.windows.ids)], pa.large_string())

    def __call__(self, texts: list[str]) -> dict:
        """Columns n_a, n_b, n_groups, n_links, groups_sha256, and pairs with their numbers, for each text."""
        numbers = {n: np.zeros(len(texts), dtype=np.int64) for n in ("n_a", "n_b", "n_groups", "n_links", "n_pairs")}
        digests, nothing = [""] * len(texts), np.zeros(0, dtype=np.int64)
        asked = [k for k, x in enumerate(texts) if x]
        wanted = [texts[k] for k in asked]
        (flat_a, n_a), (flat_b, n_b) = self.a.flat([" " + x for x in wanted]), self.b.flat(wanted)
        whole = [b" " + x.encode("utf-8") for x in wanted]
        good = np.array([
            x == y == z for x, y, z in zip(whole, self.a.bytes_of(flat_a, n_a), self.b.bytes_of(flat_b, n_b))
        ], dtype=bool)
        if not good.any():
            return {**numbers, "groups_sha256": digests, "pairs": nothing, "times": nothing}
        flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
        kept, n_a, n_b = np.array(asked)[good], n_a[good], n_b[good]
        windows = self.windows
        first, which = windows.of(flat_a, flat_b)
        # Every text begins with a space in both, so it begins a window.
        begin = np.searchsorted(first, np.cumsum(n_a) - n_a)
        n_links = np.add.reduceat(windows.links.size[which], begin)
        numbers["n_a"][kept], numbers["n_b"][kept], numbers["n_links"][kept] = n_a, n_b, n_links
        numbers["n_groups"][kept] = np.add.reduceat(windows.n_groups[which], begin)
        text = self.written.take(pa.array(windows.order.of(which)))
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[np.cumsum(n_a + n_b)].tolist()
        data = memoryview(text.buffers()[2])
        for k, x, y in zip(kept.tolist(), [0, *ends], ends):
            digests[k] = hashlib.sha256(data[x : y - 1]).hexdigest()
        links = windows.links.of(which)
        space = len(self.a.tokens) * len(self.b.tokens)
        pairs, times = np.unique(np.repeat(np.arange(len(kept)), n_links) * space + links, return_counts=True)
        numbers["n_pairs"][kept] = np.bincount(pairs // space, minlength=len(kept))
        return {**numbers, "groups_sha256": digests, "pairs": pairs % space, "times": times}


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and whole texts of the batches, STEP_CHARS at once; only a step's texts become Python strings."""
    for batch in batches:
        first, size = 0, 0
        for k, chars in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
            size += chars
            if size >= STEP_CHARS or k + 1 == batch.num_rows:
                part = batch.slice(first, k + 1 - first)
                yield part.column(0), part.column(1).to_pylist()
                first, size = k + 1, 0


def align_documents(
    docs: DataFrame, path: str, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write rows (row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) below `path`, and read them.

    `row` tells rows apart whose ids are equal; `pairs` are the document's distinct links, as id of A times the size
    of B's vocabulary plus id of B, with their numbers in `times`.
    """
    source, model = open(byte_vocabulary, encoding="utf-8").read(), open(piece_model, "rb").read()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("id", rows.schema["id"].dataType)]
        + [T.StructField(n, T.LongType()) for n in numbers] + [T.StructField("groups_sha256", T.StringType())]
        + [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteLevel(source), Pieces(model))
        row = TaskContext.get().partitionId() << 33

        for ids, texts in steps(batches):
            found = aligner(texts)
            offsets = pa.array(np.concatenate(([0], np.cumsum(found["n_pairs"]))), pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(found[n], t.type.value_type), type=t.type)
                for n, t in (("pairs", arrow.field("pairs")), ("times", arrow.field("times")))
            ]
            columns = [pa.array(range(row, row + len(texts)), pa.int64()), ids]
            columns += [pa.array(found[n], pa.int64()) for n in numbers] + [pa.array(found["groups_sha256"], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *lists], schema=arrow)
            row += len(texts)

    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """Rows (pair, n, best): links of each pair in the corpus; best if none of its id of B has more.

    The greatest number for each id of B has at most as many rows as its vocabulary.
    """
    single = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    counts = single.groupBy(F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("n"))
    b = F.pmod("pair", F.lit(b_size).cast("long"))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    met = counts.withColumn("b", b).join(F.broadcast(most), "b")
    return met.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def cross_tokenizer(
    docs: DataFrame,
    byte_vocabulary: str,
    piece_model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """One row per row of `docs`: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts links whose pair is the most frequent of its id of B in the corpus, ties included; count_sum adds
    up the corpus counts of all links. Null and empty texts, and those whose tokens do not give back a space and the
    text, have zeros and an empty digest. Ids may be null or repeat: every row is aligned and counted. Other
    columns are not used; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = fresh_path(spark, "alignment")
    aligned = align_documents(docs, f"{base}/documents", byte_vocabulary, piece_model, id_col, text_col)
    b_size = sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()
    pair_counts(aligned, b_size).write.option("compression", "zstd").parquet(f"{base}/pairs")
    counts = spark.read.parquet(f"{base}/pairs")
    # A fixed number of rows.
    common = F.broadcast(counts.orderBy(F.desc("n"), "pair").limit(frequent))
    link = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    met = link.select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")).join(common, "pair", "left")
    sums = [
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
    ]
    in_map = met.where("n IS NOT NULL").groupBy("row").agg(*sums)
    rest = met.where("n IS NULL").select("row", "pair", "times").join(counts, "pair").groupBy("row").agg(*sums)
    whole = in_map.unionByName(rest).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("count_sum", "n_best")])
    nothing = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return aligned.drop("pairs", "times").join(whole, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", nothing("n_best"), nothing("count_sum"),
        "groups_sha256",
    )
