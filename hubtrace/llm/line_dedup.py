"""Line dedup by pairwise alignment.

Documents are sequences of line hashes. Overlapping documents are found through
rare hashes: for each line, the hash of the shortest run of whole lines from it on that
holds `min_words` words (a long line is its own run). Such a hash repeats only where a
passage does, while a short line alone may occur anywhere. Each document is paired with the
earliest document that has the same run, never with all of them, so a group of copies
costs a pair per copy.

Each pair is aligned with patience diff, and the aligned common blocks of `min_words`
words or more are deleted from the later document. A passage of that size made of whole lines that an
earlier document holds is thus always found: its runs are shared with the earliest holder. A passage that
is pasted into a longer line, or broken into other lines, shares no whole line and is not found.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubtrace.llm.common import BLANKS, map_texts, settle

MIN_WORDS = 50
#: Pieces into which the documents that share one run are dealt.
SALTS = 16


def hashed_lines(text: str) -> tuple[list[int], list[int], list[int]]:
    """Line numbers, hashes and word counts of the lines of a text that hold a word.

    Lines end at line feeds and are compared without blanks at their ends.
    """
    place, hashes, words = [], [], []
    for k, line in enumerate(text.split("\n")):
        line = line.strip(BLANKS)
        if line:
            place.append(k)
            hashes.append(xxhash.xxh64_intdigest(line) - (1 << 63))
            words.append(len(line.split()))
    return place, hashes, words


def runs_of(hashes: list[int], words: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(hash, first, end) of the shortest run from each line on that holds `min_words` words;
    lines too near the end have none."""
    found, end, held = [], 0, 0
    for k in range(len(hashes)):
        while end < len(hashes) and held < min_words:
            held += words[end]
            end += 1
        if held < min_words:
            break
        key = b"".join(h.to_bytes(8, "little", signed=True) for h in hashes[k:end])
        found.append((xxhash.xxh64_intdigest(key, seed=1) - (1 << 63), k, end))
        held -= words[k]
    return found


def _increasing(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(places)
    for k, p in enumerate(places):
        pile = bisect_left(tops, p)
        back[k] = top_at[pile - 1] if pile else -1
        tops[pile : pile + 1] = [p]
        top_at[pile : pile + 1] = [k]
    chain, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        chain.append(k)
        k = back[k]
    return chain[::-1]


def patience_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned equal elements (i, j) of two sequences, ascending in both.

    Equal ends are matched first, then elements that are unique on both sides,
    in their longest common order, and the same again between them. Where nothing
    is unique, equal elements are told apart by how often they came before.
    """
    pairs: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, i_end, j, j_end = stack.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            pairs.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        if any(n == 1 and in_b[x] == 1 for x, n in in_a.items()):
            keys_a = [(x, 0) if in_a[x] == in_b[x] == 1 else None for x in a[i:i_end]]
            keys_b = [(x, 0) if in_a[x] == in_b[x] == 1 else None for x in b[j:j_end]]
        else:
            keys_a, keys_b = _numbered(a[i:i_end]), _numbered(b[j:j_end])
        where = {x: k for k, x in enumerate(keys_b) if x is not None}
        common = [(k, where[x]) for k, x in enumerate(keys_a) if x is not None and x in where]
        if not common:
            continue
        anchors = [common[k] for k in _increasing([q for _, q in common])]
        last_i, last_j = i, j
        for p, q in anchors:
            pairs.append((i + p, j + q))
            stack.append((last_i, i + p, last_j, j + q))
            last_i, last_j = i + p + 1, j + q + 1
        stack.append((last_i, i_end, last_j, j_end))
    return sorted(pairs)


def _numbered(values: list[int]) -> list[tuple[int, int]]:
    seen: Counter = Counter()
    out = []
    for x in values:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def _stretches(places: list[int]) -> Iterator[list[int]]:
    """Neighbouring numbers together."""
    part: list[int] = []
    for k in places:
        if part and k != part[-1] + 1:
            yield part
            part = []
        part.append(k)
    if part:
        yield part


def common_blocks(
    later: list[int], earlier: list[int], words: list[int], earlier_runs: list[int], min_words: int
) -> list[int]:
    """Indexes of `later` in aligned common blocks of at least `min_words` words.

    A block is a stretch of neighbouring elements in both. What is left is aligned again until
    nothing more goes. Passages that stand in another order than in `earlier`, so that no
    alignment takes them, are found by their runs (`earlier_runs`) at the end.
    """
    left, gone = list(range(len(later))), set()
    while True:
        found: list[int] = []
        block: list[int] = []
        last = (-2, -2)
        for i, j in [*patience_pairs([later[k] for k in left], earlier), (-2, -2)]:
            joined = (i, j) == (last[0] + 1, last[1] + 1) and left[i] == left[last[0]] + 1
            if not joined:
                if sum(words[k] for k in block) >= min_words:
                    found += block
                block = []
            if i >= 0:
                block.append(left[i])
            last = (i, j)
        if not found:
            break
        gone |= set(found)
        left = [k for k in left if k not in gone]
    known = set(earlier_runs)
    for part in _stretches(left):
        for run, first, end in runs_of([later[k] for k in part], [words[k] for k in part], min_words):
            if run in known:
                gone |= set(part[first:end])
    return sorted(gone)


def delete_lines(text: str, lines: list[int]) -> str:
    gone = set(lines)
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, salts: int = SALTS
) -> DataFrame:
    """Rows (id, hash, lines): for each document that loses lines, their numbers from 0, ascending.

    Documents are distinct (id, text); hash is Spark's xxhash64 of the text. The order from
    early to late is that of the id, null first, then of the hash.
    """
    texts = docs.select(
        F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")).alias("doc"),
        F.col(text_col).alias("_text"),
    )

    def make():
        def work(batch: list[str]) -> dict:
            rows = [hashed_lines(t) for t in batch]
            return {
                "place": [p for p, _, _ in rows], "hashes": [h for _, h, _ in rows],
                "words": [w for _, _, w in rows],
                "runs": [list(dict.fromkeys(r for r, _, _ in runs_of(h, w, min_words))) for _, h, w in rows],
            }

        return work

    fields = {"place": "array<int>", "hashes": "array<long>", "words": "array<int>", "runs": "array<long>"}
    # Copies of a row are one document.
    once = map_texts(texts, "doc", "_text", make, fields).where(F.size("runs") > 0)
    lines = settle(once.dropDuplicates(["doc"]))
    keys = lines.select("doc", F.explode("runs").alias("run"))
    # Combined in the map tasks, so the documents that share a run never meet in one.
    shared = keys.groupBy("run").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    salted = shared.select("run", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    pairs = (
        keys.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
        .join(salted, ["run", "salt"]).where("first < doc").select("doc", "first").distinct()
    )
    later = pairs.join(lines.select("doc", "place", "hashes", "words"), "doc")
    # A document that many others repeat is a busy value of `first`; as both sides come straight
    # from a shuffle, Spark can split it.
    earlier = lines.select(
        F.col("doc").alias("first"), F.col("hashes").alias("earlier"), F.col("runs").alias("earlier_runs")
    )
    both = later.join(earlier, "first").select("doc", "place", "hashes", "words", "earlier", "earlier_runs")
    doc_type = both.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", doc_type), T.StructField("lines", T.ArrayType(T.IntegerType()))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                columns = [part.column(c).to_pylist() for c in range(1, 6)]
                gone = [
                    [place[x] for x in common_blocks(later, earlier, words, runs, min_words)]
                    for place, later, words, earlier, runs in zip(*columns)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(gone, pa.list_(pa.int32()))], ["doc", "lines"]
                )

    aligned = both.mapInArrow(align, schema).where(F.size("lines") > 0)
    joined = aligned.groupBy("doc").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines")
    )
    return joined.select(F.col("doc.id").alias(id_col), F.col("doc.h").alias("hash"), "lines")


def _marked(docs: DataFrame, id_col: str, text_col: str, min_words: int, salts: int) -> DataFrame:
    """The rows of `docs` with the text cut, and _found_lines and _found_empty besides."""
    found = repeated_lines(docs, id_col, text_col, min_words, salts).select(
        F.col(id_col).alias("_found_id"), F.col("hash").alias("_found_hash"), F.col("lines").alias("_found_lines")
    )
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.withColumn("_found_own", own).join(
        found, (F.col("_found_own") == F.col("_found_hash")) & F.col(id_col).eqNullSafe(F.col("_found_id")), "left"
    )
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.filter(lines, lambda x, k: ~F.array_contains(F.col("_found_lines"), k))
    text = F.when(F.col("_found_lines").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    wordless = F.length(F.trim(F.col(text_col), F.lit(BLANKS))) == 0
    return joined.select(*columns, "_found_lines").withColumn(
        "_found_empty", F.coalesce(F.col("_found_lines").isNotNull() & wordless, F.lit(False))
    )


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, salts: int = SALTS
) -> DataFrame:
    """The rows of `docs` with passages deleted that an earlier document holds.

    All columns stay; the text column is replaced; deleted_lines (array of line
    numbers) and emptied (no word is left of a text that had some) are added, in place
    of columns of these names if `docs` has any. A text that loses nothing stays
    as it is, null included. Copies of a row are treated alike: a document is never deleted
    in favour of itself. An empty table gives no rows.
    """
    out = _marked(docs.drop("deleted_lines", "emptied"), id_col, text_col, min_words, salts)
    return out.withColumn("_found_lines", F.coalesce("_found_lines", F.array().cast("array<int>"))).withColumnsRenamed(
        {"_found_lines": "deleted_lines", "_found_empty": "emptied"}
    )


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, salts: int = SALTS
) -> DataFrame:
    """As line_dedup, with the columns of `docs` alone and without the rows that it empties."""
    return _marked(docs, id_col, text_col, min_words, salts).where(~F.col("_found_empty")).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
