"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints are 64-bit majority sketches of word shingles. With radius r, the
2^(r+1) - 1 masks are built from the linear code of all dot products: position i
gets the vector i mod (2^(r+1) - 1) + 1 of r + 1 bits, and mask v keeps position
i where the dot product of v with that vector is odd. Any r positions leave
some v orthogonal to all their vectors, so two fingerprints that differ in at
most r positions agree under at least one mask, without exception.

Fingerprints alone under every mask have no partner. The others are linked
without comparing the members of a bucket with each other: each fingerprint
goes to all values within r // 2 bits of it (and, for odd r, the pairs that
meet at (r + 1) / 2 are checked), so a bucket of any size costs a bounded number
of rows per member.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubtrace.llm.common import BLANKS, map_texts, settle

BITS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER + BLANKS, LOWER + " " * len(BLANKS))


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of a text as a signed long; 0 without words.

    A-Z are lower-cased; words are split at x20 and x09 to x0D; each run of
    `shingle` words, repeats included, is hashed with XXH64 (fewer words: the
    whole sequence); a bit is 1 if more than half of the hashes have it.
    """
    words = [w for w in (text or "").translate(_FOLD).split(" ") if w]
    if not words:
        return 0
    runs = zip(*[words[i:] for i in range(min(shingle, len(words)))])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(" ".join(r), seed) for r in runs], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """Rows (id, fp): the signed long fingerprint of each row's text; null texts count as empty."""

    run = lambda: lambda texts: {"fp": [simhash(t, shingle, seed) for t in texts]}
    return map_texts(docs, id_col, text_col, run, {"fp": "long"})


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks, one of which ignores any `radius` positions."""
    size = (1 << (radius + 1)) - 1
    vector = [i % size + 1 for i in range(bits)]
    return [
        sum(1 << i for i in range(bits) if (v & vector[i]).bit_count() % 2) for v in range(1, size + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def link_edges(values: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b), a < b, that connect exactly those of the distinct longs `fp` linked by
    chains of steps of at most `radius` (even, 2 by default) bits."""
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = [_signed(m) for m in covering_masks(radius)]
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(m).alias("m")) for k, m in enumerate(masks)])
    hashed = values.select("fp", F.explode(tables).alias("x")).select(
        "fp", "x.t", F.col("fp").bitwiseAND(F.col("x.m")).alias("key")
    )
    # A bucket with two members or more has a smallest and a largest that differ.
    shared = hashed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi")
    partnered = hashed.join(shared.select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct()
    flips = [0] + [
        _signed(sum(1 << i for i in c)) for n in range(1, radius // 2 + 1) for c in combinations(range(BITS), n)
    ]
    near = partnered.select(
        "fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("mid")
    )
    # All fingerprints around one value lie within the radius of each other: a star links them.
    centre = near.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("hi")).where("a < hi")
    return (
        near.join(centre.select("mid", "a"), "mid").where("fp <> a")
        .select("a", F.col("fp").alias("b")).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for all nodes of `edges` (a, b): root is the smallest node reachable.

    Large-star and small-star steps in turn, each a grouped minimum and a join;
    the edges of a round replace those of the last one in the shared folder.
    """
    edges = settle(edges.select("a", "b"))
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b")
        down = large.distinct().select(F.col("b").alias("n"), F.col("a").alias("s"))
        root = down.groupBy("n").agg(F.min("s").alias("m"))
        joined = down.join(root, "n")
        small = (
            joined.select(F.col("m").alias("a"), F.col("s").alias("b")).where("a < b")
            .union(joined.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()
        )
        small = settle(small)
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            break
        edges = small
    return edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root").union(
        edges.select("a", "a").distinct()
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 2,
) -> DataFrame:
    """One row per row of `docs`: id, fingerprint (16 hex digits), component_id.

    Documents link if their fingerprints differ in at most `radius` bits;
    component_id is the smallest id reachable, itself included. Null and empty
    texts have fingerprint zero and link like any other. Null ids stay null and
    take their component's smallest id that is not null (null if none has
    one). Repeated rows give repeated rows. Other columns are not used; an
    empty table gives no rows.
    """
    marked = settle(fingerprints(docs, id_col, text_col, shingle))
    distinct = marked.groupBy("fp").agg(F.min(id_col).alias("_least"))
    member = settle(components(link_edges(distinct.select("fp"), radius)))
    rooted = distinct.join(member, distinct["fp"] == member["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "_least"
    )
    of_root = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    of_fp = rooted.join(of_root, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(id_col, _hex("fp").alias("fingerprint"), "component_id")


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """One row of `docs`, unchanged, for each component of near_duplicates.

    It is the row with the component's smallest id; among rows with that id the one
    with the smallest hash of its text. A component whose ids are all null keeps
    its smallest hash.
    """
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    marked = settle(
        fingerprints(docs.withColumn("_key", F.struct(F.col(id_col).alias("id"), own.alias("h"))), "_key", text_col, shingle)
    )
    order = F.struct(F.col("_key.id").isNull().alias("no_id"), F.col("_key.id").alias("id"), F.col("_key.h").alias("h"))
    distinct = marked.groupBy("fp").agg(F.min(order).alias("_least"))
    member = settle(components(link_edges(distinct.select("fp"), radius)))
    rooted = distinct.join(member, distinct["fp"] == member["node"], "left")
    chosen = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("_least").alias("_one")).select(
        F.col("_one.id").alias("_one_id"), F.col("_one.h").alias("_one_h")
    )
    same = F.col(id_col).eqNullSafe(F.col("_one_id")) & (own == F.col("_one_h"))
    kept = docs.join(chosen, same, "left_semi")
    # Rows that repeat with id and text are one document.
    return kept.dropDuplicates([id_col, text_col])
