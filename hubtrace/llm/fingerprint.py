"""Document fingerprints: homomorphic hashes of multisets of paragraphs.

A paragraph (a line with a word) is hashed to a wide vector; the fingerprint of a
document is the sum of its paragraphs' vectors, each lane modulo a power of two.
Order does not matter, and adding or taking away a paragraph adds or subtracts its vector.

The vector has two parts. EXACT lanes are 32-bit hashes of the whole paragraph, modulo
2^32: equal multisets have equal lanes. Each pair of lanes comes from an own 64-bit hash of the
paragraph under another starting value, so that two paragraphs agree in all of them with a chance of about 2^-256.
LIKENESS lanes are sums of signs, one per lane for each run of three words of the
paragraph, modulo 2^32: the squared distance of two such vectors estimates how
many runs the two documents do not share. They are printed modulo 2^16. The estimate of the likeness
has a standard error of about sqrt(1 / LIKENESS), 0.09, at most, and less the more alike the texts are.

Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubtrace.llm.common import BLANKS, let, lines_with_words, settle, words_of

EXACT, LIKENESS = 8, 128
RUN = 3
_LOW = 0xFFFFFFFF


def _exact_lanes(text: Column) -> Column:
    """Hex of the EXACT lanes of a text, 8 digits a lane."""
    paragraphs = F.transform(lines_with_words(text), lambda p: F.trim(p, F.lit(BLANKS)))

    def lane(p: Column, seed: int, part: Callable[[Column], Column]) -> Column:
        total = F.aggregate(
            # The hash of the first argument is the starting value for the second: the paragraph itself is hashed anew.
            F.transform(p, lambda x: F.xxhash64(F.lit(seed), x)),
            F.lit(0).cast("long"),
            lambda a, h: (a + part(h)).bitwiseAND(F.lit(_LOW)),
        )
        return F.lpad(F.hex(total), 8, "0")

    halves = (lambda h: h.bitwiseAND(F.lit(_LOW)), lambda h: F.shiftrightunsigned(h, 32))

    def lanes(p: Column) -> list[Column]:
        return [lane(p, seed, part) for seed in range(EXACT // 2) for part in halves]

    return let(paragraphs, lambda p: F.concat(*lanes(p)))


def _runs(text: Column) -> Column:
    """Hashes of the runs of RUN words of each paragraph (a shorter one: all its words)."""

    def of(words: Column) -> Column:
        heads = F.slice(words, 1, F.greatest(F.size(words) - (RUN - 1), F.lit(1)))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, RUN)]))

    return F.flatten(F.transform(lines_with_words(text), lambda p: let(words_of(p), of)))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Rows (*keys, exact, lanes): one per distinct value of `keys`, which must fix the text.

    exact is hex; lanes is an array of LIKENESS numbers modulo 2^32, as signed numbers: whole for
    texts of up to 2^31 runs, which is more than a string can hold. Rows that agree in all
    keys are taken as one. If the rows are already dealt by some of the keys, nothing is shuffled.
    """
    base = texts.select(*keys, _exact_lanes(F.col(text_col)).alias("exact"), _runs(F.col(text_col)).alias("_runs"))
    # A null in front of the runs counts the rows that carry the same keys.
    marked = F.concat(F.array(F.lit(None).cast("long")), F.col("_runs"))
    each = base.select(*keys, "exact", F.explode(marked).alias("_run"))
    # Two 32-bit counters share a long; a sign lane is twice its ones less the number of runs.
    pair = 0x0000000100000001
    sums = []
    for seed in range(LIKENESS // 64):
        hashed = F.col(f"_h{seed}")
        sums += [
            F.sum(F.shiftrightunsigned(hashed, k).bitwiseAND(F.lit(pair))).alias(f"_s{seed}_{k}")
            for k in range(32)
        ]
    each = each.withColumns({
        f"_h{s}": F.col("_run") if s == 0 else F.xxhash64("_run", F.lit(s)) for s in range(LIKENESS // 64)
    }).withColumns({f"_h{s}": F.when(F.col("_run").isNotNull(), F.col(f"_h{s}")) for s in range(LIKENESS // 64)})
    counted = each.groupBy(*keys, "exact").agg(
        F.count("_run").alias("_n"), F.count(F.lit(1)).alias("_all"), *sums
    )
    rows = F.col("_all") - F.col("_n")

    def lane(ones: Column) -> Column:
        return _wrapped(F.floor((2 * ones - F.col("_n")) / rows))

    lanes = []
    for seed in range(LIKENESS // 64):
        for k in range(32):
            both = F.coalesce(F.col(f"_s{seed}_{k}"), F.lit(0).cast("long"))
            lanes += [lane(both.bitwiseAND(F.lit(_LOW))), lane(F.shiftrightunsigned(both, 32))]
    return counted.select(*keys, "exact", F.array(*lanes).alias("lanes"))


def _wrapped(x: Column, bits: int = 32) -> Column:
    """A number modulo 2^bits, as the signed number that stands for it."""
    half = F.lit(1 << (bits - 1)).cast("long")
    kind = "int" if bits == 32 else "smallint"
    return (F.pmod(x.cast("long") + half, F.lit(1 << bits).cast("long")) - half).cast(kind)


def printed(exact: Column, lanes: Column) -> Column:
    """A fingerprint as hex: the exact lanes, then 4 digits a likeness lane (modulo 2^16)."""
    digits = lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(1 << 16))), 4, "0")
    return F.lower(F.concat(exact, F.array_join(F.transform(lanes, digits), "")))


def combined_exact(a: Column, b: Column, sign: int = 1) -> Column:
    """Hex of the EXACT lanes after inserting (sign 1) or deleting (sign -1) what b stands for."""

    def lane(i: Column) -> Column:
        x, y = (F.conv(F.substr(v, i * 8 + 1, F.lit(8)), 16, 10).cast("long") for v in (a, b))
        return F.lpad(F.hex((x + sign * y).bitwiseAND(F.lit(_LOW))), 8, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(EXACT - 1)), lane), "")


def inserted(a: Column, b: Column) -> Column:
    """The fingerprint (a struct of exact and lanes) of what a and b stand for together, each paragraph as often as in both."""
    return F.struct(combined_exact(a["exact"], b["exact"]).alias("exact"), combined(a["lanes"], b["lanes"]).alias("lanes"))


def deleted(a: Column, b: Column) -> Column:
    """The fingerprint (a struct of exact and lanes) of a without the paragraphs of b, which must all be in a."""
    return F.struct(
        combined_exact(a["exact"], b["exact"], -1).alias("exact"), combined(a["lanes"], b["lanes"], -1).alias("lanes")
    )


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Likeness lanes after inserting (sign 1) or deleting (sign -1) what b stands for."""
    return F.zip_with(a, b, lambda x, y: _wrapped(x.cast("long") + sign * y.cast("long")))


def likeness(exact_a: Column, lanes_a: Column, exact_b: Column, lanes_b: Column) -> Column:
    """1 for equal fingerprints, else 1 less the share of runs that differ, 0 at least.

    |a - b|^2 / (|a|^2 + |b|^2) is 0 for equal vectors and about 1 for two that
    share no run.
    """
    square = lambda v: F.aggregate(
        v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")
    )
    apart = square(combined(lanes_a, lanes_b, -1))
    total = square(lanes_a) + square(lanes_b)
    share = F.greatest(F.lit(0.0), F.lit(1.0) - apart / F.nullif(total, F.lit(0.0)))
    return F.when((exact_a == exact_b) & (lanes_a == lanes_b), F.lit(1.0)).otherwise(
        F.round(F.coalesce(share, F.lit(0.0)), 6)
    )


def next_keys(keys: DataFrame) -> DataFrame:
    """Rows (key, next_key): for each distinct key the next smaller one; the smallest gets the greatest.

    Keys are dealt by ranges; each range orders its own, and one row a range closes the gaps.
    """
    dealt = settle(
        keys.select("key").distinct().repartitionByRange("key").withColumn("_part", F.spark_partition_id())
    )
    inside = dealt.withColumn("_lower", F.lag("key").over(Window.partitionBy("_part").orderBy("key")))
    ends = dealt.groupBy("_part").agg(F.max("key").alias("_top"))
    ranges = Window.orderBy("_part")
    below = ends.select(
        "_part",
        F.lag("_top").over(ranges).alias("_below"),
        F.max("_top").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"),
    )
    return inside.join(below, "_part").select(
        "key", F.coalesce("_lower", "_below", "_last").alias("next_key")
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and an edited form of it, and compare.

    One row per distinct (id, text): id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The edited text has its last
    floor(n_chars / 3) code points replaced by the first as many (or all) of the next document in
    descending order of id; after the last comes the first, and a lone document
    follows itself. If the next id has several texts, the smallest replacement counts for the edit and the
    smallest fingerprint for near_next. Ids are whole numbers; a null id takes part as
    the smallest of all. Null texts count as empty: no paragraphs, all lanes 0. Other columns
    are not used; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    third = F.floor(F.length("text") / 3).cast("int")
    links = settle(
        next_keys(base).join(base.groupBy("key").agg(F.max(third).alias("need")), "key")
    )
    patches = base.join(
        links.select(F.col("key").alias("to"), F.col("next_key").alias("key"), "need"), "key"
    ).select(F.col("to").alias("key"), F.substring("text", F.lit(1), F.col("need")).alias("patch"))
    patches = patches.groupBy("key").agg(F.min("patch").alias("patch"))
    joined = base.join(patches, "key").join(links.select("key", "next_key"), "key")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - third), F.substring("patch", F.lit(1), third)
    )
    both = joined.select(
        "key", "next_key", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("own"),
        F.sha2(edited, 256).alias("edited_sha256"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")),
            F.struct(F.lit(1).alias("kind"), edited.alias("t")),
        )).alias("v"),
    ).select("key", "next_key", "n_chars", "own", "edited_sha256", "v.kind", "v.t")
    keys = ["key", "next_key", "n_chars", "own", "edited_sha256", "kind"]
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = settle(
        fingerprints(both, keys, "t").groupBy(*keys[:-1]).agg(
            pick(0, "exact").alias("exact"), pick(0, "lanes").alias("lanes"),
            pick(1, "exact").alias("exact_e"), pick(1, "lanes").alias("lanes_e"),
        ).select(
            # The edited lanes are whole for the likeness; from here on only their print is needed.
            *keys[:-1], "exact", "lanes", "exact_e",
            F.transform("lanes_e", lambda x: _wrapped(x, 16)).alias("lanes_e"),
            likeness(F.col("exact"), F.col("lanes"), F.col("exact_e"), F.col("lanes_e")).alias("near_edited"),
        )
    )
    after = wide.groupBy(F.col("key").alias("next_key")).agg(
        F.min(F.struct("exact", "lanes")).alias("after")
    )
    c = F.col
    return wide.join(after, "next_key").select(
        F.when(c("key") != -(1 << 63), c("key")).cast(kind).alias(id_col), "n_chars", "edited_sha256",
        printed(c("exact"), c("lanes")).alias("fingerprint"),
        printed(c("exact_e"), c("lanes_e")).alias("edited_fingerprint"),
        "near_edited",
        likeness(c("exact"), c("lanes"), c("after.exact"), c("after.lanes")).alias("near_next"),
    )
