"""Quality rules: base counts, and a log-likelihood ratio over hashed n-grams.

Two multinomials over hashed word unigrams and bigrams are counted over whole
tables: one for the raw corpus, one for its trusted part. A document's score
is the mean log ratio of its n-grams; a fixed threshold decides on every
document.

Everything runs on built-in functions. Each distinct n-gram has counts of its own (64-bit
hashes, no modulo), so a ratio means the same whatever the size of the corpus. N-grams are combined within each text and cross one shuffle by their hash, behind which
they are counted and scored; the driver receives two totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubtrace.llm.common import let, lines_with_words, words_of

#: Characters that count as symbols; limits of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: In nats an n-gram. As n-grams do not share counts, more text moves bad documents away from it, not towards it.
THRESHOLD = -0.042
PSEUDO = 100.0


def _grams(words: Column, buckets: int | None) -> Column:
    """Hashes of all words and all pairs of neighbours; modulo `buckets` where that is given."""

    def of(hashed: Column) -> Column:
        pair = lambda x, i: F.xxhash64(x, F.get(hashed, i + 1))
        pairs = F.transform(F.slice(hashed, 1, F.greatest(F.size(hashed) - 1, F.lit(0))), pair)
        every = F.concat(hashed, pairs)
        return every if buckets is None else F.transform(every, lambda x: F.pmod(x, F.lit(buckets).cast("long")))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _marked(docs: DataFrame, trusted: DataFrame, id_col: str) -> DataFrame:
    """The rows of `docs` (_id, ...) with _trusted: 1 where `trusted` lists the id, else null."""
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()
    # The same join at every size: texts are dealt by id once, in whatever way labels grow.
    return docs.join(ids.withColumn("_trusted", F.lit(1)).hint("merge"), "_id", "left")


def _share(texts: DataFrame, trusted: DataFrame, id_col: str) -> float:
    """The trusted part of all n-grams of the rows (_id, _text); 0 without any."""
    sizes = texts.select("_id", F.size(words_of(F.col("_text"))).cast("long").alias("n"))
    sizes = sizes.select("_id", F.when(F.col("n") > 0, 2 * F.col("n") - 1).otherwise(0).alias("n"))
    total = _marked(sizes, trusted, id_col).agg(
        F.sum("n").alias("raw"), F.sum(F.when(F.col("_trusted") == 1, F.col("n"))).alias("target")
    ).first()
    return total["target"] / total["raw"] if total["target"] else 0.0


def _millionths(raw: Column, target: Column, part: float, pseudo: float) -> Column:
    """Log of trusted over raw share; `part` is the trusted part of all n-grams."""
    ratio = F.log((target / F.lit(part) + pseudo) / (raw + pseudo)) if part else F.lit(0)
    return F.round(ratio * 1_000_000).cast("long")


def ngram_ratio(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
    pseudo: float = PSEUDO,
) -> DataFrame:
    """Rows (gram, ratio): log of trusted over raw share in millionths, drawn towards 0 for rare ones.

    Each n-gram of the raw corpus gets `pseudo` more counts, and each of the target as many in
    proportion to its size, so both stay multinomials and what was hardly ever seen says little.
    There is a row for each distinct n-gram, or for each bucket that occurs if `buckets` is given.

    `trusted` lists ids; rows of `docs` with these ids form the target. Ids may
    repeat or be null (a null id is never trusted). Without trusted rows, or
    without any word in them, all ratios are 0.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    grams = _marked(texts, trusted, id_col).select(
        "_trusted", F.explode(_grams(words_of(F.col("_text")), buckets)).alias("gram")
    )
    counted = grams.groupBy("gram").agg(
        F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("target")
    )
    part = _share(texts, trusted, id_col)
    return counted.select("gram", _millionths(F.col("raw"), F.col("target"), part, pseudo).alias("ratio"))


def _runs(marked: DataFrame, buckets: int | None) -> DataFrame:
    """Rows (_id, _own, _trusted, gram, n) of rows (_id, _text, _trusted); n of a text's gram sums to its count.

    _own is a hash of the text. The hashes of a text are sorted; a run of equal ones becomes a row
    with 1 if it is single, else one row for its start and one for its end, with minus the number of
    hashes before the run and plus the number up to its end. Each row is made from its neighbours
    alone, so this is compiled code over exploded rows, without lambdas.
    """
    found = marked.select(
        "_id", F.xxhash64("_text").alias("_own"), "_trusted", F.explode(F.array(words_of(F.col("_text")))).alias("_words")
    )
    found = found.select(
        "_id", "_own", "_trusted", F.explode(F.array(F.sort_array(_grams(F.col("_words"), buckets)))).alias("_all")
    )
    found = found.select("_id", "_own", "_trusted", "_all", F.posexplode("_all").alias("_at", "gram"))
    every, at, gram = F.col("_all"), F.col("_at"), F.col("gram")
    found = found.withColumn("_first", (at == 0) | (F.get(every, at - 1) != gram)).withColumn(
        "_last", F.coalesce(F.get(every, at + 1) != gram, F.lit(True))
    )
    n = F.when(F.col("_first") & F.col("_last"), 1).when(F.col("_last"), at + 1).otherwise(-at)
    return found.where("_first OR _last").select("_id", "_own", "_trusted", "gram", n.cast("long").alias("n"))


def ngram_scores(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
    pseudo: float = PSEUDO,
) -> DataFrame:
    """Rows (_id, _own, score): the mean ratio of the n-grams of each distinct (id, text) with a word.

    The ratios are those of `ngram_ratio`. N-grams are combined within a text and cross one shuffle by
    their hash, behind which they are counted and scored where they are. Sums are of whole numbers,
    so their order does not matter.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    part = _share(texts, trusted, id_col)
    runs = _runs(_marked(texts, trusted, id_col), buckets)
    same, n = Window.partitionBy("gram"), F.col("n")
    raw, target = F.sum(n).over(same), F.coalesce(F.sum(F.when(F.col("_trusted") == 1, n)).over(same), F.lit(0))
    met = runs.select("_id", "_own", "n", _millionths(raw, target, part, pseudo).alias("ratio"))
    # Rows that repeat add to both sums alike and leave the mean as it is.
    sums = met.groupBy("_id", "_own").agg(
        F.sum(F.col("n") * F.col("ratio")).alias("sum"), F.sum("n").alias("n")
    )
    return sums.select("_id", "_own", F.round(F.col("sum") / F.col("n") / 1_000_000, 6).alias("score"))


def base_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; zeros for null."""
    full = F.coalesce(text, F.lit(""))
    size = lambda removed: F.length(F.translate(full, removed, ""))
    return {
        "word_chars": size(" \t\n\x0b\x0c\r").cast("long"),
        "n_symbols": (F.length(full) - size(SYMBOLS)).cast("long"),
        "n_dup_lines": let(
            lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))
        ).cast("long"),
    }


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice.

    Each window becomes one long: the upper bits a hash, the lower ones its
    position (as many as the document needs), so that one sort of primitive
    longs brings equal windows together. Equal hashes of neighbours are
    checked on the words themselves; should they ever differ, the document is
    counted by sorting the windows as text.
    """
    n = F.size(words)

    def covered(places: Column) -> Column:
        sorted_places = F.sort_array(places)
        step = lambda s: F.aggregate(
            F.transform(s, lambda p, k: F.least(F.coalesce(F.get(s, k + 1) - p, F.lit(3)), F.lit(3))),
            F.lit(0),
            lambda a, x: a + x,
        )
        return let(sorted_places, step)

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def by_text(count: Column) -> Column:
        pairs = F.array_sort(
            F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(window(i).alias("w"), i.alias("i")))
        )
        return let(
            pairs,
            lambda s: covered(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: (x["w"] == F.coalesce(F.get(s, k + 1)["w"], F.lit("")))
                        | ((k > 0) & (x["w"] == F.coalesce(F.get(s, k - 1)["w"], F.lit("")))),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def by_hash(hashed: Column, low: Column, count: Column) -> Column:
        hash_of = lambda i: F.xxhash64(F.get(hashed, i), F.get(hashed, i + 1), F.get(hashed, i + 2))
        packed = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda i: hash_of(i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")),
            )
        )

        def of(s: Column) -> Column:
            same = lambda x, y: F.coalesce(
                x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(low)) == 0, F.lit(False)
            )
            place = lambda x: x.bitwiseAND(low).cast("int")
            twins = F.filter(
                s,
                lambda x, k: same(x, F.get(s, k + 1)) | ((k > 0) & same(x, F.get(s, k - 1))),
            )

            def verified(t: Column) -> Column:
                clash = F.exists(
                    F.transform(
                        t, lambda x, k: F.struct(x.alias("x"), F.get(t, k + 1).alias("y"))
                    ),
                    lambda p: same(p["x"], p["y"]) & (window(place(p["x"])) != window(place(p["y"]))),
                )
                return F.when(F.size(t) == 0, F.lit(0)).when(clash, by_text(count)).otherwise(
                    covered(F.transform(t, place))
                )

            return let(twins, verified)

        return let(packed, of)

    bits = F.ceil(F.log2(n + F.lit(1))).cast("int")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    counted = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: let(low, lambda m: by_hash(h, m, n - 2)),
    )
    return F.when(n < 3, F.lit(0)).otherwise(counted).cast("long")


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of `docs`: id, base counts, score, base_failed and kept.

    Null texts count as empty: 0 words, score 0, base_failed. Rows with equal
    or null ids are judged one by one on their own text. Columns of `docs`
    other than id and text are not used. An empty table gives no rows.
    """
    text = F.col("_text")
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).select(
        "_id", "_text", F.explode(F.array(words_of(text))).alias("_words")
    )
    words = F.col("_words")
    out = out.select(
        "_id",
        F.xxhash64("_text").alias("_own"),
        F.size(words).cast("long").alias("n_words"),
        *[c.alias(n) for n, c in base_counts(text).items()],
        _repeat_words(words).alias("n_repeat_words"),
    )
    scores = ngram_scores(docs, trusted, id_col, text_col, buckets)
    scores = scores.withColumnsRenamed({"_id": "_id_s", "_own": "_own_s"})
    same = F.col("_id").eqNullSafe(F.col("_id_s")) & (F.col("_own") == F.col("_own_s"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = out.join(scores.hint("merge"), same, "left").select(
        F.col("_id").alias(id_col), *names, F.coalesce("score", F.lit(0.0)).alias("score")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold)
    )
