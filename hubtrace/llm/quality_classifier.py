"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts inside the tasks. The trees are fitted on
the driver from a bounded sample of labelled rows (`max_rows`), flattened
into arrays, and sent with the job; scoring walks all trees of a batch at
once, one numpy step per level.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubtrace.llm.common import filter_texts, map_texts

#: Labelled rows used for fitting, at most: those with the smallest hash of their id.
MAX_ROWS = 20_000
THRESHOLD = 0.7

SYMBOLS = "#*$%&|<>"

STATISTICS = (
    "log_chars", "log_words", "mean_word", "std_word", "max_word", "upper_share", "digit_share",
    "punct_share", "symbol_share", "blank_share", "line_feed_share", "non_ascii_share", "char_entropy",
    "upper_words", "symbol_words", "distinct_words", "top_word", "same_neighbour", "distinct_pairs",
    "short_words", "log_lines", "dup_lines", "mean_line", "full_stops", "exclamations",
)


def statistics(text: str) -> list[float]:
    """The numbers a text is judged by, in the order of STATISTICS; all 0 for an empty text."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, k = len(text), len(words)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    ascii_counts = np.bincount(codes[codes < 128], minlength=128)
    share = lambda chars: float(sum(ascii_counts[ord(c)] for c in chars)) / n
    p = ascii_counts[ascii_counts > 0] / n
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=k)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return [
        math.log1p(n), math.log1p(k), float(lengths.mean()), float(lengths.std()), float(lengths.max()),
        float(ascii_counts[65:91].sum()) / n, float(ascii_counts[48:58].sum()) / n,
        share(".,;:!?'\"()-"), share(SYMBOLS), share(" "), share("\n"),
        1.0 - float(ascii_counts.sum()) / n, float(-(p * np.log2(p)).sum()),
        sum(map(str.isupper, words)) / k, sum(w[-1] in SYMBOLS for w in words) / k,
        len(counts) / k, max(counts.values()) / k, sum(map(eq, words, words[1:])) / k,
        len(set(zip(words, words[1:]))) / max(k - 1, 1), float((lengths <= 3).mean()),
        math.log1p(len(lines)), 1.0 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)), sum(w[-1] == "." for w in words) / k,
        sum(w[-1] == "!" for w in words) / k,
    ]


@dataclass
class Trees:
    """All trees as arrays of shape (trees, nodes); node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        n_trees = len(self.feature)
        if not n_trees:
            return np.full(len(x), 1 / (1 + math.exp(-self.start)))
        tree = np.arange(n_trees)
        at = np.zeros((len(x), n_trees), dtype=np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.limit[tree, at])
        raw = self.start + self.leaf[tree, at - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    n_trees: int = 60,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    l2: float = 1.0,
    least: int = 5,
) -> Trees:
    """Boosted trees for the log loss, grown level by level on histograms of binned statistics.

    Without rows of both labels the result is a constant: (ones + 1) / (rows + 2).
    """
    nodes = 2**depth - 1
    ones = float(y.sum())
    share = (ones + 1) / (len(y) + 2)
    trees = Trees(
        np.zeros((0, nodes), dtype=np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)),
        math.log(share / (1 - share)), depth,
    )
    if ones in (0, len(y)):
        return trees
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    column = np.arange(width) * bins + binned
    raw = np.full(n, trees.start)
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, limit = np.zeros(nodes, dtype=np.int64), np.full(nodes, np.inf)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, m = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (width * bins) + column).ravel()
            sums = [
                np.bincount(cell, np.repeat(w, width), m * width * bins).reshape(m, width, bins)
                for w in (grad, hess, np.ones(n))
            ]
            g, h, c = (s.cumsum(axis=2)[:, :, :-1] for s in sums)
            gt, ht, ct = (s.sum(axis=2, keepdims=True) for s in sums)
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(c < least) | (ct - c < least)] = 0
            flat = gain.reshape(m, -1)
            best = flat.argmax(axis=1)
            for k in np.nonzero(flat[np.arange(m), best] > 1e-6)[0]:
                j, b = divmod(int(best[k]), bins - 1)
                if b < len(edges[j]):
                    feature[first + k], limit[first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > limit[at])
        leaf_of = at - nodes
        leaf = -rate * np.bincount(leaf_of, grad, nodes + 1) / (np.bincount(leaf_of, hess, nodes + 1) + l2)
        raw += leaf[leaf_of]
        grown.append((feature, limit, leaf))
    trees.feature, trees.limit, trees.leaf = (np.stack(a) for a in zip(*grown))
    return trees


def held_out(id_col: str) -> Column:
    """crc32 of the id as text modulo 4 is 2; false for a null id."""
    remainder = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))
    return F.coalesce(remainder == 2, F.lit(False))


def fit_on(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_ROWS,
) -> Trees:
    """Trees fitted on labelled documents that are not held out.

    Labels other than 0 and 1 and null ids are left out; an id with several
    labels counts with the smallest. Above `max_rows` labelled ids, those with the smallest
    hash are used; should ids repeat in `docs`, the `max_rows` rows with the smallest hash of id and text are. So
    what the driver gets is bounded and does not depend on the order of rows.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = (
        usable.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("double").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sample = texts.join(F.broadcast(chosen), "_id")  # at most max_rows ids
    sample = sample.select(F.struct("_label", F.xxhash64("_id", "_text").alias("h")).alias("_key"), "_text")
    numbers = map_texts(sample, "_key", "_text", _numbers, {"x": "array<double>"})
    rows = numbers.orderBy("_key.h", "x", "_key._label").limit(max_rows).collect()
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r["_key"]["_label"] for r in rows], dtype=np.float64))


def _numbers():
    return lambda texts: {"x": [statistics(t) for t in texts]}


def classify(
    docs: DataFrame,
    trees: Trees,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of `docs`: id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Every row is judged on its text alone; null counts as empty and gets the
    score of an empty text. Ids may be null or repeat. Other columns are not
    used; an empty table gives no rows.
    """

    def make():
        def work(texts: list[str]) -> dict:
            x = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), -1)
            return {"score": trees.score(x)}

        return work

    scored = map_texts(docs, id_col, text_col, make, {"score": "double"})
    return scored.select(
        id_col, held_out(id_col).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Fit on `labels` (see fit_on) and judge all of `docs` (see classify)."""
    trees = fit_on(docs, labels, id_col, text_col, max_rows=max_rows)
    return classify(docs, trees, id_col, text_col, threshold)


def accepted(
    docs: DataFrame, trees: Trees, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of `docs`, unchanged, whose text scores `threshold` or more; cases as in classify."""
    return filter_texts(docs, text_col, lambda: lambda texts: trees.score(
        np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), -1)
    ) >= threshold)
