import zlib

import numpy as np

from hubtrace.llm import quality_classifier as qc
from llm_docs import docs_of


def walk(trees, x):
    raw = trees.start
    for f, limit, leaf in zip(trees.feature, trees.limit, trees.leaf):
        at = 0
        for _ in range(trees.depth):
            at = 2 * at + 1 + int(x[f[at]] > limit[at])
        raw += leaf[at - len(f)]
    return 1 / (1 + np.exp(-raw))


def test_flat_trees_score_like_single_walks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 7))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = qc.fit(x[:400], y[:400])
    scores = trees.score(x)
    assert np.allclose(scores, [walk(trees, r) for r in x])
    assert ((scores[400:] > 0.5) == y[400:]).mean() > 0.9


def test_one_label_gives_a_constant():
    trees = qc.fit(np.zeros((3, 2)), np.ones(3))
    assert np.allclose(trees.score(np.ones((2, 2))), 4 / 5)
    assert np.allclose(qc.fit(np.zeros((0, 2)), np.zeros(0)).score(np.ones((2, 2))), 0.5)


def test_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = qc.quality_classifier(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.97


def test_held_out_labels_are_not_used(spark, small):
    docs = docs_of(spark, small)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    fair = [(i, int(len(t) % 2)) for i, t in small]
    spoilt = [(i, 1 - q if held(i) else q) for i, q in fair]
    first, second = (
        {r["doc_id"]: r["score"] for r in qc.quality_classifier(docs, spark.createDataFrame(x, "doc_id bigint, quality int")).collect()}
        for x in (fair, spoilt)
    )
    assert first == second


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 1), (None, 1), (6, 0), (7, None), (8, 5)], "doc_id bigint, quality int"
    )
    out = qc.quality_classifier(odd_docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert qc.quality_classifier(no_docs, labels).count() == 0
    trees = qc.fit_on(odd_docs, labels.where("false"))
    kept = qc.accepted(odd_docs, trees, threshold=0.0)
    assert kept.schema == odd_docs.schema and kept.count() == odd_docs.count()


def test_the_fit_is_bounded_and_does_not_hang_on_the_order_of_rows(spark, small):
    """Ids that repeat many times: at most max_rows rows, the same ones in any order."""
    rows = [(i, t + " " + str(k)) for i, t in small[:40] for k in range(5)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in small[:40]], "doc_id bigint, quality int")
    fits = []
    real = qc.fit
    try:
        qc.fit = lambda x, y: fits.append((x, y)) or real(x, y)
        for some in (rows, rows[::-1]):
            qc.fit_on(docs_of(spark, some).repartition(4), labels, max_rows=25)
    finally:
        qc.fit = real
    (x, y), (u, v) = fits
    assert len(x) == 25 and np.array_equal(x, u) and np.array_equal(y, v)
