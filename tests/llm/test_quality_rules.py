import math
import re
from collections import Counter

import pytest
import xxhash

from hubtrace.llm import quality_rules as qr
from llm_docs import docs_of


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def grams(text, buckets):
    def xx(data, seed=42):
        h = xxhash.xxh64_intdigest(data, seed)
        return h - (1 << 64) if h >> 63 else h

    hashes = [xx(w.encode()) for w in words(text)]
    pairs = [
        xx(b.to_bytes(8, "little", signed=True), xx(a.to_bytes(8, "little", signed=True)) % (1 << 64))
        for a, b in zip(hashes, hashes[1:])
    ]
    return [h % buckets for h in hashes + pairs]


def test_against_brute_force(spark, small):
    trusted = {i for i, _ in small if i % 3 == 0}
    docs = docs_of(spark, small)
    marked = spark.createDataFrame([(i,) for i in trusted], "doc_id bigint")
    got = {r["doc_id"]: r for r in qr.quality_rules(docs, marked, buckets=512).collect()}
    raw, target = Counter(), Counter()
    for i, text in small:
        raw.update(grams(text, 512))
        target.update(grams(text, 512) if i in trusted else [])
    part = sum(target.values()) / sum(raw.values())
    ratio = [math.log((target[b] / part + qr.PSEUDO) / (raw[b] + qr.PSEUDO)) for b in range(512)]
    assert len(got) == len(small)
    for i, text in small:
        r, found = got[i], grams(text, 512)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(r[n] for n in names) == base(text)
        score = sum(ratio[b] for b in found) / max(len(found), 1)
        assert r["score"] == pytest.approx(score, abs=1e-5)
        n, *_, repeat = base(text)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        if abs(score - qr.THRESHOLD) > 1e-5:
            assert r["kept"] == (not r["base_failed"] and score >= qr.THRESHOLD)


def test_labelled_documents(spark):
    """Trusted rows are those labelled good: good documents stay, junk goes."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = qr.quality_rules(docs, labels.where("quality = 1")).join(labels, "doc_id").where("not base_failed")
    wrong = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert wrong[(1, True)] > 250 and wrong.get((1, False), 0) == 0
    assert wrong.get((0, True), 0) == 0


def test_many_distinct_ngrams(spark):
    """Four million other n-grams do not hide a text that only untrusted documents hold."""
    word = lambda k: qr.F.hex(qr.F.xxhash64("doc_id", k))
    good = spark.range(10_000).withColumnRenamed("id", "doc_id").select(
        "doc_id", qr.F.array_join(qr.F.transform(qr.F.sequence(qr.F.lit(1), qr.F.lit(200)), word), " ").alias("text")
    )
    junk = " ".join(f"junk{k}" for k in range(60))
    bad = spark.range(10_000, 10_010).select(qr.F.col("id").alias("doc_id"), qr.F.lit(junk).alias("text"))
    out = qr.quality_rules(good.union(bad), good.select("doc_id")).groupBy(
        (qr.F.col("doc_id") >= 10_000).alias("bad"), "kept"
    ).count()
    assert {(r["bad"], r["kept"]): r["count"] for r in out.collect()} == {(False, True): 10_000, (True, False): 10}


def test_every_ngram_has_its_own_ratio(spark):
    docs = docs_of(spark, [(1, "a b a b"), (2, "a c"), (None, "a")])
    out = qr.ngram_ratio(docs, docs.where("doc_id = 1")).collect()
    part = 7 / 11
    counts = [(4, 2), (2, 2), (1, 0), (2, 2), (1, 1), (1, 0)]  # a, b, c, a b, b a, a c
    want = [round(1e6 * math.log((t / part + qr.PSEUDO) / (n + qr.PSEUDO))) for n, t in counts]
    assert sorted(r["ratio"] for r in out) == sorted(want)


def test_ngrams_cross_one_shuffle(spark):
    """Counting and scoring share the rows of n-grams; repeats within and between texts count."""
    texts = [(1, "a a a b a b"), (2, "a c c c c"), (2, "a c c c c"), (3, "b"), (4, None), (None, "c a"), (1, "b b")]
    docs = docs_of(spark, texts)
    out = qr.ngram_scores(docs, docs.where("doc_id = 1"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(gram", plan)) == 1
    raw, target = Counter(), Counter()
    for i, text in texts:
        raw.update(grams(text, 1 << 64))
        target.update(grams(text, 1 << 64) if i == 1 else [])
    part = sum(target.values()) / sum(raw.values())
    ratio = {g: math.log((target[g] / part + qr.PSEUDO) / (raw[g] + qr.PSEUDO)) for g in raw}
    want = {(i, sum(ratio[g] for g in found) / len(found)) for i, text in texts if (found := grams(text, 1 << 64))}
    got = [(r["_id"], r["score"]) for r in out.collect()]
    order = lambda x: (x[0] or 0, x[1])
    assert len(got) == len(want) == 5
    for (i, score), (k, mean) in zip(sorted(got, key=order), sorted(want, key=order)):
        assert i == k and score == pytest.approx(mean, abs=2e-6)


def test_repeated_windows(spark):
    texts = ["a b c a b c", "a a a a", "a b", "", "a b c d", "x y z q x y z q x y z", "é é é\né é"]
    rows = docs_of(spark, list(enumerate(texts)))
    out = qr.quality_rules(rows, rows.where("false")).orderBy("doc_id").collect()
    assert [r["n_repeat_words"] for r in out] == [base(t)[4] for t in texts] == [6, 4, 0, 0, 0, 11, 5]


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """With a hash that clashes, windows are compared as text."""
    texts = ["a b c x y z a b c", "a b c x y z p q r", "k l m k l m"]
    docs = docs_of(spark, list(enumerate(texts)))
    real = qr.F.xxhash64
    monkeypatch.setattr(qr.F, "xxhash64", lambda *c: real(*c).bitwiseAND(qr.F.lit(0)))
    out = docs.select("doc_id", qr._repeat_words(qr.words_of(qr.F.col("text"))).alias("n")).orderBy("doc_id")
    assert [r["n"] for r in out.collect()] == [6, 0, 6]


def test_odd_rows(odd_docs, no_docs):
    out = qr.quality_rules(odd_docs, odd_docs.select("doc_id"))
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["n_words"] == 0:
            assert r["base_failed"] and not r["kept"] and r["score"] == 0
    assert qr.quality_rules(no_docs, no_docs).count() == 0
    assert qr.quality_rules(odd_docs, no_docs).where("score <> 0").count() == 0
