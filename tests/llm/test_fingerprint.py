import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from hubtrace.llm import fingerprint as fg
from llm_docs import docs_of


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def exact(text):
    lanes = [0] * fg.EXACT
    for line in text.split("\n"):
        p = line.strip(" \t\n\x0b\x0c\r")
        if p:
            for seed in range(fg.EXACT // 2):
                h = xx(p.encode(), xx(seed.to_bytes(4, "little")))
                lanes[2 * seed] += h & 0xFFFFFFFF
                lanes[2 * seed + 1] += h >> 32
    return "".join(f"{x % 2**32:08x}" for x in lanes)


def lanes(text):
    total = [0] * fg.LIKENESS
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        for i in range(max(1, len(words) - 2) if words else 0):
            h = 42
            for w in words[i : i + 3]:
                h = xx(w.encode(), h)
            for seed in range(fg.LIKENESS // 64):
                x = h if seed == 0 else xx(seed.to_bytes(4, "little"), xx(h.to_bytes(8, "little")))
                for k in range(32):
                    total[64 * seed + 2 * k] += 2 * (x >> k & 1) - 1
                    total[64 * seed + 2 * k + 1] += 2 * (x >> (32 + k) & 1) - 1
    return [x % 2**16 for x in total]


def printed(text):
    return exact(text) + "".join(f"{x:04x}" for x in lanes(text))


def near(a, b):
    if printed(a) == printed(b):
        return 1.0
    signed = lambda v: [x - 2**16 if x >= 2**15 else x for x in v]
    apart = sum(x * x for x in signed([(x - y) % 2**16 for x, y in zip(lanes(a), lanes(b))]))
    total = sum(x * x for x in signed(lanes(a)) + signed(lanes(b)))
    return max(0.0, 1 - apart / total) if total else 0.0


def test_against_brute_force(spark, small):
    docs = [(i, t) for i, t in small if len(t) < 3000][:60]
    got = {r["doc_id"]: r for r in fg.edited_fingerprints(docs_of(spark, docs)).collect()}
    down = sorted(docs, reverse=True)
    assert len(got) == len(docs)
    for (i, text), (_, after) in zip(down, down[1:] + down[:1]):
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        r = got[i]
        assert r["n_chars"] == n
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == printed(text) and r["edited_fingerprint"] == printed(edited)
        assert r["near_edited"] == pytest.approx(near(text, edited), abs=2e-6)
        assert r["near_next"] == pytest.approx(near(text, after), abs=2e-6)


def prints(spark, texts):
    frame = docs_of(spark, list(enumerate(texts)))
    rows = fg.fingerprints(frame, ["doc_id"], "text").withColumn("fp", fg.printed(F.col("exact"), F.col("lanes")))
    return rows.orderBy("doc_id").collect()


def test_order_and_equality(spark):
    rows = prints(spark, ["one two three four\nx y\nlast line here", "last line here\none two three four\n\n  x y ", "x y\nx y", "x y", ""])
    fp = [r["fp"] for r in rows]
    assert fp[0] == fp[1] and len(set(fp)) == 4
    assert set(fp[4]) == {"0"}


def test_inserting_and_deleting_paragraphs(spark):
    whole, part, rest = prints(spark, ["a b c d\ne f\ng h i", "a b c d\ng h i", "e f"])
    frame = spark.createDataFrame([(whole["lanes"], part["lanes"], rest["lanes"])], "w array<smallint>, p array<smallint>, r array<smallint>")
    row = frame.select(fg.combined(F.col("p"), F.col("r")).alias("more"), fg.combined(F.col("w"), F.col("r"), -1).alias("less")).first()
    assert row["more"] == whole["lanes"] and row["less"] == part["lanes"]
    for k in range(fg.EXACT):
        lane = [int(r["exact"][8 * k : 8 * k + 8], 16) for r in (whole, part, rest)]
        assert lane[0] == (lane[1] + lane[2]) % 2**32


def test_whole_fingerprints_after_inserting_and_deleting(spark):
    """Exact lanes too, across carries of 2^32: many paragraphs, one of them repeated."""
    many = [f"line {i} of many" for i in range(300)] + ["line 7 of many"] * 3
    some = many[::3] + ["line 7 of many"]
    texts = ["\n".join(many), "\n".join(some), "\n".join(many + some), ""]
    a, b, both, none = prints(spark, texts)
    frame = fg.fingerprints(docs_of(spark, list(enumerate(texts))), ["doc_id"], "text")
    one = lambda i: F.max(F.when(F.col("doc_id") == i, F.struct("exact", "lanes")))
    wide = frame.agg(*[one(i).alias(n) for i, n in enumerate(("a", "b", "both", "none"))])
    row = wide.select(
        fg.inserted(F.col("a"), F.col("b")).alias("more"), fg.deleted(F.col("both"), F.col("b")).alias("less"),
        fg.inserted(F.col("a"), F.col("none")).alias("same"), fg.deleted(F.col("a"), F.col("a")).alias("gone"),
    ).first()
    for got, want in (("more", both), ("less", a), ("same", a), ("gone", none)):
        assert row[got]["exact"].lower() == want["exact"].lower() and row[got]["lanes"] == want["lanes"], got


def test_lanes_do_not_hang_together(spark):
    """Each pair of exact lanes is a hash of the paragraph itself, not a function of the first pair."""
    row = prints(spark, ["one paragraph"])[0]
    first = xx(b"one paragraph")
    old = [xx(seed.to_bytes(4, "little"), first) for seed in range(fg.EXACT // 2)]
    new = [int(row["exact"][16 * s + 8 : 16 * s + 16] + row["exact"][16 * s : 16 * s + 8], 16) for s in range(fg.EXACT // 2)]
    assert not set(old) & set(new) and new == [xx(b"one paragraph", xx(s.to_bytes(4, "little"))) for s in range(fg.EXACT // 2)]


def test_error_of_the_likeness(spark):
    """Against the true share 1 - |a - b|^2 / (|a|^2 + |b|^2) of the counts of runs."""
    import random

    r = random.Random(5)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    for share in (0.0, 0.2, 0.4, 0.6, 0.8, 0.95):
        for _ in range(6):
            base = [" ".join(word() for _ in range(12)) for _ in range(30)]
            keep = round(30 * share)
            texts += ["\n".join(base), "\n".join(base[:keep] + [" ".join(word() for _ in range(12)) for _ in range(30 - keep)])]

    def runs(text):
        count = {}
        for line in text.split("\n"):
            w = line.split()
            for i in range(len(w) - 2):
                count[tuple(w[i : i + 3])] = count.get(tuple(w[i : i + 3]), 0) + 1
        return count

    frame = fg.fingerprints(docs_of(spark, list(enumerate(texts))), ["doc_id"], "text")
    pair = F.floor(F.col("doc_id") / 2).alias("pair")
    half = lambda k: F.max(F.when(F.col("doc_id") % 2 == k, F.struct("exact", "lanes")))
    wide = frame.groupBy(pair).agg(half(0).alias("a"), half(1).alias("b"))
    got = wide.select("pair", fg.likeness(F.col("a.exact"), F.col("a.lanes"), F.col("b.exact"), F.col("b.lanes")).alias("near"))
    errors = []
    for x in got.collect():
        a, b = runs(texts[2 * x["pair"]]), runs(texts[2 * x["pair"] + 1])
        apart = sum((a.get(k, 0) - b.get(k, 0)) ** 2 for k in a.keys() | b.keys())
        errors.append(abs(x["near"] - max(0.0, 1 - apart / sum(v * v for c in (a, b) for v in c.values()))))
    assert len(errors) == 36 and sum(errors) / len(errors) < 0.07 and max(errors) < 0.4


def test_likeness_of_texts_with_a_run_beyond_16_bits(spark):
    """Lanes of +-n: the likeness is that of the counts of the one run, not of their remainders."""
    texts = ["a " * 42_000, "a " * 36_000, "x y z"]
    rows = fg.edited_fingerprints(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    alike = lambda a, b: 1 - (a - b) ** 2 / (a * a + b * b)
    assert rows[0]["near_edited"] == pytest.approx(alike(41_998, 27_998), abs=1e-3)
    assert rows[1]["near_next"] == pytest.approx(alike(35_998, 41_998), abs=1e-6)
    assert rows[0]["fingerprint"] == printed(texts[0])


def test_next_keys_wrap_around(spark):
    keys = spark.createDataFrame([(k,) for k in (5, 1, 9, 3, 3, -4)], "key bigint").repartition(4)
    assert {r["key"]: r["next_key"] for r in fg.next_keys(keys).collect()} == {9: 5, 5: 3, 3: 1, 1: -4, -4: 9}


def test_odd_rows(odd_docs, no_docs, spark):
    rows = fg.edited_fingerprints(odd_docs).collect()
    distinct = {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    assert len(rows) == len(distinct)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[7]["fingerprint"] == by_id[8]["fingerprint"] and by_id[8]["near_next"] == 1
    assert by_id[2]["fingerprint"] == by_id[3]["fingerprint"] == "0" * (8 * fg.EXACT + 4 * fg.LIKENESS)
    assert fg.edited_fingerprints(no_docs).count() == 0
    lone = fg.edited_fingerprints(docs_of(spark, [(1, "only one")])).first()
    assert lone["near_next"] == 1
