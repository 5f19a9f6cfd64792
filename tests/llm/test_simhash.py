import random
import re

import pytest
import xxhash

from hubtrace.llm import simhash as sh
from llm_docs import docs_of


def brute(text, shingle=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in parts]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in hashes) > len(hashes))


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_masks_cover_every_pair_of_positions():
    for radius in (1, 2, 3):
        masks = sh.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(radius)
        for _ in range(300):
            flipped = sum(1 << i for i in rng.sample(range(64), radius))
            assert any(m & flipped == 0 for m in masks)


def test_documents_against_brute_force(spark, small):
    fp = {i: brute(t) for i, t in small}
    want = classes(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    rows = sh.near_duplicates(docs_of(spark, small)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {
        i: (f"{fp[i]:016x}", want[i]) for i in fp
    }


def test_links_of_close_values(spark):
    """Chains, a dense crowd, and pairs at 3 bits that do not link."""
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(8):
            x ^= sum(1 << i for i in rng.sample(range(64), rng.choice([1, 2, 3])))
            values.add(x)
    crowd = rng.getrandbits(64)
    values |= {crowd ^ (1 << i) for i in range(40)}
    signed = {sh._signed(v): v for v in values}
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    got = {r["node"]: r["root"] for r in sh.components(sh.link_edges(frame)).collect()}
    want = classes(list(signed), lambda a, b: (signed[a] ^ signed[b]).bit_count() <= 2)
    assert {v: got.get(v, v) for v in signed} == want
    with pytest.raises(ValueError):
        sh.link_edges(frame, 3)


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    nodes = sorted({n for e in edges for n in e})
    pairs = set(edges)
    got = sh.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == classes(nodes, lambda a, b: (a, b) in pairs)
    assert len(got) == len(nodes)


def test_one_row_of_each_component(spark, small):
    docs = docs_of(spark, small, ["lang", "fp"])
    roots = {r["component_id"] for r in sh.near_duplicates(docs).collect()}
    kept = sh.representatives(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(roots)


def test_odd_rows(odd_docs, no_docs):
    rows = sh.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {None, 2, 3, 4} and {r["component_id"] for r in zero} == {2}
    assert {r["component_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}
    assert sh.near_duplicates(no_docs).count() == 0 and sh.representatives(no_docs).count() == 0
    assert sh.representatives(odd_docs).where("doc_id in (3, 4, 8)").count() == 0
