import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from hubtrace.llm import pii
from llm_docs import ODD, docs_of

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            twice = [int(c) * (1 + k % 2) for k, c in enumerate(digits[::-1])]
            return 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in twice) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if ok(k, m[0])] for k, p in PATTERNS.items()}


def test_base_spans_are_those_of_the_patterns(small):
    rng = random.Random(4)
    texts = [t for _, t in small] + ["4111111111111111 4111-1111-1111-1111 a@b@c.de x@y.z.", "300.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.4"]
    texts += ["".join(rng.choice("12345.+-() @ab@.\n") for _ in range(80)) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_take_linear_time():
    pii.base_spans("a" * 300_000 + " " + "a1" * 100_000 + "@" * 1000)


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit_on(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_messages_give_exact_chances_on_trees(field):
    text = "x 12.34.56.78 y +1 (437) 555-0689 z (437) 555-0690 12 w"
    g = pii.Graph.of([text])
    g.links = []
    n = len(g.doc)
    own = g.matrix() @ field.unary
    before = g.before
    got = field.chances(g, rounds=60)
    want = np.zeros((n, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=n):
        if not all(g.allowed[k] >> y & 1 for k, y in enumerate(labels)):
            continue
        s = 0.0
        for k, y in enumerate(labels):
            s += own[k, y]
            s += field.chain[labels[before[k]] if before[k] >= 0 else 0, y]
            if k not in before:
                s += field.chain[y, 0]
        for k, y in enumerate(labels):
            want[k, y] += np.exp(s)
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(got, want, atol=1e-4)


def test_links_carry_a_label_to_a_distant_repeat(field):
    """Without its plus, a number is no base span; an equal one far away speaks for it."""
    text = "call +1 (437) 555-0689 now\n" + "plain words here " * 40 + "\nor (437) 555-0689 later"
    base = pii.base_spans(text)
    [added] = pii.added_spans([text], [base], field)
    assert [text[a:b] for a, b in added["phone"]] == ["(437) 555-0689"]
    g = pii.Graph.of([text])
    alone = pii.Graph.of([text])
    alone.links = []
    assert field.chances(g)[-1, 4] > field.chances(alone)[-1, 4]
    masked = pii.masked(text, {k: base[k] + added[k] for k in pii.KINDS})
    assert "555" not in masked and masked.count("<PHONE>") == 2


def added(text, field):
    [found] = pii.added_spans([text], [pii.base_spans(text)], field)
    return {k: [text[a:b] for a, b in v] for k, v in found.items() if v}


def test_numbers_beside_other_numbers(field):
    """The pattern takes the whole run of digits and drops it; its parts are judged one by one."""
    card, other = "4111 1111 1111 1111", "5500005555555559"
    assert added(f"paid by {card} 2024 in full", field) == {"card": [card]}
    assert added(f"cards {other} 4111111111111111 on file", field) == {"card": [other, "4111111111111111"]}
    assert added(f"call +1 (437) 555-0689 {card} now", field) == {"phone": ["+1 (437) 555-0689"], "card": [card]}
    assert added("sum 1234 5678 9012 3456 7890 1234 of 1000 2000 3000 4000 5000", field) == {}


def test_form_alone_rules_no_number_out():
    """Without a plus or a valid card number a number may still be labelled; a repeat in a longer run too."""
    g = pii.Graph.of(["a (437) 555-0689 b (437) 555-0689 c 123456789 (437) 555-0689 99 88 77 66"])
    words = [(a >> 4 & 1) for a, (s, e) in zip(g.allowed, g.span) if e - s in (5, 8)]
    assert pii._fits([0] * 50_000, 7, 15) == [False] * 50_000 and pii._parts(["@"] * 50_000)
    assert words == [1] * 6 and not any(f >> pii.SHOWN for f in g.features)


def test_clean_documents_get_no_spans(field):
    texts = ["The year 2019 was 12 months long.", "version 3.2 of 1,000 things", "x = 17; y[3] = 4", "a @ b", "pages 10-20, 1999-2004"]
    assert all(not any(s.values()) for s in pii.added_spans(texts, [pii.base_spans(t) for t in texts], field))


def test_rows(spark, field, small):
    rows = {r["doc_id"]: r for r in pii.personal_data(docs_of(spark, small), field).collect()}
    for i, text in small:
        base = plain(text)
        listed = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        r = rows[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_odd_rows(spark, odd_docs, no_docs):
    field = pii.fit_on(odd_docs)
    rows = pii.personal_data(odd_docs, field).collect()
    assert len(rows) == len(ODD)
    nine = next(r for r in rows if r["doc_id"] == 9)
    assert nine["masked"].startswith("<EMAIL> ") and "<IP>" in nine["masked"]
    text = "a@b.co or +1 (437) 555-0689 at 10.0.0.1, card 4111 1111 1111 1111."
    [own] = pii.personal_data(docs_of(spark, [(1, text)]), field).collect()
    assert own["masked"] == "<EMAIL> or <PHONE> at <IP>, card <CARD>."
    masked = pii.mask_documents(odd_docs, field)
    assert masked.schema == odd_docs.schema and masked.where("text is null").count() == 2
    assert pii.personal_data(no_docs, pii.fit_on(no_docs)).count() == 0
