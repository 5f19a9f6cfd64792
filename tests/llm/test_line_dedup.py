import random

from hubtrace.llm import line_dedup as ld
from llm_docs import docs_of


def runs(lines, least):
    """All stretches of lines (as tuples) that hold `least` words and no fewer lines than needed."""
    out = {}
    for i in range(len(lines)):
        n = 0
        for j in range(i, len(lines)):
            n += len(lines[j].split())
            if n >= least:
                out.setdefault(tuple(lines[i : j + 1]), []).append((i, j + 1))
                break
    return out


def common(lines, other, least):
    """Places of `lines` in stretches of at least `least` words that `other` holds too."""
    found = set()
    places = {}
    for j, x in enumerate(other):
        places.setdefault(x, []).append(j)
    for i, x in enumerate(lines):
        for j in places.get(x, []):
            if i and j and lines[i - 1] == other[j - 1]:
                continue
            n = 0
            while i + n < len(lines) and j + n < len(other) and lines[i + n] == other[j + n]:
                n += 1
            if sum(len(y.split()) for y in lines[i : i + n]) >= least:
                found |= set(range(i, i + n))
    return found


def check(docs, got, least):
    """Sound: each deleted line lies in a passage of an earlier document. Whole: no such passage is left."""
    earlier, before = set(), []
    for i, text in docs:
        lines = text.split("\n")
        gone = set(got.get(i, []))
        own = runs(lines, least)
        covered = set().union(*[common(lines, other, least) for other in before]) if gone else set()
        assert gone <= covered, (i, gone, covered)
        for r, places in own.items():
            if r in earlier:
                assert all(gone & set(range(a, b)) for a, b in places), (i, r)
        earlier |= set(own)
        before.append(lines)


def test_random_passages(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(25)]
    docs = []
    for i in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 14))]
        if docs and rng.random() < 0.6:
            other = rng.choice(docs)[1].split("\n")
            a = rng.randrange(len(other))
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = other[a : a + rng.randint(1, 6)]
        docs.append((i, "\n".join(lines)))
    found = ld.repeated_lines(docs_of(spark, docs), min_words=6, salts=3)
    got = {r["doc_id"]: r["lines"] for r in found.collect()}
    assert len(got) > 40
    check(docs, got, 6)


def test_whole_test_set(spark, small):
    got = {r["doc_id"]: r["lines"] for r in ld.repeated_lines(docs_of(spark, small)).collect()}
    plain = [(i, "\n".join(x.strip() for x in t.split("\n"))) for i, t in small]
    assert got
    check([(i, t) for i, t in plain if all(t.split("\n"))], {i: v for i, v in got.items()}, 50)


def test_alignment():
    pairs = ld.patience_pairs([1, 2, 3, 9, 4, 5], [7, 1, 2, 3, 4, 5])
    assert pairs == [(0, 1), (1, 2), (2, 3), (4, 4), (5, 5)]
    assert ld.patience_pairs([1, 1, 2, 1], [1, 2, 1, 1]) in ([(0, 0), (2, 1), (3, 3)], [(0, 0), (2, 1), (3, 2)])
    assert ld.patience_pairs([], [1]) == [] and ld.patience_pairs([1, 2], [3, 4]) == []


def test_moved_passages_go_too(spark):
    a, b = " ".join(["alpha"] * 30), " ".join(["beta"] * 30)
    docs = [(1, f"{a}\n{a} x\nmiddle\n{b}\n{b} y"), (2, f"{b}\n{b} y\nown line\n{a}\n{a} x")]
    [row] = ld.repeated_lines(docs_of(spark, docs)).collect()
    assert (row["doc_id"], row["lines"]) == (2, [0, 1, 3, 4])


def test_copies_short_lines_and_rows(spark):
    long = " ".join(f"w{k}" for k in range(60))
    docs = [(5, f"The same.\n{long}"), (2, f"  {long}\t\nThe same."), (9, "The same.\nmore"), (7, f"The same.\n{long}"), (7, f"The same.\n{long}")]
    out = {(r["doc_id"], r["text"]): r for r in ld.line_dedup(docs_of(spark, docs)).collect()}
    assert out[(2, docs[1][1])]["deleted_lines"] == []
    assert out[(5, "The same.")]["deleted_lines"] == [1]
    assert out[(9, "The same.\nmore")]["deleted_lines"] == []
    assert [k for k in out if k[0] == 7] == [(7, "")] or out[(7, "The same.")]["deleted_lines"] == [1]


def test_odd_rows(odd_docs, no_docs):
    out = ld.line_dedup(odd_docs)
    assert out.columns == [c for c in odd_docs.columns if c not in ("deleted_lines", "emptied")] + ["deleted_lines", "emptied"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    same = sorted((str(r["doc_id"]), str(r["text"])) for r in odd_docs.collect())
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in rows) == same
    assert ld.line_dedup(no_docs).count() == 0
