import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from hubtrace.llm import queries
from hubtrace.llm.conversations import DONE, START, Lattice, damage, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, lines) by trying scripts in order of cost; rows are (role, text, fault)."""
    heap = [(0, "", 0, "", ())]
    best = None
    while heap:
        cost, audit, i, out, lines = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if not re.fullmatch(r"s?(ua)*u?", out):
            continue
        if i == len(rows) and GRAMMAR.fullmatch(out):
            best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
            continue
        if out.count("I") > 2 * len(rows) + 2:
            continue
        for role in ("user", "assistant"):
            if audit[-3:] != "III":
                heapq.heappush(heap, (cost + 2, audit + "I", i, out + role[0], lines + (role + ":",)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out, lines))
            if fault in ("", "truncated"):
                more = fault == "truncated"
                if role[:1] and role[0] in "sua":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + role[0], lines + (f"{role}:{text}",)))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, out + new[0], lines + (f"{new}:{text}",)))
    return best


def brute(table, damaged=True):
    """What the contract says, conversation by conversation; table holds (conv, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        own = groups[conv]
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20 if damaged else 19
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, rows, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text in own:
            found = WORD.findall(text)
            fault = "blank" if not found else "duplicate" if (role, text) in seen else "" if found[-1] in ".!?" else "truncated"
            seen.add((role, text))
            count[fault] += 1
            rows.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for r, _, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest(rows)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def random_table(rng, convs, longest):
    rows = []
    for conv in [*range(convs), None]:
        for _ in range(rng.randrange(1, longest)):
            turn = rng.choice([None, rng.randrange(12), rng.randrange(12), rng.randrange(400)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Agent", "ultra"])
            text = rng.choice(["Fine.", "so?", "cut", "", " \n", None, "Well!\t", "longer text here.", "é😀", "é😀!"])
            rows.append((conv, turn, role, text))
    return rows


def frame(spark, rows, extra=()):
    names = "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "conv_id long, turn long, role string, text string" + names)


def plain(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("block_rows", [512, 3, 1])
def test_against_trying_all_scripts(spark, block_rows):
    """Also where every conversation is cut into blocks of one row or three."""
    rng = random.Random(block_rows)
    rows = random_table(rng, 60, 8)
    assert plain(repair(damage(frame(spark, rows)), block_rows=block_rows)) == brute(rows)


def test_blocks_by_characters(spark):
    rows = random_table(random.Random(5), 20, 8)
    assert plain(repair(damage(frame(spark, rows)), block_chars=1)) == brute(rows)


def test_defined_cases(spark):
    assert plain(repair(damage(frame(spark, [])))) == []
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert plain(repair(damage(frame(spark, [(lost, 0, "user", "Gone.")])))) == [(lost, 0, 0, 0, 0, 0, 0, "", empty)]
    clash = ["conv", "kind", "copy", "dropped", "nth", "fault", "part", "seq", "digest", "counts", "block", "way"]
    rows = [(1, 3, "user", "A."), (1, 3, "user", "A."), (1, 3, "user", "A."), (1, 9, "assistant", "B " * 200_000 + ".")]
    rows += [(None, None, None, None), (2, None, "user", "Ask?"), (2, None, "assistant", "Yes.")]
    assert plain(repair(damage(frame(spark, rows, clash)))) == brute(rows)


def test_long_conversation(spark):
    """A third of all rows in one conversation: blocks give what one search over all rows gives."""
    rng = random.Random(3)
    rows = [(7, k // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "", f"Row {k}."])) for k in range(900)]
    rows += [(100 + k // 3, k, "user", "Ask?") for k in range(1800)]
    docs = frame(spark, rows)
    cut = {r["conv"]: r for r in repair(damage(docs), block_rows=64).collect()}
    whole = {r["conv"]: r for r in repair(damage(docs), block_rows=100_000).collect()}
    assert cut == whole and len(cut) == 601


def test_search_from_both_ends():
    """Against a search from the front alone, on random row codes and between any two roles."""
    rng = random.Random(4)

    def one_sided(lattice, source, goals):
        heap, best = [(0, "", (0, source))], {}
        while heap:
            cost, audit, node = heapq.heappop(heap)
            if node in best:
                continue
            best[node] = (cost, audit)
            for edit, more, other in lattice.after(node):
                heapq.heappush(heap, (cost + more, audit + edit, other))
        ends = [best[(lattice.n, g)] for g in goals if (lattice.n, g) in best]
        return min(ends) if ends else None

    for _ in range(400):
        lattice = Lattice(bytes(rng.randrange(12) for _ in range(rng.randrange(12))), rng.random() < 0.5)
        for source in range(4):
            for goals in (DONE, (0,), (1,), (2,), (3,)):
                assert lattice.search(source, goals) == one_sided(lattice, source, goals)
    assert Lattice(b"").search(START, DONE) == (0, "")


def test_query_on_the_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_conversations(spark, "/root/testdata/sf0.01")
    assert found.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    ]
    assert plain(found) == brute(rows)
