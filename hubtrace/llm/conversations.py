"""Repairing the structure of conversations: the cheapest edits that give `(s?(ua)+)?`.

The edit lattice has a node for each number of rows read and each last role written. Rows are kept,
given another role or deleted, and empty rows inserted; every edge has a cost. Bidirectional
Dijkstra finds the least cost: a heap from the front and one from the back meet, all crossings of that cost
are finished, and the one whose concatenated audit (the edits' initials) is least wins.

Rows are sorted by range of (conversation, turn), so a long conversation runs over several tasks. Tasks read
blocks of rows. A conversation that one task sees whole in one block is repaired there. Other blocks are
searched from each last role to each last role; which ones a conversation uses follows from those few costs,
and then its blocks pass through one hash in order, one at a time.

Cutting into blocks loses nothing. An audit tells the last role written, given the first; so two
ways through a block to different roles have different audits. A block inserts before its rows
only (the last one also at its end), so its audits end in an edit that reads a row, and as all read the same number of
rows, none is the beginning of another: at equal cost the block's own audits decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hubtrace.llm.common import BLANKS, settle

#: A block ends with this many rows, or this many characters.
BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 20
#: Different row patterns whose repair a task remembers.
CACHE = 100_000

#: Last role written: nothing yet, system, user, assistant. What comes next, where a user or assistant may.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
DONE = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
#: Faults in the order in which the first one counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


def _reading() -> list[list[list[tuple[str, int, int]]]]:
    """For each row code and last role, the edits that read the row: (initial, cost, last role then)."""
    edits = []
    for code in range(12):
        initial, fault = divmod(code, 3)  # system, user, assistant, other; sound, truncated, to be deleted
        by_role = []
        for last in range(4):
            out = [("D", 3, last)]
            if fault < 2:
                fits = last == START if initial == 0 else NEXT[last] == (USER, ASSISTANT)[initial - 1] if initial < 3 else False
                if fits:
                    out.append(("K", fault, (SYSTEM, USER, ASSISTANT)[initial]))
                out.append(("R", 2 + fault, NEXT[last]))
            by_role.append(out)
        edits.append(by_role)
    return edits


READING = _reading()


class Lattice:
    """Nodes (rows read, last role written) of a stretch of rows, given as one code a row."""

    def __init__(self, codes: bytes, closing: bool = True):
        self.codes, self.n, self.closing = codes, len(codes), closing

    def after(self, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
        i, last = node
        if i < self.n:
            for edit, cost, role in READING[self.codes[i]][last]:
                yield edit, cost, (i + 1, role)
        if i < self.n or self.closing:
            yield "I", 2, (i, NEXT[last])

    def before(self, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
        i, last = node
        if i > 0:
            for earlier, edits in enumerate(READING[self.codes[i - 1]]):
                for edit, cost, role in edits:
                    if role == last:
                        yield edit, cost, (i - 1, earlier)
        if i < self.n or self.closing:
            for earlier, role in enumerate(NEXT):
                if role == last:
                    yield "I", 2, (i, earlier)

    def search(self, source: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
        """Least cost from `source` before all rows to one of `goals` behind them, and its least audit.

        Ties within a heap go by place: an edge of cost 0 reads a row, so every node's neighbours of equal cost are
        settled before it and its audit is final. The search goes on until no path of the least cost can
        lie outside both settled sets; each such path then has an edge, or its end, from one to the other.
        """
        labels = [{(0, source): (0, "")}, {(self.n, g): (0, "") for g in goals}]
        heaps = [[(0, 0, source)], [(0, 0, g) for g in goals]]
        closed: list[dict] = [{}, {}]
        least = 0 if self.n == 0 and source in goals else None
        while heaps[0] and heaps[1]:
            if least is not None and heaps[0][0][0] + heaps[1][0][0] > least:
                break
            side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
            _, place, last = heappop(heaps[side])
            node = (place, last) if side == 0 else (self.n - place, last)
            if node in closed[side]:
                continue
            spent, audit = closed[side][node] = labels[side][node]
            for edit, cost, other in self.after(node) if side == 0 else self.before(node):
                label = (spent + cost, audit + edit if side == 0 else edit + audit)
                known = labels[side].get(other)
                if known is not None and known <= label:
                    continue
                labels[side][other] = label
                heappush(heaps[side], (label[0], other[0] if side == 0 else self.n - other[0], other[1]))
                met = labels[1 - side].get(other)
                if met is not None and (least is None or label[0] + met[0] < least):
                    least = label[0] + met[0]
        if least is None:
            return None
        front, back = closed
        # A search that ran out of nodes has reached the other's beginnings itself.
        front.setdefault((0, source), (0, ""))
        for g in goals:
            back.setdefault((self.n, g), (0, ""))
        audits = [a + back[node][1] for node, (c, a) in front.items() if node in back and c + back[node][0] == least]
        for node, (spent, audit) in front.items():
            for edit, cost, other in self.after(node):
                if other in back and spent + cost + back[other][0] == least:
                    audits.append(audit + edit + back[other][1])
        return least, min(audits)


class Searcher:
    """Repairs of whole conversations and of blocks by row codes; remembers those of equal codes."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, str]] = {}

    def whole(self, codes: bytes) -> tuple[int, str]:
        found = self.known.get(codes)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[codes] = Lattice(codes).search(START, DONE)
        return found

    @staticmethod
    def block(codes: bytes) -> tuple[list[int], list[str]]:
        """Costs (-1: impossible) and audits for each first and last role, then for each first role to the end."""
        inner, end = Lattice(codes, closing=False), Lattice(codes)
        ways = [inner.search(a, (b,)) for a in range(4) for b in range(4)] + [end.search(a, DONE) for a in range(4)]
        return [-1 if w is None else w[0] for w in ways], ["" if w is None else w[1] for w in ways]


def repaired(last: int, audit: str, roles: list[str], texts: list[str]) -> tuple[int, list[str]]:
    """The last role written, and the lines `role:text` that the edits give after `last`."""
    lines, row = [], 0
    for edit in audit:
        if edit == "I":
            last = NEXT[last]
            lines.append(ROLES[last] + ":")
            continue
        if edit == "K":
            last = SYSTEM if roles[row][:1] == "s" else NEXT[last]
            lines.append(f"{roles[row]}:{texts[row]}")
        elif edit == "R":
            last = NEXT[last]
            lines.append(f"{ROLES[last]}:{texts[row]}")
        row += 1
    return last, lines


class Block:
    """Rows of a conversation that follow each other, and what a digest needs to know about them."""

    def __init__(self):
        self.turns, self.roles, self.texts, self.faults = [], [], [], []
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.chars += len(text)

    def codes(self) -> bytes:
        kind = {"s": 0, "u": 1, "a": 2}
        grade = (0, 2, 2, 1)
        return bytes(kind.get(r[:1], 3) * 3 + grade[f] for r, f in zip(self.roles, self.faults))

    def counts(self) -> dict:
        known = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        return {
            "n": len(self.roles), "low": min(known, default=None), "high": max(known, default=None),
            "n_turns": len(set(known)), "blank": self.faults.count(BLANK),
            "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(TRUNCATED),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
        }


class Tally:
    """A conversation's digest from its blocks, in order; holds no text."""

    def __init__(self):
        self.low = self.high = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audits: list[str] = []
        self.role, self.hash, self.any_line = START, hashlib.sha256(), False

    def add(self, counts: dict, cost: int, audit: str, roles: list[str], texts: list[str]) -> None:
        if counts["low"] is not None:
            # Turns ascend, so only the turn on the border can be counted twice.
            self.turns += counts["n_turns"] - (self.high == counts["low"])
            self.low = counts["low"] if self.low is None else self.low
            self.high = counts["high"]
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + counts[name])
        if counts["n"]:
            if self.initial is not None and self.initial + counts["first"] not in LEGAL:
                self.illegal += 1
            self.initial = counts["last"]
        self.cost += cost
        self.audits.append(audit)
        self.role, lines = repaired(self.role, audit, roles, texts)
        if lines:
            self.hash.update((("\n" if self.any_line else "") + "\n".join(lines)).encode("utf-8"))
            self.any_line = True

    def digest(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {
            "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audits),
            "repaired_sha256": self.hash.hexdigest(),
        }


_COUNTS = {
    "n": T.LongType(), "low": T.LongType(), "high": T.LongType(), "n_turns": T.LongType(), "blank": T.LongType(),
    "duplicate": T.LongType(), "truncated": T.LongType(), "illegal": T.LongType(), "first": T.StringType(),
    "last": T.StringType(),
}
_DIGEST = {
    **dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], T.LongType()),
    "audit": T.StringType(), "repaired_sha256": T.StringType(),
}
_BLOCK = {
    "costs": T.ArrayType(T.LongType()), "audits": T.ArrayType(T.StringType()),
    "roles": T.ArrayType(T.StringType()), "texts": T.ArrayType(T.StringType()),
}


def _struct(fields: dict) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _batches(rows: Iterator[dict], schema: pa.Schema, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most 1000 rows, or about `chars` characters of texts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, (row.get("block") or {}).get("texts") or ()))
        if len(held) == 1000 or size > chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def damage(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Rows (conv, turn, role, text, dropped), damaged by the checksum of `conv:turn` modulo 20.

    0 drops a row (it stays, marked, so that its conversation is known), 1 empties its text, 2 takes out . ! and ?,
    3 repeats it, 4 makes it the user's. Null roles and texts are one space, as are null ids in the checksum.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col))) % 20
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        text_of(role_col).alias("role"), text_of(text_col).alias("text"), kind.alias("kind"),
    )
    rows = rows.withColumns({
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
    })
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.withColumn("copy", F.explode(copies))
    return rows.select("conv", "turn", "role", "text", (F.col("kind") == 0).alias("dropped"))


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per conversation of rows (conv, turn, role, text, dropped).

    Returns conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows stand by turn, null
    turns first, then by role and text. A conversation is known by any of its rows; those marked dropped count for
    nothing else. Without other rows it has zeros, an empty audit and the digest of an empty text. Null is a
    conversation like others; null roles and texts are one space. Equal rows are duplicates. A role's
    initial is its first character, whatever the role. Other columns are not used; an empty table gives no rows.
    """
    spark_id = rows.schema["conv"].dataType
    clean = rows.select(
        "conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce("dropped", F.lit(False)).alias("dropped"),
    )
    # Equal rows of a conversation meet here, and nothing else: a long one is spread by its texts.
    same = Window.partitionBy("conv", "role", "text", "dropped").orderBy(F.asc_nulls_first("turn"))
    ended = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(F.length(ended) == 0, BLANK).when(F.col("nth") > 1, DUPLICATE)
        .when(~F.substring(ended, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    )
    judged = clean.withColumn("nth", F.row_number().over(same)).withColumn("fault", fault)
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "nth"]
    sorted_rows = judged.repartitionByRange(*order).sortWithinPartitions(*order)

    fields = {
        "conv": spark_id, "part": T.IntegerType(), "seq": T.LongType(), "digest": _struct(_DIGEST),
        "counts": _struct(_COUNTS), "block": _struct(_BLOCK),
    }
    schema = _struct(fields)
    arrow = to_arrow_schema(schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, part = Searcher(), TaskContext.get().partitionId()

        def entry(conv, seq: int, block: Block, alone: bool) -> dict:
            out = {"conv": conv, "part": part, "seq": seq}
            if alone:
                tally = Tally()
                tally.add(block.counts(), *searcher.whole(block.codes()), block.roles, block.texts)
                return out | {"digest": tally.digest()}
            costs, audits = searcher.block(block.codes())
            return out | {
                "counts": block.counts(),
                "block": {"costs": costs, "audits": audits, "roles": block.roles, "texts": block.texts},
            }

        def run() -> Iterator[dict]:
            conv, block, seq = None, None, 0
            first, cut = True, False  # the task's first conversation may have begun before; cut: it has a block already
            for own, turn, role, text, dropped, fault in _rows(batches):
                if block is not None and own != conv:
                    yield entry(conv, seq, block, not (first or cut))
                    seq, first, cut, block = seq + 1, False, False, None
                if block is not None and (len(block.roles) >= block_rows or block.chars >= block_chars):
                    yield entry(conv, seq, block, False)
                    seq, cut, block = seq + 1, True, None
                if block is None:
                    conv, block = own, Block()
                if not dropped:
                    block.add(turn, role, text, fault)
            if block is not None:
                yield entry(conv, seq, block, False)

        yield from _batches(run(), arrow)

    read = settle(sorted_rows.select("conv", "turn", "role", "text", "dropped", "fault").mapInArrow(blocks, schema))
    alone = read.where("digest IS NOT NULL").select("conv", "digest.*")
    return alone.unionByName(_joined(read.where("digest IS NULL"), spark_id))


def _joined(blocks: DataFrame, id_type: T.DataType) -> DataFrame:
    """Digests of conversations that lie in several blocks, or at the border of a task."""
    narrow = blocks.select("conv", "part", "seq", "block.costs", "block.audits")
    # For each first role, the last roles in order of their audits.
    ranked = narrow.select("conv", "part", "seq", "costs", F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda a: F.transform(
            F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.struct(
                F.get("audits", a * 4 + b).alias("audit"), b.alias("role")
            ))), lambda x: x["role"],
        ),
    ).alias("roles"))
    chosen = _struct({"part": T.IntegerType(), "seq": T.LongType(), "way": T.IntegerType()})
    chosen_arrow = to_arrow_schema(chosen)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the last block to the first: the least cost to the end for each role before it."""

        def walk(places: list[tuple], turns: list[tuple]) -> Iterator[dict]:
            role = START
            for (part, seq), after in zip(reversed(places), reversed(turns)):
                way = after[role]
                yield {"part": part, "seq": seq, "way": way}
                role = way % 4

        def run() -> Iterator[dict]:
            conv, places, turns, rest = None, [], [], []
            for own, part, seq, costs, roles in _rows(batches):
                if places and own != conv:
                    yield from walk(places, turns)
                    places, turns = [], []
                if not places:
                    conv, turn, rest = own, tuple(range(16, 20)), costs[16:]
                else:
                    turn, cost = [], []
                    for a in range(4):
                        ways = [(costs[a * 4 + b] + rest[b], k, b) for k, b in enumerate(roles[a]) if costs[a * 4 + b] >= 0]
                        total, _, b = min(ways)
                        turn.append(a * 4 + b)
                        cost.append(total)
                    rest = cost
                places.append((part, seq))
                turns.append(tuple(turn))
            if places:
                yield from walk(places, turns)

        yield from _batches(run(), chosen_arrow)

    backward = ["conv", F.desc("part"), F.desc("seq")]
    ways = ranked.repartition("conv").sortWithinPartitions(*backward).mapInArrow(choose, chosen)
    schema = _struct({"conv": id_type, **_DIGEST})
    arrow = to_arrow_schema(schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[dict]:
            conv, tally = None, None
            for own, counts, roles, texts, cost, audit in _rows(batches):
                if tally is not None and own != conv:
                    yield {"conv": conv, **tally.digest()}
                    tally = None
                if tally is None:
                    conv, tally = own, Tally()
                tally.add(counts, cost, audit, roles, texts)
            if tally is not None:
                yield {"conv": conv, **tally.digest()}

        yield from _batches(run(), arrow)

    met = blocks.join(ways, ["part", "seq"]).repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return met.select(
        "conv", "counts", "block.roles", "block.texts", F.get("block.costs", F.col("way")).alias("cost"),
        F.get("block.audits", F.col("way")).alias("audit"),
    ).mapInArrow(finish, schema)
