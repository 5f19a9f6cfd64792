"""Personal data through patterns and a skip-chain conditional random field.

Patterns give the base spans of four kinds. A conditional random field over the words
that hold a digit or an @ adds what the patterns miss: neighbouring words are linked as a
chain, and words that repeat or resemble each other anywhere in a document (the same letters
and digits, or the same digits) are linked across it, so that they tend to get the same label.
Loopy message passing gives each word's chances; runs of words that are likely of one kind
become spans unless they touch a base span. A run of words that holds more than one number is cut
into candidates first, so that a number beside another is seen as it would be alone.

The weights are fitted by pseudo-likelihood on words of the corpus itself, with the base
spans as labels, from a bounded sample (`sample_docs`, `sample_words`).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubtrace.llm.common import map_texts, replace_texts

#: Fixed value: the kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

SAMPLE_DOCS, SAMPLE_WORDS = 20_000, 50_000
#: Chance from which a word is taken to be of a kind; rounds of message passing.
CERTAIN, ROUNDS = 0.95, 12

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9.]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARK = re.compile(r"[0-9@]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """As the pattern would find them, but from each @ outwards, so long runs cost no more than their length."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        rest = DOMAIN.match(text, at + 1) if start < at else None
        if rest:
            found.append((start, rest.end()))
            free = rest.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind: leftmost, not overlapping within a kind, failing ones dropped."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not MARK.search(text):
        return found
    found["email"] = _emails(text)
    for run in NUMBERS.finditer(text):
        if run[0].count(".") >= 3:
            for m in IP.finditer(text, *run.span()):
                if all(len(q := p.lstrip("0") or "0") <= 3 and int(q) <= 255 for p in m[0].split(".")):
                    found["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


FEATURES = (
    "any", "at", "at_dot", "plus_first", "bracket", "hyphen", "three_dots", "dots", "letters", "quote",
    "digits_1_3", "digits_4_6", "digits_7_12", "digits_13_19", "digits_20", "luhn", "bytes",
    "run_digits_7_15", "run_digits_13_19", "run_plus", "first_of_run", "last_of_run", "single",
    "shown_luhn", "shown_plus",
)
#: The two last features: what a word's part of a run shows, or that of a word like it.
SHOWN = len(FEATURES) - 2
#: How a card number is written in words of its own: one number, or groups.
GROUPS = re.compile(r"[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2,3}(?: [0-9]{1,3})?|[0-9]{4} [0-9]{6} [0-9]{4,5}")
_EDGES = ".,;:!?\"'()#*$%&|<>"
LABELS = len(KINDS) + 1  # 0: none


def _features(word: str, run_digits: int, run_plus: bool, first: bool, last: bool) -> tuple[int, int]:
    """Bits of FEATURES, and bits of the labels that the form of the word allows.

    run_digits, run_plus, first and last are those of the word's part of its run.
    """
    digits = digits_of(word)
    n = len(digits)
    dots = word.count(".")
    core = word.strip(_EDGES)
    ip_like = bool(IP.fullmatch(core))
    values = (
        True, "@" in word, "@" in word and "." in word.partition("@")[2], word[0] == "+", "(" in word or ")" in word,
        "-" in word, ip_like, dots > 0, any(c.isalpha() for c in word), '"' in word or "=" in word,
        1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 12, 13 <= n <= 19, n >= 20, 13 <= n <= 19 and luhn(digits),
        ip_like and all(len(p) <= 3 and int(p) <= 255 for p in core.split(".")),
        7 <= run_digits <= 15, 13 <= run_digits <= 19, run_plus, first, last, first and last,
    )
    plain = not any(c.isalpha() for c in core) and "@" not in word
    allowed = (
        1
        | ("@" in word and "." in word.partition("@")[2]) << 1
        | ip_like << 2
        | (plain and not ip_like) << 3
        | (plain and not ip_like) << 4
    )
    return sum(1 << k for k, v in enumerate(values) if v), allowed


def _parts(words: list[str]) -> list[tuple[int, int]]:
    """A run of words cut into candidate numbers and what stands between them, as (start, end).

    A run that is itself a number stays whole. In others, valid card numbers are found from the left,
    and what is left is cut before each plus and where a phone number would get too long.
    """
    counts = [len(digits_of(w)) for w in words]
    whole = [(0, len(words))]
    total = sum(counts)
    if len(words) == 1 or total < 13 or (total <= 19 and luhn(digits_of("".join(words)))):
        return whole
    cards, at = [], 0
    while at < len(words):
        text, n, found = "", 0, 0
        for end in range(at, len(words)):
            n += counts[end]
            core = words[end].strip(_EDGES)
            text = f"{text} {core}".strip()
            if n > 19 or not counts[end] or words[end][0] in "+(":
                break
            if n >= 13 and GROUPS.fullmatch(text.replace("-", " ")) and luhn(digits_of(text)):
                found = end + 1
                break
            if core != words[end].lstrip(_EDGES):  # a number ends where punctuation follows
                break
        if found:
            cards.append((at, found))
        at = found or at + 1
    if not cards and total <= 15:
        return whole
    out, at = [], 0
    for start, end in [*cards, (len(words), len(words))]:
        first, n = at, 0
        for k in range(at, start):
            phone = words[first][0] == "+"
            if k > first and (words[k][0] == "+" or (phone and n + counts[k] > 15)):
                out.append((first, k))
                first, n = k, 0
            n += counts[k]
        out += [(first, start)] * (first < start) + [(start, end)] * (start < end)
        at = end
    return out


def _fits(counts: list[int], least: int, most: int) -> list[bool]:
    """For each word of a run, whether neighbours around it have from `least` to `most` digits in all."""
    out = [False] * len(counts)
    for start in range(len(counts)):
        n = 0
        for end in range(start, len(counts)):
            n += counts[end]
            if n > most or not counts[end]:
                break
            if n >= least:
                out[start : end + 1] = [True] * (end + 1 - start)
    return out


@dataclass
class Graph:
    """Words of several documents with their links, as flat arrays."""

    doc: list[int]
    span: list[Span]
    features: list[int]
    allowed: list[int]
    before: list[int]  # the word before in the text, if it is in the graph, else -1
    links: list[tuple[int, int]]  # repeated or similar words
    part: list[int]  # the node at which the word's part of its run begins
    doubt: list[bool]  # in a number that the patterns cannot see for what stands beside it

    @classmethod
    def of(cls, texts: list[str]) -> Graph:
        g = cls([], [], [], [], [], [], [], [])
        for d, text in enumerate(texts):
            if MARK.search(text):
                g._add(d, text)
        return g

    def _add(self, d: int, text: str) -> None:
        words = [(k, m) for k, m in enumerate(WORD.finditer(text)) if MARK.search(m[0])]
        runs: list[list] = []
        for k, m in words:
            # No pattern of numbers goes on behind , ; : ! or ?
            if runs and runs[-1][-1][0] == k - 1 and runs[-1][-1][1][0][-1] not in ",;:!?":
                runs[-1].append((k, m))
            else:
                runs.append([(k, m)])
        last_seen: dict[tuple[str, str], int] = {}
        # What the runs of a word and of those like it show: a plus, a valid card number.
        shown: dict[tuple[str, str], int] = {}
        keys_of: list[set[tuple[str, str]]] = []
        base = len(self.doc)
        for run in runs:
            texts = [m[0] for _, m in run]
            counts = [len(digits_of(w)) for w in texts]
            fits = _fits(counts, 13, 19), _fits(counts, 7, 15)
            parts = _parts(texts)
            for start, end in parts:
                digits_in = sum(counts[start:end])
                plus = any(w[0] == "+" for w in texts[start:end])
                luhn_in = 13 <= digits_in <= 19 and luhn("".join(map(digits_of, texts[start:end])))
                proof = luhn_in | plus << 1
                head = len(self.doc)
                for at in range(start, end):
                    node, word = len(self.doc), texts[at]
                    bits, allowed = _features(word, digits_in, plus, at == start, at == end - 1)
                    self.doc.append(d)
                    self.span.append(run[at][1].span())
                    self.features.append(bits)
                    self.allowed.append(allowed & (0b111 | fits[0][at] << 3 | fits[1][at] << 4))
                    self.before.append(node - 1 if at else -1)
                    self.part.append(head)
                    self.doubt.append(len(parts) > 1 and proof > 0)
                    same = "".join(c for c in word.lower() if c.isalnum())
                    digits = digits_of(word)
                    keys = {("same", same)} | ({("digits", digits)} if len(digits) >= 3 else set())
                    linked = {last_seen[k] for k in keys if k in last_seen}
                    self.links += [(other, node) for other in sorted(linked)]
                    last_seen |= dict.fromkeys(keys, node)
                    keys_of.append(keys)
                    for k in keys:
                        shown[k] = shown.get(k, 0) | proof
        for k, keys in enumerate(keys_of):
            for key in keys:
                self.features[base + k] |= shown[key] << SHOWN

    def matrix(self) -> np.ndarray:
        bits = np.array(self.features, dtype=np.int64)[:, None] >> np.arange(len(FEATURES))
        return (bits & 1).astype(np.float64)

    def labels(self, base: list[dict[str, list[Span]]]) -> np.ndarray:
        """The kind of the base span that each word touches, the first listed; 0 for none."""
        out = np.zeros(len(self.doc), dtype=np.int64)
        for node, (d, (start, end)) in enumerate(zip(self.doc, self.span)):
            for k, kind in enumerate(KINDS):
                if any(a < end and start < b for a, b in base[d][kind]):
                    out[node] = k + 1
                    break
        return out


@dataclass
class Field:
    """Weights: of features by label, of neighbouring labels, of equal labels across a link."""

    unary: np.ndarray
    chain: np.ndarray
    link: float

    def chances(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Each word's chances of the labels, by loopy sum-product messages for all documents at once.

        Words outside the graph count as labelled 0. `rounds` is fixed; chains up to
        that length and documents without cycles come out exactly.
        """
        n = len(g.doc)
        if not n:
            return np.zeros((0, LABELS))
        before = np.array(g.before, dtype=np.int64)
        after = np.zeros(n, dtype=bool)
        after[before[before >= 0]] = True
        own = g.matrix() @ self.unary
        own[before < 0] += self.chain[0]
        own[~after] += self.chain[:, 0]
        allowed = np.array(g.allowed)[:, None] >> np.arange(LABELS) & 1
        own[allowed == 0] = -50.0
        right = np.nonzero(before >= 0)[0]
        pairs = np.array(g.links, dtype=np.int64).reshape(-1, 2)
        a = np.concatenate((before[right], pairs[:, 0]))
        b = np.concatenate((right, pairs[:, 1]))
        same = self.link * np.eye(LABELS)
        table = np.concatenate((
            np.broadcast_to(self.chain, (len(right), LABELS, LABELS)),
            np.broadcast_to(same, (len(pairs), LABELS, LABELS)),
        ))
        # Messages along each link both ways: from a to b, then from b to a.
        source, target = np.concatenate((a, b)), np.concatenate((b, a))
        tables = np.concatenate((table, table.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
        message = np.zeros((len(source), LABELS))

        def belief() -> np.ndarray:
            total = own.copy()
            np.add.at(total, target, message)
            return total

        for _ in range(rounds if len(source) else 0):
            cavity = belief()[source] - message[back]
            raw = cavity[:, :, None] + tables
            top = raw.max(axis=1)
            new = top + np.log(np.exp(raw - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * new
        total = belief()
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit_field(
    x: np.ndarray, y: np.ndarray, before: np.ndarray, after: np.ndarray, linked: np.ndarray, steps: int = 400
) -> Field:
    """Maximise the penalised pseudo-likelihood: each word's label given those it is linked to.

    x: features; y: labels; before, after: labels of the neighbours; linked: how
    many linked words have each label. Without words, all weights are 0.
    """
    n = max(len(y), 1)
    unary, chain, link = np.zeros((x.shape[1], LABELS)), np.zeros((LABELS, LABELS)), 0.0
    is_y = np.eye(LABELS)[y]
    is_before, is_after = np.eye(LABELS)[before], np.eye(LABELS)[after]
    for step in range(steps if len(y) else 0):
        score = x @ unary + is_before @ chain + is_after @ chain.T + link * linked
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        gap = is_y - p
        rate = 2.0 / (1 + step / 200)
        unary += rate * (x.T @ gap / n - 1e-4 * unary)
        chain += rate * ((is_before.T @ gap + gap.T @ is_after) / n - 1e-4 * chain)
        link += rate * ((linked * gap).sum() / n - 1e-4 * link)
    return Field(unary, chain, max(link, 0.0))


def _sample_rows(texts: list[str]) -> dict:
    g = Graph.of(texts)
    y = g.labels([base_spans(t) for t in texts])
    before = np.array(g.before, dtype=np.int64)
    own_before = np.where(before >= 0, y[before], 0)
    own_after = np.zeros(len(y), dtype=np.int64)
    own_after[before[before >= 0]] = y[before >= 0]
    linked = np.zeros((len(y), LABELS), dtype=np.int64)
    for a, b in g.links:
        linked[a, y[b]] += 1
        linked[b, y[a]] += 1
    rows: list[list[list[int]]] = [[] for _ in texts]
    for k, d in enumerate(g.doc):
        if g.doubt[k] and not y[k]:  # the patterns say nothing about these
            continue
        rows[d].append([g.features[k], int(y[k]), int(own_before[k]), int(own_after[k]), *linked[k].tolist()])
    return {"words": [[v for w in r for v in w] for r in rows]}


def fit_on(
    docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS
) -> Field:
    """Weights from words of about `sample_docs` documents, at most `sample_words` words.

    Documents are chosen by a hash of their text, words by a hash of their
    document and place, so the same table gives the same weights.
    """
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))
    hashed = F.pmod(F.xxhash64(text_col), F.lit(1_000_003))
    chosen = docs.where(F.col(text_col).rlike("[0-9@]") & (hashed < share * 1_000_003)).select(
        F.xxhash64(text_col, F.lit(7)).alias("_key"), F.col(text_col).alias("_text")
    )
    width = 4 + LABELS
    found = map_texts(chosen, "_key", "_text", lambda: _sample_rows, {"words": "array<long>"}, rows=200)
    single = found.select(
        "_key", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor(F.size("words") / width).cast("int")),
            lambda k: F.slice("words", k * width + 1, width),
        )).alias("place", "word"),
    ).where(F.size("word") == width)
    rows = single.orderBy(F.xxhash64("_key", "place"), "_key", "place", "word").limit(sample_words).collect()
    data = np.array([r["word"] for r in rows], dtype=np.int64).reshape(-1, width)
    x = (data[:, :1] >> np.arange(len(FEATURES)) & 1).astype(np.float64)
    return fit_field(x, data[:, 1], data[:, 2], data[:, 3], data[:, 4:].astype(np.float64))


def added_spans(
    texts: list[str], base: list[dict[str, list[Span]]], field: Field, certain: float = CERTAIN
) -> list[dict[str, list[Span]]]:
    """What the field adds: runs of words that are certainly of one kind and touch no base span."""
    g = Graph.of(texts)
    chance = field.chances(g)
    label = np.where(chance.max(axis=1, initial=0) >= certain, chance.argmax(axis=1), 0) if len(chance) else []
    # Of a number that stands beside others, one certain word speaks for those most likely of its kind.
    sure = {(g.part[k], int(label[k])) for k in range(len(g.doc)) if label[k] and g.doubt[k]}
    best = chance.argmax(axis=1) if len(chance) else []
    for k in range(len(g.doc)):
        if g.doubt[k] and (g.part[k], int(best[k])) in sure:
            label[k] = best[k]
    found: list[dict[str, list[Span]]] = [{k: [] for k in KINDS} for _ in texts]
    node = 0
    while node < len(g.doc):
        k, d, start, end = int(label[node]), g.doc[node], *g.span[node]
        node += 1
        if not k:
            continue
        while (
            node < len(g.doc) and g.before[node] == node - 1 and g.part[node] == g.part[node - 1]
            and label[node] == k and KINDS[k - 1] in ("card", "phone")
        ):
            end = g.span[node][1]
            node += 1
        text = texts[d]
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        n = len(digits_of(text[start:end]))
        fits = {"card": 13 <= n <= 19, "phone": 7 <= n <= 15}.get(KINDS[k - 1], True)
        if fits and start < end and not any(a < end and start < b for s in base[d].values() for a, b in s):
            found[d][KINDS[k - 1]].append((start, end))
    return found


def printed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with <KIND> for each span; spans that overlap go together under the first's kind."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, masked.

    Counts and digest are of the base spans; spans lists base and added ones as
    kind:start:end in code points; masked is the whole text with all of them replaced.
    Null texts count as empty. Each row is judged on its own text: ids may be
    null or repeat; other columns are not used; an empty table gives no rows.
    """

    def make():
        def work(texts: list[str]) -> dict:
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, field)
            both = [{k: b[k] + a[k] for k in KINDS} for b, a in zip(base, added)]
            return {
                **{f"n_{k}": [len(b[k]) for b in base] for k in KINDS},
                "base_sha256": [hashlib.sha256(printed(b).encode()).hexdigest() for b in base],
                "spans": [printed(s) for s in both],
                "masked": [masked(t, s) for t, s in zip(texts, both)],
            }

        return work

    fields = {f"n_{k}": "long" for k in KINDS} | dict.fromkeys(("base_sha256", "spans", "masked"), "string")
    return map_texts(docs, id_col, text_col, make, fields, rows=500)


def mask_documents(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with all spans of their text replaced by <KIND>; null texts stay null."""

    def make():
        def work(texts: list[str]) -> list[str]:
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, field)
            return [masked(t, {k: b[k] + a[k] for k in KINDS}) for t, b, a in zip(texts, base, added)]

        return work

    return replace_texts(docs, text_col, make, rows=500)
