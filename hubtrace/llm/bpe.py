"""BPE encoding and decoding with batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every word
merges its pair of lowest rank, at all its places at once; the ranks of
neighbouring symbols are found by binary search over the sorted pair keys. Words
without a pair left leave the arrays. Equal stretches of text between blanks
are encoded once a task.

The vocabulary file is read on the driver and travels with the job.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from hubtrace.llm.common import map_texts

#: Distinct stretches that a task keeps at most before it starts anew.
CACHE = 300_000

#: Fixed value: characters with the Unicode property White_Space.
WHITE_SPACE = "".join(map(chr, [
    *range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def gather(values: np.ndarray, start: np.ndarray, count: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches `which` of `values` one after the other."""
    n = count[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start[which] - (ends - n), n) + np.arange(total)]


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, from the JSON of the tokenizers library."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.tokens = [""] * self.size
        for token, k in [*vocab.items(), *added.items()]:
            self.tokens[k] = token
        self.added = added
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the sorted keys, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, count): the ids of word k are ids[start[k] : start[k] + count[k]]. No word is empty."""
        count = np.array([len(w) for w in words], dtype=np.int64)
        start_of, n_of = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        if not words:
            return np.zeros(0, dtype=np.int64), start_of, n_of
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(count) - 1
        sym[ends] = self.last[raw[ends]]
        word = np.arange(len(words))  # the words in the arrays; lengths in count
        slot = np.full(len(sym), -1, dtype=np.int64)  # of the pair that begins here
        slot[:-1] = self.slots(sym[:-1], sym[1:])
        slot[ends] = -1
        out, filled = [], 0
        worst = len(self.ranks)
        while len(word):
            first = np.cumsum(count) - count
            rank = np.where(slot >= 0, self.ranks[slot], worst)
            best = np.minimum.reduceat(rank, first)
            done = best == worst
            if done.any():
                gone = np.repeat(done, count)
                out.append(sym[gone])
                n = count[done]
                start_of[word[done]] = filled + np.cumsum(n) - n
                n_of[word[done]] = n
                filled += int(n.sum())
                keep = ~gone
                sym, slot, rank = sym[keep], slot[keep], rank[keep]
                word, count, best = word[~done], count[~done], best[~done]
                if not len(word):
                    break
            hit = rank == np.repeat(best, count)
            # Of overlapping hits (a a a), every other one from the left merges.
            index = np.arange(len(hit))
            run = hit & ~np.concatenate(([False], hit[:-1]))
            hit &= (index - np.maximum.accumulate(np.where(run, index, 0))) % 2 == 0
            at = np.nonzero(hit)[0]
            sym[at] = self.made[slot[at]]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            lost = np.repeat(np.arange(len(word)), count)[at]
            count = count - np.bincount(lost, minlength=len(word))
            place = np.cumsum(stay) - 1
            sym, slot = sym[stay], slot[stay]
            # Only pairs that touch a merged symbol are new.
            merged = place[at]
            touched = np.unique(np.concatenate((merged, merged[merged > 0] - 1)))
            right = np.minimum(touched + 1, len(sym) - 1)
            slot[touched] = self.slots(sym[touched], sym[right])
            slot[np.cumsum(count) - 1] = -1
        return np.concatenate(out), start_of, n_of


class Encoder:
    """Encodes texts; keeps what it learned about stretches between blanks."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.vocabulary, self.cache = vocabulary, cache
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.added)) + ")")
        self.piece = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE_SPACE}\p{{L}}\p{{N}}]+"
        )
        self.blanks = regex.compile(f"[{WHITE_SPACE}]+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int64)
        self.start = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)

    def stretches(self, text: str) -> list[str]:
        """Normalised runs without white space; no token crosses their ends."""
        if not text.isascii():
            # Small letters come one by one, without the final form of sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # split() also cuts at x1c to x1f, which are no white space here
        return [x for x in self.blanks.split(text) if x] if self.odd.search(text) else text.split()

    def learn(self, new: list[str]) -> None:
        pieces: dict[str, int] = {}
        members: list[int] = []
        sizes = []
        for x in new:
            found = [x] if x.isalpha() and "'" not in x else self.piece.findall(x)
            sizes.append(len(found))
            members += [pieces.setdefault(p, len(pieces)) for p in found]
        ids, start, count = self.vocabulary.encode_words([p.encode("utf-8") for p in pieces])
        which = np.array(members, dtype=np.int64)
        lengths = count[which]
        cuts = np.concatenate(([0], np.cumsum(lengths)))
        bounds = cuts[np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64))))]
        base = len(self.ids)
        self.ids = np.concatenate((self.ids, gather(ids, start, count, which)))
        self.start = np.concatenate((self.start, base + bounds[:-1]))
        self.count = np.concatenate((self.count, np.diff(bounds)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.cache:
            self.reset()
        known, before = self.known, len(self.known)
        special = self.vocabulary.added
        uses: list[list[int]] = []  # indexes of stretches; special tokens as -1 - id
        for text in texts:
            own: list[int] = []
            parts = self.special.split(text) if any(x in text for x in special) else (text,)
            for part in parts:
                if part in special:
                    own.append(-1 - special[part])
                else:
                    own += [known.setdefault(x, len(known)) for x in self.stretches(part)]
            uses.append(own)
        if len(known) > before:
            self.learn(list(known)[before:])
        out = []
        for own in uses:
            which = np.array(own, dtype=np.int64)
            if (which < 0).any():
                found = [
                    np.array([-1 - k]) if k < 0 else self.ids[self.start[k] : self.start[k] + self.count[k]]
                    for k in own
                ]
                out.append(np.concatenate(found))
            else:
                out.append(gather(self.ids, self.start, self.count, which))
        return out


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The tokens' strings joined by spaces, as the library does for a vocabulary without a decoder."""
    return " ".join(map(vocabulary.tokens.__getitem__, ids.tolist()))


def encode_documents(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, ids): the token ids of each row's whole text.

    Null and empty texts have no ids. Ids of documents may be null or repeat;
    other columns are not used; an empty table gives no rows. The file must be one of
    the tokenizers library: BPE over bytes, NFC and lower case, words without spaces.
    """
    source = open(vocabulary_path, encoding="utf-8").read()

    def make():
        encoder = Encoder(Vocabulary(source))
        return lambda texts: {"ids": encoder.encode(texts)}

    return map_texts(docs, id_col, text_col, make, {"ids": "array<int>"}, rows=500)


def bpe_digests(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded.

    Digests are of the ids as little-endian unsigned 32-bit integers and of the
    decoded text in UTF-8. Cases as in encode_documents.
    """
    source = open(vocabulary_path, encoding="utf-8").read()

    def make():
        vocabulary = Vocabulary(source)
        encoder = Encoder(vocabulary)

        def work(texts: list[str]) -> dict:
            ids = encoder.encode(texts)
            return {
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                "decoded_sha256": [
                    hashlib.sha256(decode(vocabulary, x).encode("utf-8")).hexdigest() for x in ids
                ],
            }

        return work

    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return map_texts(docs, id_col, text_col, make, fields, rows=500)
