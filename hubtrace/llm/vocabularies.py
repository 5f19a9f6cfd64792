"""Public vocabularies inside tasks: token ids of texts, and the bytes of tokens."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers

from hubtrace.llm.bpe import byte_symbols, gather

#: A space in a piece; how byte-level vocabularies cut a text before they merge.
MARK = "▁"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+(?!\S)|\s+"
#: Of white space that tiktoken cannot take, this much side by side.
LONG_RUN, STEP = 500, 100


class Tokens:
    """Bytes of a vocabulary's tokens, their lengths, and which begin with a space."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = pa.array(tokens, pa.large_binary())
        self.size = np.array([len(x) for x in tokens], dtype=np.int64)
        self.spaced = np.array([x[:1] == b" " for x in tokens], dtype=bool)

    def encode(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and how many each has."""
        found = list(map(self.encode, texts))
        count = np.array(list(map(len, found)), dtype=np.int64)
        return np.concatenate(found or [np.zeros(0)]).astype(np.int64), count

    def bytes_of(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The joined bytes of each text's tokens."""
        joined = self.tokens.take(pa.array(ids))
        ends = np.concatenate(([0], np.frombuffer(joined.buffers()[1], dtype=np.int64, count=len(ids) + 1)[np.cumsum(count)]))
        data = memoryview(joined.buffers()[2] or b"")
        return [bytes(data[x:y]) for x, y in zip(ends.tolist(), ends[1:].tolist())]


class ByteLevel(Tokens):
    """A byte-level vocabulary in a file of the tokenizers library; ids are those of the library.

    Strings of special tokens in a text are plain text unless `special` is set. Where a file's merges make the ids in
    ascending order and its texts are cut by the usual pattern only, tiktoken gives the same ids in a quarter of
    the time; it cannot take long runs of white space, so texts with such runs, and other files, are encoded
    by the library.
    """

    def __init__(self, source: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self.library = tokenizers.Tokenizer.from_str(source)
        self.library.encode_special_tokens = not special
        self.library.no_truncation()
        self.library.no_padding()
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        spec = json.loads(source)
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, k in vocab.items():
            if token not in added:
                tokens[k] = bytes(byte_of[c] for c in token)
        super().__init__(tokens)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[x + y] for x, y in merges]
        cut = spec.get("pre_tokenizer") or {}
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.special = added if special else {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
        self.quick = None
        usual = usual and (plain or not special)
        if usual and spec.get("normalizer") is None and made == sorted(set(made)) and not spec["model"].get("ignore_merges"):
            ranks = {tokens[k]: k for token, k in vocab.items() if token not in added}
            self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.long_run = re.compile(rf"\s{{{LONG_RUN}}}")
        self.sampled_run = re.compile(rf"\s{{{LONG_RUN // STEP}}}")

    def _has_long_run(self, text: str) -> bool:
        """Whether a long run of white space is there; it holds LONG_RUN / STEP neighbours of every STEP-th place."""
        return bool(self.sampled_run.search(text[::STEP]) and self.long_run.search(text))

    def encode(self, text: str) -> np.ndarray:
        if self.quick is None or self._has_long_run(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.quick.encode_to_numpy(text, allowed_special="all")


class Pieces(Tokens):
    """A sentencepiece model, which adds a space in front of a text itself.

    Where no piece goes on over a space behind another character, a text is the sum of its words, each with the space
    before it; the library then gets each word once a step. Texts with spaces side by side or at an end are the
    library's as a whole, as are all texts with other models.
    """

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        super().__init__([
            bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.replace(MARK, " ").encode("utf-8")
            for k, p in enumerate(pieces)
        ])
        self.by_words = not any(MARK in p.lstrip(MARK) for p in pieces) and self.library.encode(" a") != self.library.encode("a")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text), dtype=np.uint32)

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [not self.by_words or "  " in x or x[:1] == " " or x[-1:] == " " or MARK in x for x in texts]
        if all(odd):
            return super().flat(texts)
        words = pc.split_pattern(pa.array(["" if o else x for x, o in zip(texts, odd)], pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        # Odd texts count as one more word each.
        alone = [x for x, o in zip(texts, odd) if o]
        found = self.library.encode(distinct + alone, num_threads=1)
        count = np.array(list(map(len, found)), dtype=np.int64)
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(count.sum()))
        which = coded.indices.to_numpy().astype(np.int64)
        first = words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
        which[first[odd]] = len(distinct) + np.arange(len(alone))
        return gather(ids, np.cumsum(count) - count, count, which), np.add.reduceat(count[which], first)
