import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hubtrace.llm import bpe
from llm_docs import LONG, docs_of

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = [
    "", "   ", "a", "a" * 500, "İstanbul ΑΣΣ ΣΑΣ. Σ", "don't we'll I'M 'S 're ''s", "x<|endoftext|>y <|startoftext|> <|endoftext|><|endoftext|>",
    "école Å ẞ̣ ﬁ", "1 23 4567.89 ½ ²", "a\x85b\xa0c d\x1ce\x1ff\x0bg​h﻿i", "日本語テキスト 中文 한국어",
    "😀👍🏽 🇫🇷", "$$$###***!!! ''''s", "́abc", "a\0b", "ſ K Å DŽ ǅ", "<|endoftext|", "ab" * 3000, "HELLO World", LONG[:20_000],
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(PATH, encoding="utf-8").read())


def test_encoder_equals_library(library, vocabulary, small):
    texts = ODD_TEXTS + [t for _, t in small]
    encoder = bpe.Encoder(vocabulary, cache=500)  # starts anew several times
    got = [x for k in range(0, len(texts), 7) for x in encoder.encode(texts[k : k + 7])]
    for text, ids in zip(texts, got):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text[:50]
        assert bpe.decode(vocabulary, ids) == library.decode(want, skip_special_tokens=False)


def test_words_of_one_and_many_symbols(vocabulary):
    words = [b"a", b"th", b"the", b"aaaaaaaaaa", "é".encode()]
    ids, start, count = vocabulary.encode_words(words)
    single = [vocabulary.encode_words([w])[0].tolist() for w in words]
    assert [ids[s : s + n].tolist() for s, n in zip(start, count)] == single
    assert vocabulary.encode_words([])[0].tolist() == []


def test_query_digests(spark, library, small):
    rows = bpe.bpe_digests(docs_of(spark, small), PATH).collect()
    text = dict(small)
    assert len(rows) == len(small)
    for r in rows:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs):
    out = bpe.encode_documents(odd_docs, PATH)
    assert out.columns == ["doc_id", "ids"] and out.count() == odd_docs.count()
    digests = bpe.bpe_digests(odd_docs, PATH)
    empty = hashlib.sha256(b"").hexdigest()
    assert digests.where("doc_id = 2").first()["ids_sha256"] == empty
    assert bpe.bpe_digests(no_docs, PATH).count() == 0
