import hashlib
import random
import tracemalloc
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from hubtrace.llm import queries
from hubtrace.llm.alignment import STEP_CHARS, Aligner, Runs, cross_tokenizer, steps
from hubtrace.llm.vocabularies import ByteLevel, Pieces
from llm_docs import CLASHING, ODD, docs_of

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")

SPECIAL = [
    (20, "<|endoftext|> in a text"), (21, "<s> </s> <unk> <0x41>"), (22, "▁marked ▁"), (23, "tab\tand\n\nlines  "),
    (24, "   "), (25, "á ﬁ ½ Ａ"), (26, "nul \x00 here"), (27, "مرحبا שלום 你好 🎉🎉"), (28, "x" * 3000), (29, " lead"),
    (33, "wide" + " " * 700 + "gap"), (34, "line" + "\n \t" * 300 + "feeds" + "\u3000" * 600),
    (30, "don't stop... 12,345.67 (a+b)=c; e.g. http://x.y/z?q=1"), (31, " nbsp  em"), (32, "\x1c\x1f odd"),
]


@pytest.fixture(scope="module")
def brute():
    """What the contract says, token by token."""
    library = tokenizers.Tokenizer.from_file(A)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}

    def tokens(text):
        if not text:
            return [], []
        a = [(k, bytes(byte[c] for c in library.id_to_token(k))) for k in library.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for k in model.encode(text):
            piece = model.id_to_piece(k)
            b.append((k, bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        same = b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)
        return (a, b) if same else ([], [])

    def spans(side):
        out, at = [], 0
        for k, x in side:
            out.append((k, at, at + len(x)))
            at += len(x)
        return out

    def run(rows):
        aligned, counts = [], Counter()
        for doc, text in rows:
            a, b = map(spans, tokens(text))
            ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
            groups, start = [], 0
            for end in ends:
                part = [",".join(str(k) for k, s, e in side if start <= s and e <= end) for side in (a, b)]
                groups.append("|".join(part))
                start = end
            links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
            counts.update(links)
            aligned.append((doc, len(a), len(b), groups, links))
        best = {}
        for (_, y), n in counts.items():
            best[y] = max(best.get(y, 0), n)
        return sorted((
            (doc, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links),
             sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for doc, n_a, n_b, groups, links in aligned
        ), key=repr)

    return run


def plain(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert df.columns == names
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("frequent", [200_000, 3])
def test_odd_texts(spark, brute, frequent):
    rows = [(k, x if x is None or len(x) < 10_000 else x[:2_000]) for k, x in ODD] + SPECIAL
    assert plain(cross_tokenizer(docs_of(spark, rows, CLASHING), A, B, frequent=frequent)) == brute(rows)


def test_whole_test_set(spark, brute, small):
    """Every document up to 3,000 characters by brute force; longer ones by their own numbers below."""
    rows = [(k, x) for k, x in small if len(x) <= 3_000]
    assert len(rows) > 100
    assert plain(cross_tokenizer(docs_of(spark, rows), A, B)) == brute(rows)


def test_long_text_and_empty_table(spark, odd_docs, no_docs):
    assert plain(cross_tokenizer(no_docs, A, B)) == []
    found = cross_tokenizer(odd_docs, A, B).where("doc_id = 6").first()
    assert found["n_a"] > 60_000 and found["n_links"] >= max(found["n_a"], found["n_b"])


def test_forgetting_windows_changes_nothing(small):
    texts = [x for _, x in small]
    a, b = ByteLevel(open(A, encoding="utf-8").read()), Pieces(open(B, "rb").read())
    keeping, forgetting = Aligner(a, b), Aligner(a, b, cache=10)
    for k in range(0, len(texts), 20):
        one, other = keeping(texts[k : k + 20]), forgetting(texts[k : k + 20])
        assert all(list(one[n]) == list(other[n]) for n in one)
    assert len(forgetting.windows.n_groups) < len(keeping.windows.n_groups)


def test_a_step_holds_little_memory(small):
    """A batch of 10,000 rows: every row once, in order, in steps whose objects and arrays stay below 45 MB (61 with steps of 2^21)."""
    rows = [(i, x if n % 50 else "") for n, (i, x) in enumerate(small * 50)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in enumerate((pa.int64(), pa.string()))], ["id", "text"])
        for part in (rows, [], rows[:3])
    ]
    aligner = Aligner(ByteLevel(open(A, encoding="utf-8").read()), Pieces(open(B, "rb").read()))
    found, longest = [], max(len(x) for _, x in rows)
    tracemalloc.start()
    try:
        for k, (ids, texts) in enumerate(steps(iter(batches))):
            assert 0 < len(ids) == len(texts) and sum(map(len, texts)) < STEP_CHARS + longest
            found += zip(ids.to_pylist(), map(hash, texts))
            if k < 5:
                aligner(texts)
        assert tracemalloc.get_traced_memory()[1] < 45 << 20
    finally:
        tracemalloc.stop()
    assert found == [(i, hash(x)) for i, x in rows + rows[:3]]


def test_byte_level_ids_are_the_libraries(small):
    """Both ways to encode, on texts and on every code point among letters, digits, signs and blanks."""
    a = ByteLevel(open(A, encoding="utf-8").read())
    assert a.quick is not None
    texts = [x for _, x in small if len(x) < 20_000]
    for k in range(0, 0x20000, 16):
        signs = [chr(c) for c in range(k, k + 16) if not 0xD800 <= c <= 0xDFFF]
        texts.append(" ".join(f"a{c}b 1{c}2  {c}\n{c}{c}!{c}?" for c in signs))
    for text in texts:
        assert a.encode(" " + text).tolist() == a.library.encode(" " + text, add_special_tokens=False).ids


def test_windows_that_share_a_hash_stay_apart(small, monkeypatch):
    """Were all hashes equal, or two each, windows would still be told apart by their ids."""
    a, b = ByteLevel(open(A, encoding="utf-8").read()), Pieces(open(B, "rb").read())
    texts = [x for _, x in small[:20]]
    right = Aligner(a, b)(texts)
    hashed = Runs.hashed
    for bits in (0, 5, 12):
        monkeypatch.setattr(Runs, "hashed", lambda self, salt: hashed(self, salt) & Runs.hashed.mask)
        Runs.hashed.mask = (1 << bits) - 1
        aligner = Aligner(a, b)
        for _ in range(2):
            wrong = aligner(texts)
            assert all(list(right[n]) == list(wrong[n]) for n in right)
            wrong = [aligner([x]) for x in texts]
            assert [x["groups_sha256"][0] for x in wrong] == list(right["groups_sha256"])


def test_pieces_by_words_are_the_librarys(small):
    b = Pieces(open(B, "rb").read())
    assert b.by_words
    texts = [x for _, x in small if x] + [x for _, x in SPECIAL] + [x for _, x in ODD if x]
    ids, count = b.flat(texts)
    assert ids.tolist() == [k for x in texts for k in b.library.encode(x)]
    assert count.tolist() == [len(b.library.encode(x)) for x in texts]


def test_query_takes_the_whole_table(spark):
    found = queries.op11_alignment(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == 200
    assert all(r["n_a"] and r["n_groups"] <= min(r["n_a"], r["n_b"]) and r["n_best"] <= r["n_links"] for r in found)
