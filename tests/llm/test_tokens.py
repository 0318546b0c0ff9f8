"""op4 and op9 against the libraries, and the tree reduction at every cut."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from pivotscore.llm import op4_tokens, op9_bpe

LETTERS = list("aaab tT'srevmld  \n\t.,!12é文😀 \x85\xa0　\x1c١İΣ½ª²ß") + ["<|endoftext|>", "<|", "é"]


@pytest.fixture(scope="module")
def tik():
    import tiktoken
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def hug():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def texts(count, longest):
    rng = random.Random(5)
    for k in range(count):
        s = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, longest)))
        yield "".join(c for c in s if ord(c) < 256) if k % 2 else s


def test_tree_reduction_equals_the_library(tik, monkeypatch):
    monkeypatch.setattr(op9_bpe, "LEAF_CHARS", 5)
    monkeypatch.setattr(op9_bpe, "LEAF_BYTES", 6)
    monkeypatch.setattr(op9_bpe, "LEAF_TOKENS", 3)
    codec = op9_bpe.Codec(tik._mergeable_ranks, P.PATTERN)
    for s in [*texts(800, 90), "a" * 3000, " " * 500 + "b", "the" * 700, "é" * 400, "!?" * 300]:
        got = np.frombuffer(codec.encode(s), "<u4").tolist()
        assert got == tik.encode_ordinary(s), s[:80]
        assert codec.decode(got) == s.encode()


def test_digests_of_awkward_rows(docs, no_docs, tik):
    rows = op9_bpe.digests(docs).collect()
    assert len(rows) == docs.count()
    want = sorted((str(r.doc_id), len(ids := tik.encode_ordinary(r.text or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert op9_bpe.digests(no_docs).count() == 0


def test_encode_then_decode(docs):
    back = op9_bpe.decode(op9_bpe.encode(docs)).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((r.text or "").encode() for r in docs.select("text").collect())


def test_piece_counts_equal_the_library(hug):
    lib = op4_tokens.library(P.path("word_bpe_49k.json"))
    for s in texts(1500, 60):
        n, found = lib.pieces(s)
        assert n + sum(v * lib.tokens(p) for p, v in found.items()) == len(hug.encode(s, add_special_tokens=False).ids), repr(s)


def test_counts_of_awkward_rows(docs, no_docs, hug, monkeypatch):
    monkeypatch.setattr(op4_tokens, "BLOCK_ROWS", 4)
    rows = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in op4_tokens.count(docs).collect())
    want = []
    for r in docs.select("doc_id", "text").collect():
        n = len(hug.encode(r.text or "", add_special_tokens=False).ids)
        want.append((str(r.doc_id), len((r.text or "").encode()), n, n > 2048))
    assert rows == sorted(want)
    assert op4_tokens.count(no_docs).count() == 0
