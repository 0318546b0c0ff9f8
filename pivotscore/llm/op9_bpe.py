"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut into halves down to small leaves.  A leaf is split into
pre-tokens by the pattern and each pre-token into tokens.  Two neighbours
join by splitting again from the left part's last unstable pre-token, in a
window that doubles until a pre-token starts where one of the right part
does: the pattern matches from left to right without memory, so everything
beyond that point stays as it was.  Long pre-tokens are themselves encoded
by halves; there a re-encoded window of tokens is settled once it leaves its
outermost tokens unchanged, because a sequence is the canonical encoding when
each neighbouring pair of its tokens is.  Decoding concatenates byte strings
up the same kind of tree.

Defined results: a null text counts as empty (no tokens; both hashes are
those of the empty string); an empty table gives no rows; repeated rows
encode alike; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf, tokens of a leaf in decoding, bytes of a directly encoded pre-token.
LEAF_CHARS, LEAF_TOKENS, LEAF_BYTES = 4096, 4096, 4096
#: Distinct pre-tokens kept per worker before the memory is emptied.
KEPT = 400_000
_LATIN = re.compile("[^\t-\r\x20-\x7e\xa0-\xff]")
_LETTER, _NUMBER, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \xa0"


def splitters(pattern: str) -> tuple:
    """The pattern for any text, and the same for Latin-1 text with classes spelt out."""
    full = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    plain = (pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_BLANK}{_LETTER}{_NUMBER}]").replace(r"\p{L}", f"[{_LETTER}]")
             .replace(r"\p{N}", f"[{_NUMBER}]").replace(r"\s", f"[{_BLANK}]").replace(r"\S", f"[^{_BLANK}]"))
    return regex.compile(full), re.compile(plain)


class Codec:
    """Encoder and decoder of one vocabulary of byte strings with merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.strings = {i: b for b, i in ranks.items()}
        self.any, self.latin = splitters(pattern)
        self.known: dict[str, bytes] = {}
        self.longest = max(map(len, ranks), default=0)

    # -- one pre-token ------------------------------------------------------- #
    def merge(self, data: bytes) -> list[bytes]:
        """Tokens of a short byte string: merge the lowest-ranked pair until none is left."""
        if data in self.ranks:
            return [data]
        if len(data) > 48:
            return self.merge_long(data)
        parts, ranks = [data[i:i + 1] for i in range(len(data))], self.ranks
        none = len(ranks) + 1
        pair = [ranks.get(data[i:i + 2], none) for i in range(len(data) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        return parts

    def merge_long(self, data: bytes) -> list[bytes]:
        """The same with a heap of pairs, in n log n steps."""
        n, ranks = len(data), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the token that starts at i; 0: none starts there
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != e:
                continue
            end[i], end[j] = e, 0
            if e < n:
                before[e] = i
                if end[e] - i <= self.longest and (r := ranks.get(data[i:end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            p = before[i]
            if p >= 0 and e - p <= self.longest and (r := ranks.get(data[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(data[i:end[i]])
            i = end[i]
        return out

    def join_tokens(self, a: list[bytes], b: list[bytes]) -> list[bytes]:
        if not a or not b:
            return a + b
        size = 1
        while True:
            left, right = a[-size:], b[:size]
            got = self.merge(b"".join(left + right))
            open_left, open_right = size < len(a), size < len(b)
            if (not open_left or got[0] == left[0]) and (not open_right or got[-1] == right[-1]):
                return a[:-size] + got + b[size:] if open_left else got + b[size:]
            size *= 2

    def tokens(self, data: bytes) -> list[bytes]:
        """Tokens of one pre-token of any length."""
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join_tokens(self.tokens(data[:half]), self.tokens(data[half:]))

    def code(self, piece: str) -> bytes:
        """A pre-token's ids as little-endian 32-bit integers."""
        got = self.known.get(piece)
        if got is None:
            ids = [self.ranks[t] for t in self.tokens(piece.encode())]
            got = np.array(ids, "<u4").tobytes()
            if len(piece) <= 64:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[piece] = got
        return got

    # -- a text -------------------------------------------------------------- #
    def join(self, a: tuple[list[str], list[bytes]], b: tuple[list[str], list[bytes]], split) -> tuple[list[str], list[bytes]]:
        """The monoid's product: (pre-tokens, codes) of two neighbouring texts."""
        (left, lc), (right, rc) = a, b
        if not left or not right:
            return (left + right, lc + rc)
        held, tail = 0, ""  # pre-tokens that the text to the right may change: the last, and those starting within 3 of the end
        while left and (not held or held < 3 and len(tail) < 2):
            tail = left.pop() + tail
            lc.pop()
            held += 1
        size = 4
        while True:
            window = tail + "".join(right[:size])
            starts, at = {}, len(tail)
            for k, p in enumerate(right[:size]):
                starts[at] = k
                at += len(p)
            whole, fresh, met = size >= len(right), [], None
            for m in split.finditer(window):
                s, e = m.span()
                if not whole and (e >= len(window) or s + 3 > len(window)):
                    break
                fresh.append(m[0])
                if e in starts:
                    met = starts[e]
                    break
            if met is not None or whole:
                rest = met if met is not None else len(right)
                left.extend(fresh)
                lc.extend(map(self.code, fresh))
                left.extend(right[rest:])
                lc.extend(rc[rest:])
                return left, lc
            size *= 2

    def reduce(self, text: str, split) -> tuple[list[str], list[bytes]]:
        if len(text) <= LEAF_CHARS:
            pieces = split.findall(text)
            known = self.known.get
            return pieces, [known(p) or self.code(p) for p in pieces]
        half = len(text) // 2
        return self.join(self.reduce(text[:half], split), self.reduce(text[half:], split), split)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(self.reduce(text, self.any if _LATIN.search(text) else self.latin)[1])

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.strings.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a file of ``base64 rank`` lines, read once per worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Codec(ranks, pattern)


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers
    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""
    path, pattern = _defaults(path, pattern)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = [np.frombuffer(c.encode(t or ""), "<u4").astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes): the bytes of every row of ids; null ids give null."""
    path, pattern = _defaults(path, pattern)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            out = [None if i is None else c.decode(i) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(rows, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode every whole text: counts and hashes of both."""
    path, pattern = _defaults(path, pattern)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, ids, back = [], [], []
            for t in b.column("text").to_pylist():
                code = c.encode(t or "")
                n.append(len(code) // 4)
                ids.append(hashlib.sha256(code).hexdigest())
                back.append(hashlib.sha256(c.decode(np.frombuffer(code, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
