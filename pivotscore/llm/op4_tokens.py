"""Token counts without token ids.

Documents are packed into blocks of bounded size.  A block holds its
distinct pre-tokens once, and for each document the pre-tokens' positions in
that list with their frequencies.  The distinct pre-tokens of all blocks are
counted in tokens once each, joined back to the blocks' lists, and a
document's count is the sum of frequency times tokens.  No ids are made.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty
table gives no rows; repeated rows count alike; added special strings inside
a text count one token each, as the library's default has it.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A block is closed at this many characters, or rows.
BLOCK_CHARS, BLOCK_ROWS = 16_000_000, 50_000
#: Bits of a piece's number in its block, and of a block's in its partition.
PIECE_BITS, BLOCK_BITS = 26, 12
_PLAIN = re.compile("[^\t-\r\x20-\x7e\xa0-\xff]")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \xa0a-z0-9ªµº²³¹¼-¾ß-öø-ÿ]+")


class Library:
    """The tokenizer file's own normaliser, splitter and model, step by step."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = [a["content"] for a in told["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")

    def pieces(self, text: str) -> tuple[int, Counter]:
        """Added tokens in the text, and its pre-tokens with their frequencies."""
        parts = self.added.split(text) if "<|" in text else [text]
        found: Counter = Counter()
        for p in parts:
            if _PLAIN.search(p):
                t = self.tokenizer
                norm = t.normalizer.normalize_str(p)
                found.update(norm[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(norm))
            else:
                found.update(_PIECE.findall(p.lower()))
        return len(parts) - 1, found

    def tokens(self, piece: str) -> int:
        """Tokens of one pre-token (already normalised)."""
        t = self.tokenizer
        return sum(len(t.model.tokenize(p)) for p, _ in t.pre_tokenizer.pre_tokenize_str(piece))


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def blocks(docs: DataFrame, path: str) -> DataFrame:
    """One row per block: its documents, distinct pre-tokens, and packed positions and frequencies."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(path)
        part = TaskContext.get().partitionId()
        closed = 0
        names: dict[str, int] = {}
        ids, sizes, added, lens, where, freq = [], [], [], [], [], []
        chars = 0

        def close() -> pa.RecordBatch:
            block = (part << BLOCK_BITS) | closed
            packed = [_pack(np.concatenate(x or [np.zeros(0, "<i4")])) for x in (where, freq)]
            return pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int64())), "added": pa.array([added], pa.list_(pa.int64())),
                "lens": pa.array([lens], pa.list_(pa.int32())), "places": pa.array([packed[0]], pa.binary()),
                "freqs": pa.array([packed[1]], pa.binary()), "pieces": pa.array([list(names)], pa.list_(pa.string()))})

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                t = t or ""
                n, found = lib.pieces(t)
                at = np.fromiter((names.setdefault(p, len(names)) for p in found), "<i4", len(found))
                order = np.argsort(at)
                where.append(np.diff(at[order], prepend=0).astype("<i4"))  # small steps pack well
                freq.append(np.fromiter(found.values(), "<i4", len(found))[order])
                ids.append(d), sizes.append(len(t.encode())), added.append(n), lens.append(len(found))
                chars += len(t)
                if closed < (1 << BLOCK_BITS) - 1 and (chars >= BLOCK_CHARS or len(ids) >= BLOCK_ROWS):
                    yield close()
                    closed, chars = closed + 1, 0
                    names, ids, sizes, added, lens, where, freq = {}, [], [], [], [], [], []
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "block long, ids array<long>, sizes array<long>, added array<long>, lens array<int>, "
              "places binary, freqs binary, pieces array<string>")


def count(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    packed = cut(blocks(docs, path))
    listed = packed.select("block", F.posexplode("pieces").alias("pos", "piece"))
    used = listed.select((F.shiftleft("block", PIECE_BITS) + F.col("pos")).alias("slot"), "piece")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("piece"), pa.array(map(lib.tokens, b.column("piece").to_pylist()), pa.int32())],
                                             names=["piece", "n"])

    counts = cut(used.select("piece").distinct().mapInArrow(tokens, "piece string, n int"))
    # Number and tokens of a piece share a long, which is half the size of a struct; a block's list is bounded.
    place = F.col("slot").bitwiseAND((1 << PIECE_BITS) - 1)
    lists = (used.join(counts, "piece")
             .groupBy(F.shiftright("slot", PIECE_BITS).alias("block"))
             .agg(F.sort_array(F.collect_list(F.shiftleft(place, 64 - 1 - PIECE_BITS) + F.col("n"))).alias("tokens")))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lens = np.array(r["lens"], np.int64)
                ends = np.cumsum(lens)
                steps, freq = _unpack(r["places"], "<i4").astype(np.int64), _unpack(r["freqs"], "<i4").astype(np.int64)
                run = np.cumsum(steps)
                before = np.concatenate([[0], run])[ends - lens]
                each = (np.array(r["tokens"] or [0], np.int64) & ((1 << (63 - PIECE_BITS)) - 1))[run - np.repeat(before, lens)] * freq if len(run) else run
                whole = np.concatenate([[0], np.cumsum(each)])
                n = whole[ends] - whole[ends - lens] + np.array(r["added"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(r["sizes"], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                                                 names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (packed.drop("pieces").join(lists, "block", "left")
            .mapInArrow(totals, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
