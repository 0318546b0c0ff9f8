"""Substring dedup by sliding spans of sentences.

A text is cut into sentences after line ends and after ``.``, ``!`` or ``?``
followed by a blank.  From every sentence the shortest run of at least
``SENTENCES`` sentences and ``LEAST`` words, or of ``ENOUGH`` words, is
hashed, and likewise the shortest such run that ends at every sentence (so
the end of a repeated passage is covered as well as its start).  Runs are
joined over the whole corpus by a 128-bit hash of their words; the first
occurrence, by id, text hash and place, stays, and every sentence of any
other occurrence of a repeated run is removed.

A repeated passage may start and end inside sentences.  So every window of
``ENOUGH`` words, wherever it starts, is compared as well: the words of any
but its first occurrence go, with the blanks after them.  Equal windows have
the same anchor, the ``GRAM``-word gram of least hash inside, so only pieces
(the windows of one anchor in one text) whose anchor occurs again are joined,
and only anchors with different pieces are joined window by window.

Defined results: a null text counts as empty (nothing to remove, text stays
empty); a text that never reaches the run's size has no runs; sentences are
compared by their words, so blanks may differ; rows that repeat both id and
text count as one occurrence and are treated alike; a null id comes after
all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut
from .op1_jaccard import marked, mix
from .op3_substring import powers

WORDS = re.compile(WORD)
_BLANK = " \t\n\x0b\x0c\r"
SENTENCES, LEAST, ENOUGH = 3, 15, 50
GRAM = 25
#: Kinds with more than one in so many of the rows are dealt over several tasks.
SHARES = 1000
_END = re.compile(r"\n+|[.!?][\x20\t\x0b-\r]+")


def sentences(text: str) -> list[str]:
    """The text's sentences with the blanks that follow them; joined, they are the text.

    Blanks without a word go to the sentence before, or open the first one.
    """
    out: list[str] = []
    at, ahead = 0, ""
    for m in _END.finditer(text):
        part = text[at:m.end()]
        at = m.end()
        if part[0] not in _BLANK or part.strip(_BLANK):
            out.append(ahead + part if ahead else part)
            ahead = ""
        elif out:
            out[-1] += part
        else:
            ahead += part
    if at < len(text):
        if text[at:].strip(_BLANK) or not out:
            out.append(ahead + text[at:])
        else:
            out[-1] += text[at:]
    elif ahead:
        out.append(ahead)
    return out


def words_of(text: str) -> list[bytes]:
    """The words as UTF-8: bytes are split at just the blanks that end a word."""
    return text.encode().split()


def runs(words: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs over sentences of so many words, end exclusive."""
    n = len(words)
    before = np.zeros(n + 1, np.int64)
    np.cumsum(words, out=before[1:])
    at = np.arange(n)
    # Forward: the least end with enough words, and with enough sentences and words.
    many = np.searchsorted(before, before[:-1] + ENOUGH)
    some = np.maximum(np.searchsorted(before, before[:-1] + LEAST), at + SENTENCES)
    end = np.minimum(many, some)
    # Backward: the greatest start likewise.
    many = np.searchsorted(before, before[1:] - ENOUGH, side="right") - 1
    some = np.minimum(np.searchsorted(before, before[1:] - LEAST, side="right") - 1, at + 1 - SENTENCES)
    start = np.maximum(many, some)
    ahead, back = end <= n, start >= 0
    found = np.unique(np.concatenate([at[ahead] * (n + 1) + end[ahead], start[back] * (n + 1) + at[back] + 1]))
    return list(zip((found // (n + 1)).tolist(), (found % (n + 1)).tolist(), strict=True))


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, anchor): the runs of windows, by start, with the same leftmost gram of least hash."""
    n = len(h)
    if n < ENOUGH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(h) * up[:n], out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1])
    inside = np.lib.stride_tricks.sliding_window_view(grams, ENOUGH - GRAM + 1)
    q = np.arange(n - ENOUGH + 1) + inside.argmin(1)
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    return first, np.r_[first[1:], len(q)], grams[q[first]]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "s")


_PLACED = "h long, g long, doc_id long, key long, s int, e int"


def _placed(b: pa.RecordBatch, who: list, hashes: list, starts: list, ends: list) -> list[pa.Array]:
    both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
    take = pa.array(who, pa.int32())
    return [pa.array(both[:, 0]), pa.array(both[:, 1]), b.column("doc_id").take(take), b.column("key").take(take),
            pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]


def marks(docs: DataFrame) -> DataFrame:
    """(anchor, h, g, doc_id, key, s, e): every run and every piece of every text with the hash of its words.

    A run has no anchor and holds the sentences [s, e); a piece's windows
    start at the words [s, e).  Each text is split once for both.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, hashes, starts, ends, marks_ = [], [], [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                words, edge = [], [0]
                for p in sentences(t or ""):
                    words += words_of(p)
                    edge.append(len(words))
                h = hashes_of(words)
                raw = h.tobytes()
                found = runs(np.diff(edge)) if words else []
                hashes += [xxhash.xxh3_128_digest(raw[8 * edge[s]:8 * edge[e]]) for s, e in found]
                starts += [s for s, _ in found]
                ends += [e for _, e in found]
                marks_ += [None] * len(found)
                first, end, anchor = (x.tolist() for x in anchors(h))
                hashes += [xxhash.xxh3_128_digest(raw[8 * s:8 * (e - 1 + ENOUGH)]) for s, e in zip(first, end, strict=True)]
                starts += first
                ends += end
                marks_ += anchor
                who += [k] * (len(found) + len(first))
            anchor = pa.array(marks_, pa.uint64()).view(pa.int64())
            yield pa.RecordBatch.from_arrays([anchor, *_placed(b, who, hashes, starts, ends)], names=["anchor", "h", "g", "doc_id", "key", "s", "e"])

    return _keyed(docs).mapInArrow(rows, "anchor long, " + _PLACED)


def met(rows: DataFrame, kinds: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined to ``kinds(*on, n, ...)``, n being the number of a kind's rows; hot kinds don't meet in one task.

    A kind of more than one in ``SHARES`` of the rows is dealt over so many
    more tasks.  Fewer than ``SHARES`` kinds are, so their list is broadcast.
    """
    total = kinds.agg(F.sum("n")).first()[0] or 1
    ways = F.ceil(F.col("n") * SHARES / total).cast("long")
    hot = F.broadcast(kinds.select(*on, ways.alias("ways")).filter("ways > 1"))
    dealt = rows.join(hot, on, "left").withColumn("way", F.pmod(F.xxhash64(*rows.columns), F.coalesce("ways", F.lit(1)))).drop("ways")
    return dealt.join(kinds.withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1))), [*on, "way"]).drop("way", "n")


def repeated(found: DataFrame) -> DataFrame:
    """(doc_id, key, cover): for each text with any, its non-first occurrences of repeated runs of ``found`` as (s, e)."""
    place = _place()
    first = cut(found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
                .filter(~F.col("first").eqNullSafe(F.col("last"))).drop("last"))
    later = (met(found, first, ["h", "g"]).filter(~place.eqNullSafe(F.col("first")))
             .groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "e")).alias("cover")))  # bounded by one text's runs
    return cut(later)


def windows(texts: DataFrame) -> DataFrame:
    """(h, g, doc_id, key, s, e): the windows that start in the ``parts`` of ``texts(doc_id, key, text, parts)``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, hashes, starts = [], [], []
            for k, (t, parts) in enumerate(zip(b.column("text").to_pylist(), b.column("parts").to_pylist(), strict=True)):
                raw = hashes_of(words_of(t or "")).tobytes()
                for s in (s for x in parts for s in range(x["s"], x["e"])):
                    hashes.append(xxhash.xxh3_128_digest(raw[8 * s:8 * (s + ENOUGH)]))
                    who.append(k), starts.append(s)
            yield pa.RecordBatch.from_arrays(_placed(b, who, hashes, starts, [s + 1 for s in starts]), names=["h", "g", "doc_id", "key", "s", "e"])

    return texts.mapInArrow(rows, _PLACED)


def with_keys(docs: DataFrame, asked: DataFrame, how: str) -> DataFrame:
    """(doc_id, key, text) of ``docs`` joined to ``asked(doc_id, key, ...)``; other texts are not shuffled.

    A filter of set size leaves them out before the join; with ``how`` "left" they are added again.
    """
    name = F.xxhash64("doc_id", "key").alias("rk")
    texts = marked(_keyed(docs).select("*", name), asked.select(name))
    more = asked.withColumnRenamed("doc_id", "d").withColumnRenamed("key", "k")
    near = texts.filter("likely").drop("likely", "rk")
    got = near.join(more.hint("merge"), near.doc_id.eqNullSafe(more.d) & (near.key == more.k), how).drop("d", "k")
    return got if how == "inner" else got.unionByName(texts.filter("not likely").drop("likely", "rk"), allowMissingColumns=True)


def repeated_words(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, key, words): for each text with any, the starts [s, e) of its windows that are not the first of their kind.

    ``found`` holds the pieces of ``docs``.
    """
    place = _place()
    often = cut(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    some = cut(met(found, often, ["anchor"]))
    kinds = cut(some.groupBy("anchor", "h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min(F.expr("e - s")).alias("size"),
                                                     F.count(F.lit(1)).alias("n")))
    again = kinds.filter(~F.col("first").eqNullSafe(F.col("last"))).select("anchor", "h", "g", "first", "n")
    whole = met(some, again, ["anchor", "h", "g"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "key", "s", "e")
    # Different pieces of one anchor may share windows; the first place of each piece stands for all of its places.
    mixed = cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    ask = (met(kinds.drop("n"), mixed, ["anchor"]).select("first.doc_id", "first.key", "first.s", (F.col("first.s") + F.col("size")).alias("e"))
           .groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "e")).alias("parts")))  # bounded by one text's pieces
    single = cut(windows(with_keys(docs, cut(ask), "inner")))
    first = cut(single.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
                .filter(~F.col("first").eqNullSafe(F.col("last"))).drop("last"))
    later = met(single, first, ["h", "g"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "key", "s", "e")
    return cut(whole.unionByName(later).groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "e")).alias("words")))  # bounded likewise


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of 0..n-1 lie in one of the [start, end)."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0


def ranges(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The starts and ends in each row's list of (s, e); none for null."""
    flat = column.flatten()
    s, e = flat.field("s").to_numpy(), flat.field("e").to_numpy()
    at = 0
    for n in pc.fill_null(pc.list_value_length(column), 0).to_pylist():
        yield s[at:at + n], e[at:at + n]
        at += n


def left(text: str, runs_: tuple[np.ndarray, np.ndarray], windows_: tuple[np.ndarray, np.ndarray]) -> tuple[int, list[int], str]:
    """Number of sentences, numbers of those that go whole, and the text that stays."""
    parts = sentences(text)
    out = covered(len(parts), *runs_) if len(runs_[0]) else np.zeros(len(parts), bool)
    if not len(windows_[0]):
        return len(parts), np.flatnonzero(out).tolist(), "".join(p for p, o in zip(parts, out.tolist(), strict=True) if not o)
    sizes = [len(words_of(p)) for p in parts]
    starts, ends = windows_
    gone, at, kept = covered(sum(sizes), starts, ends - 1 + ENOUGH), 0, []
    n_gone_in = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], np.cumsum(sizes)])]).tolist()
    for k, (p, size, n_gone) in enumerate(zip(parts, sizes, n_gone_in, strict=True)):
        mine = gone[at:at + size]
        at += size
        out[k] |= 0 < size == n_gone
        if out[k]:
            continue
        if not n_gone:
            kept.append(p)
            continue
        # A word goes with the blanks after it.
        begins = [m.start() for m in WORDS.finditer(p)]
        kept += [p[:begins[0]], *(p[s:e] for s, e, g in zip(begins, [*begins[1:], len(p)], mine.tolist(), strict=True) if not g)]
    return len(parts), np.flatnonzero(out).tolist(), "".join(kept)


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, text, kept_sha256): the texts without repeated spans.

    ``removed`` lists the numbers, from 0, of the sentences removed whole;
    of a sentence cut by the end of a passage only the other words stay.
    """
    found = cut(marks(docs))
    runs_, words = repeated(found.filter("anchor is null").drop("anchor")), repeated_words(docs, found.filter("anchor is not null"))
    cover = (runs_.withColumn("words", F.lit(None).cast(words.schema["words"].dataType))
             .unionByName(words.withColumn("cover", F.lit(None).cast(runs_.schema["cover"].dataType)))
             .groupBy("doc_id", "key").agg(F.first("cover", True).alias("cover"), F.first("words", True).alias("words")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [left(t or "", c, w) for t, c, w in zip(b.column("text").to_pylist(), ranges(b.column("cover")), ranges(b.column("words")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _, _ in got], pa.int64()), pa.array([len(g) for _, g, _ in got], pa.int64()),
                                              pa.array([g for _, g, _ in got], pa.list_(pa.int32())), pa.array([k for _, _, k in got], pa.string()),
                                              pa.array([hashlib.sha256(k.encode()).hexdigest() for _, _, k in got], pa.string())],
                                             names=["doc_id", "n_sentences", "n_removed", "removed", "text", "kept_sha256"])

    return (with_keys(docs, cut(cover), "left").select("doc_id", "text", "cover", "words")
            .mapInArrow(rows, "doc_id long, n_sentences long, n_removed long, removed array<int>, text string, kept_sha256 string"))
