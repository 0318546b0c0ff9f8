"""Exact substring dedup: bytes covered by a long string that occurs twice.

Every window of ``WINDOW`` bytes belongs to its anchor, the leftmost 50-byte
gram of least hash inside it, so equal windows have equal anchors.  An anchor
can only matter if the 225 bytes up to its end, or from its start, occur
elsewhere; the others are set aside by hash counts.  What is left is cut into
pieces (the windows of one anchor in one text), equal pieces and equal texts
are collapsed, and the pieces go to shards by anchor.  Each shard is sorted
by external induced sorting of its suffixes with common-prefix values
(``op3_induced``), which tells the windows that occur again.

Defined results: a null text counts as empty; texts shorter than the window
lose nothing; a text that occurs in more than one row, and is as long as the
window, is removed whole from each; ids play no part in the decision, so
null or repeated ids are as good as others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .op1_jaccard import mix
from .op3_induced import repeats

WINDOW, GRAM, SIDE = 400, 50, 225
#: Bytes of pieces in a shard, about, and bytes of a text looked at together.
SHARD, CHUNK = 2_000_000, 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, x in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def anchors(data: bytes, window: int = WINDOW, gram: int = GRAM, side: int = SIDE):
    """Per anchor: first and last window start, anchor position, anchor hash, and two keys (0: none).

    The first key is of the ``side`` bytes that end with the anchor, the
    second of those that start with it; a window holds one of the two.
    """
    out = []
    for at in range(0, max(len(data) - window + 1, 0), CHUNK):
        part = data[at:at + CHUNK + window - 1]
        n = len(part)
        up, down = powers(n + 1)
        x = np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(x * up[:n], out=total[1:])

        def hashed(start, size, total=total, down=down):
            return mix((total[start + size] - total[start]) * down[start])

        grams = mix((total[gram:] - total[:-gram]) * down[:n - gram + 1])
        best = (grams & ~np.uint64(0xFFFFFF)) | np.arange(n - gram + 1, dtype=np.uint64)
        wide, width = window - gram + 1, 1
        while 2 * width <= wide:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        count = n - window + 1
        q = (np.minimum(best[:count], best[wide - width:wide - width + count]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        last = np.r_[first[1:], count] - 1
        q = q[first]
        left, right = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
        reach = side - gram  # a window that starts so far before its anchor holds the left side
        some = first <= q - reach
        left[some] = hashed(q[some] + gram - side, side) | np.uint64(1)
        some = last > q - reach
        right[some] = hashed(q[some], side) | np.uint64(1)
        right[some] ^= np.uint64(0xA5A5A5A5A5A5A5A4)
        out.append((first + at, last + at, q + at, grams[q], left, right))
    if not out:
        none, key = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return none, none, none, key, key, key
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _text_key():
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def keys(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, n_bytes, sha, left, right): every row's size, hash and anchors' keys."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, left, right = [], [], [], []
            for t in b.column("text").to_pylist():
                data = (t or "").encode()
                got = anchors(data)
                n.append(len(data)), sha.append(hashlib.sha256(data).hexdigest())
                left.append(got[4].view(np.int64)), right.append(got[5].view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                                              pa.array(left, longs), pa.array(right, longs)], names=["doc_id", "tkey", "n_bytes", "sha", "left", "right"])

    return (docs.select(F.col("doc_id").cast("long"), _text_key().alias("tkey"), "text")
            .mapInArrow(rows, "doc_id long, tkey binary, n_bytes long, sha string, left array<long>, right array<long>"))


def candidates(distinct: DataFrame) -> DataFrame:
    """(tkey, picked): the numbers of each distinct text's anchors with a key that occurs twice or more."""
    sides = [distinct.select("tkey", F.posexplode(s).alias("k", "key")) for s in ("left", "right")]
    every = sides[0].unionByName(sides[1]).filter("key <> 0")
    often = cut(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    return every.join(often, "key").groupBy("tkey").agg(F.collect_set("k").alias("picked"))  # bounded by one text's anchors


def pieces(texts: DataFrame) -> DataFrame:
    """(tkey, start, windows, anchor, q, sid, piece): the picked anchors' pieces of ``texts(tkey, text, picked)``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t, picked in zip(b.column("tkey").to_pylist(), b.column("text").to_pylist(), b.column("picked").to_pylist(), strict=True):
                data = t.encode()
                first, last, q, anchor, _, _ = (x[sorted(picked)] for x in anchors(data))
                out = [data[s:e + WINDOW] for s, e in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(out), pa.binary()), pa.array(first), pa.array((last - first + 1).astype(np.int32)), pa.array(anchor.view(np.int64)),
                     pa.array((q - first).astype(np.int32)), pa.array([xxhash.xxh3_128_digest(x) for x in out], pa.binary()), pa.array(out, pa.binary())],
                    names=["tkey", "start", "windows", "anchor", "q", "sid", "piece"])

    return texts.mapInArrow(rows, "tkey binary, start long, windows int, anchor long, q int, sid binary, piece binary")


def shards(distinct: DataFrame, total: int) -> DataFrame:
    """(sid, s, e): runs of window starts in distinct pieces that occur again in another.

    ``distinct(sid, anchor, q, windows, piece)``.  An anchor with more than a
    shard's bytes is split by the windows' offsets from the anchor: windows
    with different offsets are never equal.  One that is still too large with
    every offset by itself is dealt by a hash of the window as well, which
    equal windows share.
    """
    count = max(1, math.ceil(total / SHARD))
    heavy = distinct.groupBy("anchor").agg(F.sum(F.length("piece")).alias("bytes")).filter(F.col("bytes") > SHARD)
    reach = WINDOW - GRAM + 1
    # Cut to single windows, a piece of w bytes gives w - WINDOW + 1 windows of WINDOW bytes.
    heavy = cut(heavy.select("anchor", F.least(F.ceil(F.col("bytes") / SHARD), F.lit(reach)).cast("int").alias("ways"),
                             F.ceil(F.col("bytes") / (F.lit(float(SHARD)) * reach)).cast("long").alias("hands")))
    dealt = (distinct.join(heavy, "anchor", "left").withColumn("ways", F.coalesce("ways", F.lit(1)))
             .withColumn("hands", F.coalesce("hands", F.lit(1).cast("long"))))
    dealt = dealt.withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    step = F.ceil(F.lit(reach) / F.col("ways")).cast("int")
    # Offsets from way * step on, that is window starts from low to high.
    low = F.greatest(F.lit(0), F.col("q") - (F.col("way") + 1) * step + 1)
    high = F.least(F.col("windows") - 1, F.col("q") - F.col("way") * step)
    dealt = dealt.withColumn("low", F.when(F.col("ways") > 1, low).otherwise(0)).withColumn("high", F.when(F.col("ways") > 1, high).otherwise(F.col("windows") - 1))
    dealt = (dealt.filter("low <= high")
             .select("sid", "anchor", "way", "low", "ways", "hands", F.expr(f"substring(piece, low + 1, high - low + {WINDOW})").alias("piece"))
             .withColumn("hand", F.when(F.col("ways") == reach, F.pmod(F.xxhash64("piece"), F.col("hands"))).otherwise(0))
             .select("sid", "anchor", "way", "hand", "low", "piece"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sids, lows, sizes, parts = [], [], [], []
        for b in batches:
            got = b.column("piece").to_pylist()
            sids += b.column("sid").to_pylist()
            lows += b.column("low").to_pylist()
            sizes += map(len, got)
            parts.append(np.frombuffer(b"".join(got), np.uint8))
        if not sids:
            return
        size = np.array(sizes, np.int64)
        start = np.cumsum(size + 1) - size - 1
        text = np.zeros(int(size.sum()) + len(size), np.uint16)
        inside = np.ones(len(text), bool)
        inside[start + size] = False  # a separator ends each piece
        text[inside] = np.concatenate(parts)
        text[inside] += np.uint16(1)
        mark = repeats(text, WINDOW).astype(np.int8)
        edge = np.diff(mark, prepend=0, append=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        which = np.searchsorted(start, s, side="right") - 1
        low = np.array(lows, np.int64)[which] - start[which]
        yield pa.RecordBatch.from_arrays([pa.array([sids[k] for k in which], pa.binary()), pa.array(s + low), pa.array(e + low)], names=["sid", "s", "e"])

    return dealt.repartition(count, "anchor", "way", "hand").mapInArrow(rows, "sid binary, s long, e long")


def removed(data: bytes, starts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the windows starting in [s, e), the removed bytes and the removed runs."""
    out, at, gone, runs = [], 0, 0, 0
    end = 0
    for s, e in sorted(starts):
        stop = e - 1 + WINDOW
        if s > end or not runs:
            out.append(data[end:s])
            at, runs = s, runs + 1
        else:
            at = end
        if stop > end:
            gone += stop - max(at, end)
            end = stop
    out.append(data[end:])
    return b"".join(out), gone, runs


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = cut(keys(docs))
    distinct = cut(rows.groupBy("tkey").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.first("n_bytes").alias("n_bytes"),
                                            F.first("left").alias("left"), F.first("right").alias("right")))
    picked = cut(candidates(distinct).join(distinct.select("tkey", "low", "copies"), "tkey"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("low_"), _text_key().alias("tkey"), "text")
    texts = cut(keyed.join(picked, "tkey").filter(F.col("low_").eqNullSafe(F.col("low"))).select("tkey", "text", "picked", "copies"))
    parts = cut(pieces(texts.select("tkey", "text", "picked")))
    place = F.struct("tkey", "start")
    equal = cut(parts.groupBy("sid", "anchor", "q", "windows").agg(F.first("piece").alias("piece"), (F.min(place) != F.max(place)).alias("again")))
    total = equal.agg(F.sum(F.length("piece") + 1)).first()[0] or 0
    hits = shards(equal.select("sid", "anchor", "q", "windows", "piece"), total)
    whole = equal.filter("again").select("sid", F.lit(0).cast("long").alias("s"), F.col("windows").cast("long").alias("e"))
    places = parts.select("sid", "tkey", "start").distinct()
    runs = (places.join(hits.unionByName(whole), "sid").select("tkey", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))
            .groupBy("tkey").agg(F.collect_list(F.struct("s", "e")).alias("runs")))  # bounded by one text's windows

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [removed(t.encode(), [(r["s"], r["e"]) for r in rs]) for t, rs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("tkey"), pa.array([g for _, g, _ in got], pa.int64()), pa.array([r for _, _, r in got], pa.int64()),
                                              pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in got], pa.string())], names=["tkey", "gone", "runs", "left_sha"])

    judged = (texts.filter("copies = 1").select("tkey", "text").dropDuplicates(["tkey"]).join(runs, "tkey")
              .select("tkey", "text", "runs").mapInArrow(judge, "tkey binary, gone long, runs long, left_sha string"))
    told = cut(distinct.select("tkey", "copies").join(judged, "tkey", "left"))
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    nothing = hashlib.sha256(b"").hexdigest()
    return (rows.select("doc_id", "tkey", "n_bytes", "sha").join(told, "tkey")
            .select("doc_id", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
                    F.when(all_gone, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
                    F.when(all_gone, F.lit(nothing)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256")))
