"""Maximal periodic runs of words by block convolution.

A run is a stretch of consecutive words with smallest period q that is at
least ``max(LEAST, 2 * q)`` words long and can't be extended.  Periods are
searched by dyadic scale: at block length B (2, 4, 8 ...) the texts are cut
into aligned blocks, and each block is looked for at the distances 2B-1 to
4B-2 (1 to 6 at the first scale).  A run with such a period always holds a
whole aligned block that comes again one period later.

The sum of squared differences between a block and every place of its window
is computed by an exact integer number-theoretic transform, modulo as many
primes as exceed the largest possible sum, so a zero is a zero-mismatch
occurrence and nothing else.  Occurrences at one distance in neighbouring
blocks are chained, and each chain seeds an extension, word by word, to the
maximal stretch of that distance.

Two things thin the convolutions without losing an occurrence: a block one of
whose word pairs doesn't come again within the window has no place there, and
a block whose window lies inside a known run of period at most B only finds
multiples of that period.

Each text is searched on its own, so there is no shuffle.  Blocks of all the
texts of an Arrow batch are transformed together, ``CELLS`` values at a time.

Defined results: a null text has no words; a text without words, or without
runs, has n_runs 0 and nulls for its longest run; a null id leaves its words
as they are; repeated rows give repeated results; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the shortest run, values transformed together, words compared at a time in an extension.
LEAST, CELLS, STEP = 12, 1 << 20, 16
#: Primes k * 2**25 + 1 or better, each with a primitive root.  Their product
#: bounds block length times vocabulary squared: no text of a table reaches it.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
_roots: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>")


# ---- exact transform -------------------------------------------------------- #
def roots(size: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The first size/2 powers of a size-th root of unity and of its inverse."""
    if (size, which) not in _roots:
        p, g = PRIMES[which]
        w = pow(g, (p - 1) // size, p)
        both = []
        for x in (w, pow(w, -1, p)):
            row = np.ones(1, np.uint64)
            while 2 * len(row) < size:
                row = np.concatenate([row, row * np.uint64(pow(x, len(row), p)) % np.uint64(p)])
            both.append(row)
        _roots[size, which] = tuple(both)
    return _roots[size, which]


def forward(a: np.ndarray, which: int) -> np.ndarray:
    """Transform of each row, in bit-reversed order; ``a`` is overwritten."""
    p = np.uint64(PRIMES[which][0])
    n = a.shape[1]
    while n > 1:
        v = a.reshape(len(a), -1, n)
        low, high = v[:, :, :n // 2], v[:, :, n // 2:]
        total, less = low + high, low + (p - high)
        np.minimum(total, total - p, out=low)  # unsigned: total - p wraps round where total < p
        np.multiply(less, roots(n, which)[0], out=less)
        np.remainder(less, p, out=high)
        n //= 2
    return a


def backward(a: np.ndarray, which: int) -> np.ndarray:
    """Inverse of ``forward``; ``a`` is overwritten."""
    p = np.uint64(PRIMES[which][0])
    n = 2
    while n <= a.shape[1]:
        v = a.reshape(len(a), -1, n)
        high = v[:, :, n // 2:] * roots(n, which)[1] % p
        low = v[:, :, :n // 2].copy()
        total, less = low + high, low + (p - high)
        np.minimum(total, total - p, out=v[:, :, :n // 2])
        np.minimum(less, less - p, out=v[:, :, n // 2:])
        n *= 2
    return a * np.uint64(pow(a.shape[1], -1, int(p))) % p


def zero_mismatch(blocks: np.ndarray, windows: np.ndarray, most: int) -> np.ndarray:
    """Marks, per block and lag, whether the block equals its window there.

    ``blocks`` (rows, B) and ``windows`` (rows, lags + B - 1) hold integers
    from 0 to ``most``.
    """
    rows, width = blocks.shape
    lags = windows.shape[1] - width + 1
    size = 1 << (windows.shape[1] - 1).bit_length()
    bound, product, out = width * most * most, 1, np.ones((rows, lags), bool)
    for which, (prime, _) in enumerate(PRIMES):
        if product > bound:
            break
        product *= prime
        p = np.uint64(prime)
        b, t = blocks.astype(np.uint64) % p, np.zeros((rows, size), np.uint64)
        t[:, :windows.shape[1]] = windows.astype(np.uint64) % p
        turned = np.zeros((rows, size), np.uint64)
        turned[:, -np.arange(width) % size] = b
        squares = np.zeros((rows, size + 1), np.uint64)
        np.cumsum(t * t % p, axis=1, out=squares[:, 1:])
        both = (b * b % p).sum(1, dtype=np.uint64)[:, None] + squares[:, width:width + lags] - squares[:, :lags]
        cross = backward(forward(turned, which) * forward(t, which) % p, which)[:, :lags]
        out &= both % p == 2 * cross % p
    if product <= bound:
        raise ValueError("a text's words exceed the exact range of the transform")
    return out


# ---- runs ------------------------------------------------------------------- #
class Texts:
    """The words of several texts in a row, as integers that no two texts share."""

    def __init__(self, texts: list[list[bytes]]):
        self.n = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(self.n)
        self.start = self.end - self.n
        codes, vocabulary = [np.zeros(0, np.int64)], []
        for t in texts:
            seen: dict[bytes, int] = {}
            codes.append(np.fromiter((seen.setdefault(w, len(seen)) for w in t), np.int64, len(t)))
            vocabulary.append(len(seen))
        self.local = np.concatenate(codes)
        self.vocabulary = np.array(vocabulary, np.int64)
        base = np.cumsum(self.vocabulary) - self.vocabulary
        self.code = self.local + np.repeat(base, self.n)
        self.total = len(self.code)

    def next_pair(self) -> np.ndarray:
        """Words from each word pair to its next occurrence (the total where there is none)."""
        out = np.full(self.total, self.total, np.int64)
        if self.total > 2:
            pair = self.code[:-1] * (int(self.code.max()) + 1) + self.code[1:]
            order = np.argsort(pair, kind="stable")
            same = np.flatnonzero(pair[order[1:]] == pair[order[:-1]])
            out[order[same]] = order[same + 1] - order[same]
        return out

    def blocks(self, width: int, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and texts of the aligned blocks with room for a place ``low`` words on."""
        some = np.flatnonzero(self.n >= max(LEAST, 2 * low, low + width))
        count = (self.n[some] - low - width) // width + 1
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(self.start[some], count) + width * k, np.repeat(some, count)


def occurrences(t: Texts, at: np.ndarray, text: np.ndarray, width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of the zero-mismatch places of the blocks ``at`` in their windows."""
    starts, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    span = high - low + width
    step = max(1, CELLS // (4 * width))
    for k in range(0, len(at), step):
        own, which = at[k:k + step], text[k:k + step]
        blocks = t.local[own[:, None] + np.arange(width)]
        place = own[:, None] + low + np.arange(span)
        windows = t.local[np.minimum(place, t.total - 1)]
        found = zero_mismatch(blocks, windows, int(t.vocabulary[which].max()))
        row, lag = np.nonzero(found)
        inside = own[row] + low + lag + width <= t.end[which[row]]
        starts.append(own[row[inside]])
        distances.append(low + lag[inside])
    return np.concatenate(starts), np.concatenate(distances)


def grow(code: np.ndarray, at: np.ndarray, distance: np.ndarray, way: int) -> np.ndarray:
    """Words by which each equality (word at, word at + distance) goes on to the right (way 1) or left (way -1)."""
    out = np.zeros(len(at), np.int64)
    live, step = np.arange(len(at)), STEP
    while len(live):
        i = at[live, None] + way * (out[live, None] + np.arange(step))
        j = i + distance[live, None]
        inside = (i >= 0) & (j < len(code))
        same = inside & (code[np.clip(i, 0, len(code) - 1)] == code[np.clip(j, 0, len(code) - 1)])
        whole = same.all(1)
        out[live] += np.where(whole, step, np.argmin(same, axis=1))
        live = live[whole]
        step = min(2 * step, max(STEP, CELLS // max(1, len(live))))
    return out


def find(t: Texts) -> np.ndarray:
    """All runs as rows (start, end, period) over the texts in a row, by start and period."""
    known = np.zeros((0, 3), np.int64)
    if not t.total:
        return known
    ahead = t.next_pair()
    covers: list[tuple[np.ndarray, np.ndarray]] = []  # per scale: the run at each word that reaches furthest, and the runs
    width = 2
    while True:
        low, high = (1 if width == 2 else 2 * width - 1), 4 * width - 2
        if 2 * low > int(t.n.max()):
            break
        at, text = t.blocks(width, low)
        misses = np.zeros(t.total + 1, np.int64)
        np.cumsum(ahead > high, out=misses[1:])
        live = misses[at + width - 1] == misses[at]
        inner = known[(known[:, 2] <= width) & (known[:, 1] - known[:, 0] >= high + width)]
        if len(inner):
            change = np.zeros(t.total + 1, np.int64)
            np.add.at(change, inner[:, 0], 1)
            np.add.at(change, inner[:, 1] - high - width + 1, -1)
            live &= np.cumsum(change)[at] == 0
        at, distance = occurrences(t, at[live], text[live], width, low, high)
        for cover, runs in covers:  # a multiple of a known run's period, inside that run
            held = cover[at]
            s, e, q = runs[held].T
            new = (held < 0) | (at < s) | (at + distance + width > e) | (distance % q != 0)
            at, distance = at[new], distance[new]
        if len(at):
            order = np.lexsort((at, distance))
            at, distance = at[order], distance[order]
            head = np.r_[True, (distance[1:] != distance[:-1]) | (at[1:] - at[:-1] != width)]
            first, last = at[head], at[np.r_[head[1:], True]] + width
            distance = distance[head]
            s = first - grow(t.code, first - 1, distance, -1)
            e = last + grow(t.code, last, distance, 1) + distance
            long = e - s >= np.maximum(LEAST, 2 * distance)
            got = np.stack([s[long], e[long], distance[long]], 1)
            got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
            got = got[np.r_[True, (got[1:, :2] != got[:-1, :2]).any(1)][:len(got)]]  # smallest period of a stretch
            if len(got):
                cover = np.full(t.total, -1, np.int64)
                for k in np.argsort(got[:, 1], kind="stable"):
                    cover[got[k, 0]:got[k, 1]] = k
                covers.append((cover, got))
                known = np.concatenate([known, got])
        width *= 2
    known = known[np.lexsort((known[:, 2], known[:, 1], known[:, 0]))]
    if len(known):
        known = known[np.r_[True, (known[1:, :2] != known[:-1, :2]).any(1)]]
        known = known[np.lexsort((known[:, 2], known[:, 0]))]
    return known


# ---- texts ------------------------------------------------------------------ #
def cyclic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the tail made periodic where the id's checksum asks for it."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def digest(words: list[bytes], runs: np.ndarray) -> tuple:
    """The result columns of one text from its runs (start, end, period) by start and period."""
    if not len(runs):
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(), []
    rows = [(s, e - s, q) for s, e, q in runs.tolist()]
    start, length, period = min(rows, key=lambda r: (-r[1], r[0], r[2]))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    collapsed = b" ".join([words[k] for k in kept.tolist()])
    return (len(rows), start, length, period, 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(collapsed).hexdigest(), [{"start": s, "length": n, "period": q} for s, n, q in rows])


def detect(docs: DataFrame, prepare=cyclic) -> DataFrame:
    """Every document's runs, digests, longest run and the runs themselves.

    ``prepare(words, doc_id)`` gives the word list that is searched.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, text = pa.int64(), pa.string()
        kinds = [longs] * 5 + [text, text, pa.list_(pa.struct([("start", longs), ("length", longs), ("period", longs)]))]
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            # Splitting bytes parts exactly at blanks and the controls from tab to carriage return.
            words = [prepare((t or "").encode().split(), d) for t, d in zip(b.column("text").to_pylist(), ids, strict=True)]
            texts = Texts(words)
            runs = find(texts)
            cuts = np.searchsorted(runs[:, 0], np.r_[texts.start, texts.total])
            out = []
            for k, w in enumerate(words):
                own = runs[cuts[k]:cuts[k + 1]] - np.array([texts.start[k], texts.start[k], 0])
                out.append(digest(w, own if len(w) else own[:0]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(ids, longs)] + [pa.array(list(c), z) for c, z in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, SCHEMA)
