"""Edit-rate metrics as Arrow UDFs.

* ``word_edits`` -- word-level Levenshtein distance (TER without shifts),
  lower-cased whitespace tokens, bit-parallel: a column of the distance table
  is two Python integers of one bit a word, so a pair costs one handful of
  wide operations per word.
* ``ter_edits`` -- translation edit rate (Snover et al., 2006) with the limits
  of its common implementation, below: a block of the candidate that also
  stands in the reference is moved to where the alignment puts it, as long as
  a move lowers the distance; every move and every remaining edit costs one.

The shift search keeps, for the current word order, the distance table's
rows from the front and from the back.  A move changes the words between two
places only, so its distance is the front row before them, the changed words'
rows, and the back row after them; all moves of a round are evaluated side by
side.  Blocks come from an index of equal spans within ``MAX_DIST`` words,
thinned to those whose words the current alignment gets wrong.

Most pairs have nothing to move: a block is moved only if a word of it that
the alignment gets wrong stands in the reference.  Where no such word does,
``unmovable`` knows the distance from the table's front alone, in plain lists.

Corpus scores are 100 * Σ edits / Σ reference words per group, computed from
per-pair partials with a map-side aggregate.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Fixed values of the metric: words of a block, words it moves, half the width of the
# distance table's band, moves looked at in a pair (a pair that reaches it is moved no more).
MAX_SIZE = 10
MAX_DIST = 50
BEAM = 25
MAX_MOVES = 1000
# End of fixed values.

_FAR = 1 << 30


def _ids(hyp: list[str], ref: list[str]) -> tuple[np.ndarray, np.ndarray]:
    vocab: dict[str, int] = {}
    h = np.array([vocab.setdefault(w, len(vocab)) for w in hyp], dtype=np.int64)
    r = np.array([vocab.setdefault(w, len(vocab)) for w in ref], dtype=np.int64)
    return h, r


def edit_distance(h: np.ndarray, r: np.ndarray) -> int:
    """Levenshtein distance of two id sequences, a bit for each reference word (Myers, 1999)."""
    m = len(r)
    if not m:
        return len(h)
    where: dict[int, int] = {}
    for k, w in enumerate(r.tolist()):
        where[w] = where.get(w, 0) | (1 << k)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m  # vertical steps of +1 and -1
    for w in h.tolist():
        eq = where.get(w, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (mask & ~(zero | up)), up & zero
        score += bool(plus & top) - bool(minus & top)
        plus = (plus << 1) | 1
        up, down = ((minus << 1) | (mask & ~(zero | plus))) & mask, plus & zero & mask
    return score


class Band:
    """The banded distance table of one candidate order against the reference."""

    def __init__(self, n: int, ref: np.ndarray):
        self.n, self.ref, self.m = n, ref, len(ref)
        ratio = self.m / n
        beam = int(np.ceil(ratio / 2 + BEAM)) if ratio / 2 > BEAM else BEAM
        middle = np.floor(np.arange(n + 1) * ratio).astype(np.int64)
        self.low, high = np.maximum(middle - beam, 0), np.minimum(middle + beam, self.m + 1)
        self.low[0], high[n] = 0, self.m + 1
        high[0] = min(self.m + 1, max(high[0], high[1]))
        self.width = int((high - self.low).max())
        cols = self.low[:, None] + np.arange(self.width)
        self.cols, self.out = np.minimum(cols, self.m), cols >= high[:, None]
        # What several tables' steps look up: each row's reference words, cells outside, columns it lies further on.
        self.words, self.far = ref[np.maximum(self.cols - 1, 0)], np.where(self.out, _FAR, 0)
        self.on = np.diff(self.low, prepend=0)

    def _rows(self, out: np.ndarray, order: range, one: int, change: np.ndarray) -> np.ndarray:
        """Fill ``out`` row by row: each from the one before in ``order``, whose cells one column off cost ``change``."""
        width, far, k = self.width, np.int64(_FAR), np.arange(self.width)
        buffer = np.full(5 * width + 4, far)
        middle = 2 * width + 2
        sign = -one  # the step along a row: to the right in front, to the left behind
        for i, before in zip(order[1:], order, strict=False):
            buffer[middle:middle + width] = out[before]
            at = middle + int(self.low[i] - self.low[before])
            base = np.minimum(buffer[at:at + width] + 1, buffer[at + one:at + one + width] + change[i])
            base[self.out[i]] = far
            if sign > 0:
                row = np.minimum.accumulate(base - k) + k
            else:
                row = np.minimum.accumulate((base + k)[::-1])[::-1] - k
            row[self.out[i]] = far
            np.minimum(row, far, out=out[i])
        return out

    def front(self, words: np.ndarray) -> np.ndarray:
        """Distances of every prefix of the words to the prefixes of the reference in the band."""
        out = np.empty((self.n + 1, self.width), np.int64)
        out[0] = np.where(self.out[0], _FAR, np.arange(self.width))
        change = np.where(self.cols > 0, self.ref[np.maximum(self.cols - 1, 0)] != np.r_[-1, words][:, None], _FAR)
        return self._rows(out, range(self.n + 1), -1, change)

    def back(self, words: np.ndarray) -> np.ndarray:
        """Distances of every suffix of the words to the suffixes of the reference in the band."""
        out = np.empty((self.n + 1, self.width), np.int64)
        last = self.m - self.low[self.n] - np.arange(self.width)
        out[self.n] = np.where(last >= 0, last, _FAR)
        change = np.where(self.cols < self.m, self.ref[np.minimum(self.cols, self.m - 1)] != np.r_[words, -1][:, None], _FAR)
        return self._rows(out, range(self.n, -1, -1), 1, change)

    def alignment(self, front: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last candidate word at or before each reference word, and the words of either side that are wrong.

        Of equally short ways a substitution or match comes before a dropped
        candidate word, and that before an added reference word.
        """
        at, ref_wrong, hyp_wrong = np.empty(self.m, np.int64), np.ones(self.m, bool), np.ones(self.n, bool)
        i, j = self.n, self.m

        def value(a, b):
            k = b - self.low[a]
            return front[a, k] if 0 <= k < self.width else _FAR

        while i or j:
            here = value(i, j)
            if i and j and value(i - 1, j - 1) + (self.ref[j - 1] != words[i - 1]) == here:
                i, j = i - 1, j - 1
                at[j] = i
                hyp_wrong[i] = ref_wrong[j] = self.ref[j] != words[i]
            elif i and value(i - 1, j) + 1 == here:
                i -= 1
            else:
                j -= 1
                at[j] = i - 1
        return at, ref_wrong, hyp_wrong


def spans(words: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, place in the reference, length) of equal spans, by start, place and length."""
    n, m = len(words), len(ref)
    reach = np.arange(-MAX_DIST, MAX_DIST + 1)
    place = np.arange(n)[:, None] + reach
    equal = (place >= 0) & (place < m) & (ref[np.clip(place, 0, m - 1)] == words[:, None])
    length, more = equal.astype(np.int64), equal
    for k in range(1, min(MAX_SIZE, n)):
        more = more[:-1] & equal[k:]
        length[:n - k] += more
    h, o = np.nonzero(equal)
    size = length[h, o]
    start, to = np.repeat(h, size), np.repeat(h + reach[o], size)
    return start, to, np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size) + 1


def moves(words: np.ndarray, ref: np.ndarray, aligned: tuple, limit: int) -> tuple[list[tuple[int, int, int]], bool]:
    """The moves (start, length, target) worth a look, in order, and whether ``limit`` of them are reached."""
    at, ref_wrong, hyp_wrong = aligned
    start, to, length = spans(words, ref)
    wrong_h, wrong_r = np.r_[0, np.cumsum(hyp_wrong)], np.r_[0, np.cumsum(ref_wrong)]
    some = (wrong_h[start + length] > wrong_h[start]) & (wrong_r[to + length] > wrong_r[to])
    some &= (at[to] < start) | (at[to] >= start + length)
    out: list[tuple[int, int, int]] = []
    for s, t, n in zip(start[some].tolist(), to[some].tolist(), length[some].tolist(), strict=True):
        before = None
        for k in range(t - 1, t + n):
            target = 0 if k < 0 else int(at[k]) + 1
            if target != before:
                out.append((s, n, target))
                before = target
        if len(out) >= limit:
            return out, True
    return out, False


def moved(words: np.ndarray, start: int, length: int, target: int) -> np.ndarray:
    """The words with a block put before the word at ``target`` (inside the block: as much further on)."""
    rest = np.delete(words, slice(start, start + length))
    if target > start + length:
        to = target - length
    else:  # before the block, or by as many words as the target lies behind its start
        to = min(target, len(rest))
    return np.insert(rest, to, words[start:start + length])


def unmovable(h: list[int], r: list[int]) -> int | None:
    """The distance of two lists in the band (as ``Band``), None if a word that the alignment gets wrong is in the reference."""
    n, m = len(h), len(r)
    ratio = m / n
    beam = ceil(ratio / 2 + BEAM) if ratio / 2 > BEAM else BEAM
    low = [max(0, int(i * ratio) - beam) for i in range(n + 1)]
    high = [min(m + 1, int(i * ratio) + beam) for i in range(n + 1)]
    low[0], high[n] = 0, m + 1
    high[0] = min(m + 1, max(high[0], high[1]))
    rows = [list(range(high[0]))]
    for i in range(1, n + 1):
        # The row before, from one column to the left of this one's: what lies outside it is far.
        a, b, before = low[i], high[i], rows[-1]
        shift = a - low[i - 1]
        up = before[shift - 1:] if shift else [_FAR, *before]
        up += [_FAR] * (b - a + 1 - len(up))
        word, left, row = h[i - 1], _FAR, []
        if not a:
            left = min(up[1], _FAR) + 1
            row.append(left)
            a, up = 1, up[1:]
        for corner, over, other in zip(up, up[1:], r[a - 1:b - 1], strict=False):
            if other != word:
                corner += 1
            left += 1
            if over < left:
                left = over + 1
            if corner < left:
                left = corner
            row.append(left)
        rows.append(row)
    known = set(r)
    i, j = n, m
    here = distance = rows[n][m - low[n]]
    while i:
        if j:
            k = j - 1 - low[i - 1]
            corner = rows[i - 1][k] if 0 <= k < len(rows[i - 1]) else _FAR
            same = h[i - 1] == r[j - 1]
            if corner + (not same) == here:
                if not same and h[i - 1] in known:
                    return None
                i, j, here = i - 1, j - 1, corner
                continue
        k = j - low[i - 1]
        over = rows[i - 1][k] if 0 <= k < len(rows[i - 1]) else _FAR
        if over + 1 == here:
            if h[i - 1] in known:
                return None
            i, here = i - 1, over
        else:
            j, here = j - 1, here - 1
    return distance


def ter_edits_ids(h: np.ndarray, r: np.ndarray) -> int:
    """Moves plus remaining edits."""
    if not len(r) or not len(h):
        return len(h) + len(r)
    still = unmovable(h.tolist(), r.tolist())
    if still is not None:
        return still
    band = Band(len(h), r)
    words, looked, shifts = h, 0, 0
    while True:
        front = band.front(words)
        left = int(front[-1, band.m - band.low[-1]])
        if not left:
            return shifts
        found, full = moves(words, r, band.alignment(front, words), MAX_MOVES - looked)
        looked += len(found)
        if full or not found:
            return shifts + left
        order = [moved(words, *x) for x in found]
        distance = distances(band, front, band.back(words), words, order)
        # The greatest gain; then the longest block, the earliest start and the earliest target.
        best = min(range(len(found)), key=lambda k: (distance[k], -found[k][1], found[k][0], found[k][2]))
        if distance[best] >= left:
            return shifts + left
        words = order[best]
        shifts += 1


def distances(band: Band, front: np.ndarray, back: np.ndarray, words: np.ndarray, orders: list[np.ndarray]) -> np.ndarray:
    """Distances of several orders of the same words, from the rows on either side of what changed."""
    all_ = np.stack(orders)
    changed = all_ != words
    some = changed.any(1)
    first = np.where(some, changed.argmax(1), 0)
    last = np.where(some, band.n - changed[:, ::-1].argmax(1), 0)
    by = np.argsort(first - last, kind="stable")  # the longest first: who is left to go on is a prefix
    first, last, flat = first[by], last[by], all_[by].ravel()
    lengths = last - first
    # A row stands between cells that are far, on the right as many as a step may look beyond it.
    rows = np.full((len(by), band.width + 2 + int(band.on.max())), _FAR)
    rows[:, 1:band.width + 1] = front[first]
    begin, word, k, cells = np.arange(len(by)) * rows.shape[1], np.arange(len(by)) * band.n, np.arange(band.width), np.arange(band.width + 1)
    left = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    for step, live in enumerate(left.tolist()):
        at = first[:live] + step
        before = rows.ravel().take((begin[:live] + band.on.take(at + 1))[:, None] + cells)
        new = before[:, :-1] + (band.words.take(at + 1, 0) != flat.take(word[:live] + at)[:, None])
        np.minimum(new, before[:, 1:] + 1, out=new)
        far = band.far.take(at + 1, 0)
        np.maximum(new, far, out=new)
        new -= k
        np.minimum.accumulate(new, axis=1, out=new)
        new += k
        np.maximum(new, far, out=rows[:live, 1:band.width + 1])
    found = np.empty(len(by), np.int64)
    found[by] = np.minimum(rows[:, 1:band.width + 1] + back[last], _FAR).min(1)
    return found


def _words(hyp: str | None, ref: str | None) -> tuple[list[str], list[str]]:
    return (hyp or "").lower().split(), (ref or "").lower().split()


def word_edits(hyp: str | None, ref: str | None) -> tuple[int, int]:
    hw, rw = _words(hyp, ref)
    return edit_distance(*_ids(hw, rw)), len(rw)


def ter_edits(hyp: str | None, ref: str | None) -> tuple[int, int]:
    hw, rw = _words(hyp, ref)
    return (0 if hw == rw else ter_edits_ids(*_ids(hw, rw))), len(rw)


_SCHEMA = StructType([StructField("edits", LongType()), StructField("ref_words", LongType())])


@F.pandas_udf(_SCHEMA)
def word_edits_udf(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    out = [word_edits(h, r) for h, r in zip(hyp, ref)]
    return pd.DataFrame(out, columns=["edits", "ref_words"])


@F.pandas_udf(_SCHEMA)
def ter_edits_udf(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    out = [ter_edits(h, r) for h, r in zip(hyp, ref)]
    return pd.DataFrame(out, columns=["edits", "ref_words"])


def rate(edits: Column, ref_words: Column) -> Column:
    """100 * edits / reference words; without reference words 100 if there are edits, else 0."""
    return F.when(ref_words > 0, 100.0 * edits / ref_words).when(edits > 0, F.lit(100.0)).otherwise(F.lit(0.0))


def _corpus(pairs: DataFrame, ref_col: str, hyp_col: str, keys: list[str], udf, name: str) -> DataFrame:
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = pairs.repartition(n).withColumn("_e", udf(F.col(hyp_col), F.col(ref_col)))
    g = e.groupBy(*keys).agg(F.sum("_e.edits").alias("edits"), F.sum("_e.ref_words").alias("ref_words"))
    return g.select(*keys, F.round(rate(F.col("edits"), F.col("ref_words")), 4).alias(name))


def corpus_ter(pairs: DataFrame, ref_col: str, hyp_col: str, keys: list[str]) -> DataFrame:
    return _corpus(pairs, ref_col, hyp_col, keys, ter_edits_udf, "ter")


def corpus_word_edit_rate(pairs: DataFrame, ref_col: str, hyp_col: str, keys: list[str]) -> DataFrame:
    return _corpus(pairs, ref_col, hyp_col, keys, word_edits_udf, "word_edit_rate")
