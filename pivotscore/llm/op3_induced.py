"""Induced sorting of suffixes with common-prefix values, in bounded memory.

``repeats`` marks the positions of a text whose first ``cap`` symbols occur
again.  Suffixes are put in order by their first ``cap`` symbols: the
leftmost-S substrings are sorted by induction and named, the names' sequence
is sorted by renaming pairs of names (1, 2, 4 ... of them, until the names
span ``cap`` symbols), and from that order the L-type and then the S-type
suffixes are induced symbol by symbol.  Each symbol has a queue that carries
tuples of suffix and common-prefix length; a suffix that is taken from one
queue puts its predecessor into another, and the prefix length of the new
entry is one more than the least one passed since that queue's last entry.

Entries arrive in sorted order, so each priority queue is a row of first-in,
first-out blocks; blocks beyond ``MEMORY`` bytes go to an unnamed scratch
file of the task.  What stays in memory is the text (2 bytes a symbol), its
types (1), and for the leftmost-S suffixes, at most half of all, the names
(4 bytes each for every doubling, 9 at most for 400 symbols): some 30 bytes a
symbol at the worst.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of queue entries kept in memory; entries read from a queue at once.
MEMORY, BLOCK = 16_000_000, 1 << 18


class Queues:
    """One queue of (position, prefix length) per symbol, disk-backed."""

    def __init__(self, symbols: int, memory: int = MEMORY):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        size = pos.nbytes + lcp.nbytes
        if self.held + size > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # noqa: SIM115  private to this task, gone with it
            at = self.file.seek(0, 2)
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            self.blocks[symbol].append((at, len(pos), pos.dtype, lcp.dtype))
        else:
            self.held += size
            self.blocks[symbol].append((pos, lcp))

    def load(self, block: tuple, free: bool) -> tuple[np.ndarray, np.ndarray]:
        if len(block) == 2:
            if free:
                self.held -= block[0].nbytes + block[1].nbytes
            return block
        at, n, kind, width = block
        self.file.seek(at)
        return (np.frombuffer(self.file.read(n * kind.itemsize), kind), np.frombuffer(self.file.read(n * width.itemsize), width))

    def take(self, symbol: int):
        """Entries of a queue, block by block, in order of arrival; they leave the queue."""
        mine = self.blocks[symbol]
        while mine:
            batch, n = [], 0
            while mine and (not batch or n < BLOCK):
                batch.append(self.load(mine.pop(0), True))
                n += len(batch[-1][0])
            yield batch[0] if len(batch) == 1 else tuple(np.concatenate(x) for x in zip(*batch, strict=True))

    def backwards(self, symbol: int):
        """A queue's blocks from the last; they leave the queue."""
        mine = self.blocks[symbol]
        while mine:
            yield self.load(mine.pop(), True)

    def __len__(self) -> int:
        return len(self.blocks)


def least(lcp: np.ndarray, first: np.ndarray, last: np.ndarray, cap: int) -> np.ndarray:
    """Minimum of lcp[first..last] for each pair, ``cap`` where empty."""
    out = np.full(len(first), cap, np.uint16)
    width = last - first + 1
    table, k = lcp, 0
    some = width > 0
    level = np.zeros(len(width), np.int8)
    level[some] = np.log2(width[some]).astype(np.int8)
    while True:
        at = np.flatnonzero(some & (level == k))
        if len(at):
            out[at] = np.minimum(table[first[at]], table[last[at] + 1 - (1 << k)])
        k += 1
        if (1 << k) > len(lcp) or not (level >= k).any():
            return out
        half = 1 << (k - 1)
        table = np.minimum(table[:-half], table[half:])


class Sorter:
    """The induction over one text of symbols 0..255 plus a separator, which sorts first."""

    def __init__(self, text: np.ndarray, cap: int, memory: int = MEMORY):
        self.t, self.cap, self.memory = text, cap, memory
        self.n = len(text)
        self.kind = np.int32 if self.n < 2 ** 31 else np.int64
        self.symbols = int(text.max()) + 1
        # Type of a suffix: S if the next different symbol is greater; the end counts as least.
        step = np.zeros(self.n, np.int8)
        step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
        step[-1] = -1
        nonzero = np.flatnonzero(step)
        lengths = np.diff(nonzero, prepend=-1)
        self.is_s = np.repeat(step[nonzero] > 0, lengths)
        self.lms = (np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1).astype(self.kind)

    # -- one direction of the induction -------------------------------------- #
    def induce(self, queues: Queues, block: tuple, state: dict, to_s: bool) -> None:
        """Put the predecessors of a block's suffixes into their symbols' queues."""
        pos, lcp = block
        if not len(pos):
            return
        j = np.flatnonzero(pos > 0)
        j = j[self.is_s[pos[j] - 1] == to_s]
        d = self.t[pos[j] - 1]
        if to_s:  # an S-type predecessor of an S- or L-type suffix: never into a greater symbol's queue
            pass
        order = np.argsort(d, kind="stable")
        j, d = j[order], d[order]
        low, started = state["low"], state["started"]
        whole = lcp.min()
        if not len(j):
            np.minimum(low, whole, out=low)
            return
        new = (pos[j] - 1).astype(self.kind)
        heads = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        tails = np.r_[heads[1:], len(d)]
        first = np.r_[0, j[:-1] + 1]
        first[heads] = 0
        got = least(lcp, first, j, self.cap)
        got[heads] = np.minimum(got[heads], low[d[heads]])
        got = np.minimum(got + 1, self.cap).astype(np.uint16)
        fresh = heads[~started[d[heads]]]
        got[fresh] = 0
        np.minimum(low, whole, out=low)
        ends = j[tails - 1]
        low[d[heads]] = least(lcp, ends + 1, np.full(len(ends), len(lcp) - 1), self.cap)
        started[d[heads]] = True
        for s, e in zip(heads.tolist(), tails.tolist(), strict=True):
            queues.push(int(d[s]), new[s:e], got[s:e])

    def state(self) -> dict:
        return {"low": np.full(self.symbols, self.cap, np.uint16), "started": np.zeros(self.symbols, bool)}

    def common(self, a: int, b: int) -> int:
        """Common prefix of two suffixes, up to the cap."""
        x, y = self.t[a:a + self.cap], self.t[b:b + self.cap]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        return int(differ[0]) if len(differ) else m

    def pass_l(self, starts: list[tuple]) -> Queues:
        """All L-type suffixes in order, per symbol, from the leftmost-S ones (a block per symbol)."""
        open_, done, state = Queues(self.symbols, self.memory), Queues(self.symbols, self.memory), self.state()
        end = np.array([self.n - 1], self.kind)
        open_.push(int(self.t[-1]), end, np.zeros(1, np.uint16))
        state["started"][self.t[-1]] = True
        state["low"][:] = 0
        for c in range(self.symbols):
            last = None
            while open_.blocks[c]:
                for block in open_.take(c):
                    self.induce(open_, block, state, False)
                    done.push(c, *block)
                    last = int(block[0][-1])
            pos, lcp = starts[c]
            if len(pos):
                lcp = lcp.copy()
                lcp[0] = 0 if last is None else self.common(last, int(pos[0]))
                self.induce(open_, (pos, lcp), state, False)
            # The next symbol's first suffix shares nothing with this one's last.
            state["low"][:] = 0
        return done

    def pass_s(self, larger: Queues):
        """All suffixes in descending order: blocks (positions, prefix with the one before in this order, whether S)."""
        open_, state = Queues(self.symbols, self.memory), self.state()
        for c in range(self.symbols - 1, -1, -1):
            last = None
            while open_.blocks[c]:
                for block in open_.take(c):
                    self.induce(open_, block, state, True)
                    last = int(block[0][-1])
                    yield (*block, True)
            carry = None  # prefix of the last suffix taken with the next
            for pos, lcp in larger.backwards(c):
                if carry is None:
                    carry = 0 if last is None else self.common(last, int(pos[-1]))
                back = np.empty(len(lcp), np.uint16)
                back[0], back[1:] = carry, lcp[:0:-1]
                carry = int(lcp[0])
                block = (pos[::-1].copy(), back)
                self.induce(open_, block, state, True)
                yield (*block, False)
            state["low"][:] = 0

    # -- the leftmost-S suffixes ----------------------------------------------- #
    def by_symbol(self, pos: np.ndarray, lcp: np.ndarray) -> list[tuple]:
        d = self.t[pos]
        borders = np.searchsorted(d, np.arange(self.symbols + 1))
        return [(pos[s:e], lcp[s:e]) for s, e in zip(borders[:-1], borders[1:], strict=True)]

    def extend(self, a: np.ndarray, b: np.ndarray, done: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common prefixes of suffix pairs, of which ``done`` symbols are known to agree, up to ``most``."""
        done = done.copy()
        live = np.flatnonzero(done < most)
        while len(live):
            x, y = a[live] + done[live], b[live] + done[live]
            fine = (x < self.n) & (y < self.n)
            fine[fine] = self.t[x[fine]] == self.t[y[fine]]
            live = live[fine]
            done[live] += 1
            live = live[done[live] < most[live]]
        return done

    def sorted_lms(self) -> tuple[np.ndarray, np.ndarray]:
        """The leftmost-S suffixes in order with their common prefixes."""
        lms, m, cap = self.lms, len(self.lms), self.cap
        if m < 2:
            return lms, np.zeros(m, np.uint16)
        # Sort the substrings between leftmost-S positions by induction from their first symbols.
        rough = lms[np.argsort(self.t[lms], kind="stable")]
        done = self.pass_l(self.by_symbol(rough, np.zeros(m, np.uint16)))
        parts = []
        for pos, _, s in self.pass_s(done):
            if s:
                at = pos[pos > 0]
                parts.append(at[~self.is_s[at - 1]])
        order = np.concatenate(parts)[::-1] if parts else lms[:0]
        # Name them: equal substrings (up to the cap) share a name.
        index = np.searchsorted(lms, order)
        length = np.minimum(np.diff(np.r_[lms, self.n - 1]) + 1, cap).astype(np.int64)
        a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
        la, lb = length[index[:-1]], length[index[1:]]
        same = (la == lb)
        agree = self.extend(a[same], b[same], np.zeros(same.sum(), np.int64), la[same])
        same[same] = agree >= la[same]
        place = np.arange(m)
        start = np.maximum.accumulate(np.where(np.r_[True, ~same], place, 0))
        rank = np.empty(m, self.kind)
        rank[index] = start
        del order, index, start, a, b, la, lb, same, agree, place, done, parts, rough
        # Sort the sequence of names: a round names pairs of the names so far.
        ranks, width = [rank], 1
        while True:
            count = np.bincount(rank, minlength=m)
            live = np.flatnonzero(count[rank] > 1)
            if not len(live) or 2 * width > cap:  # a name spans two symbols at least
                break
            nxt = np.where(live + width < m, rank[np.minimum(live + width, m - 1)] + 1, 0)
            order2 = np.lexsort((nxt, rank[live]))
            r, x = rank[live][order2], nxt[order2]
            group = np.r_[True, r[1:] != r[:-1]]
            new = group | np.r_[True, x[1:] != x[:-1]]
            at = np.arange(len(r))
            offset = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            fresh = rank.copy()
            fresh[live[order2]] = r + offset
            del nxt, order2, r, x, group, new, at, offset
            rank, width = fresh, 2 * width
            ranks.append(rank)
        final = np.argsort(rank, kind="stable")
        # Common prefixes: skip equal names from the widest, then compare symbols.
        x, y = final[:-1].copy(), final[1:].copy()
        x0, y0 = lms[x].astype(np.int64), lms[y].astype(np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            inside = (x < m) & (y < m)
            eq = inside.copy()
            eq[inside] = ranks[k][x[inside]] == ranks[k][y[inside]]
            x[eq] += 1 << k
            y[eq] += 1 << k
        starts = np.r_[lms, self.n - 1].astype(np.int64)
        known = np.minimum(np.minimum(starts[np.minimum(x, m)] - x0, starts[np.minimum(y, m)] - y0), cap)
        lcp = self.extend(x0, y0, known, np.full(m - 1, cap, np.int64))
        return lms[final], np.r_[0, lcp].astype(np.uint16)

    def blocks(self):
        """All suffixes in descending order by their first ``cap`` symbols."""
        pos, lcp = self.sorted_lms()
        yield from self.pass_s(self.pass_l(self.by_symbol(pos, lcp)))


def repeats(text: np.ndarray, cap: int, memory: int = MEMORY) -> np.ndarray:
    """Marks of the positions whose next ``cap`` symbols start at another position too.

    Symbol 0 separates parts: strings across it do not count.
    """
    mark = np.zeros(len(text), bool)
    if len(text) < 2:
        return mark
    before = None
    for pos, lcp, _ in Sorter(text, cap, memory).blocks():
        hit = np.flatnonzero(lcp >= cap)
        mark[pos[hit]] = True
        mark[pos[hit[hit > 0] - 1]] = True
        if len(hit) and hit[0] == 0 and before is not None:
            mark[before] = True
        before = int(pos[-1])
    separators = np.flatnonzero(text == 0)
    nearest = np.searchsorted(separators, np.flatnonzero(mark))
    where = np.flatnonzero(mark)
    stop = np.r_[separators, len(text)][nearest]
    mark[where[stop - where < cap]] = False
    return mark
