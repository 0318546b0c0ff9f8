"""Edit rates against plain definitions, and their queries."""

import math
import random
import time

import numpy as np
import pytest
from conftest import SF

from pivotscore import registry
from pivotscore.operators import ter


def table(h, r):
    """Full or banded distance table {(i, j): distance} of two word lists."""
    n, m = len(h), len(r)
    ratio = m / n if n else 1
    beam = math.ceil(ratio / 2 + ter.BEAM) if ratio / 2 > ter.BEAM else ter.BEAM
    d = {(0, j): j for j in range(m + 1)}
    for i in range(1, n + 1):
        middle = math.floor(i * ratio)
        for j in range(max(0, middle - beam), m + 1 if i == n else min(m + 1, middle + beam)):
            ways = [(i - 1, j, 1), (i, j - 1, 1)] + ([(i - 1, j - 1, h[i - 1] != r[j - 1])] if j else [])
            d[i, j] = min(d.get((a, b), math.inf) + c for a, b, c in ways)
    return d


def rate_by_definition(h, r):
    """Moves plus edits, every move tried on whole lists with a whole table each."""
    if not r or not h:
        return len(h) + len(r)
    shifts = looked = 0
    while True:
        d = table(h, r)
        left = d[len(h), len(r)]
        i, j, at, good_h, good_r = len(h), len(r), {}, set(), set()
        while i or j:
            here = d[i, j]
            if i and j and d.get((i - 1, j - 1), math.inf) + (h[i - 1] != r[j - 1]) == here:
                i, j = i - 1, j - 1
                at[j] = i
                if h[i] == r[j]:
                    good_h.add(i)
                    good_r.add(j)
            elif i and d.get((i - 1, j), math.inf) + 1 == here:
                i -= 1
            else:
                j -= 1
                at[j] = i - 1
        best = None
        for s in range(len(h)):
            for t in range(max(0, s - ter.MAX_DIST), min(len(r), s + ter.MAX_DIST + 1)):
                for n in range(1, ter.MAX_SIZE + 1):
                    if s + n > len(h) or t + n > len(r) or h[s:s + n] != r[t:t + n]:
                        break
                    if good_h.issuperset(range(s, s + n)) or good_r.issuperset(range(t, t + n)) or s <= at[t] < s + n:
                        continue
                    last = None
                    for k in range(t - 1, t + n):
                        to = 0 if k < 0 else at[k] + 1
                        if to == last:
                            continue
                        last = to
                        looked += 1
                        rest = h[:s] + h[s + n:]
                        p = to - n if to > s + n else to
                        new = rest[:p] + h[s:s + n] + rest[p:]
                        got = (table(new, r)[len(h), len(r)], -n, s, to)
                        if best is None or got < best[0]:
                            best = (got, new)
                    if looked >= ter.MAX_MOVES:
                        return shifts + left
        if best is None or best[0][0] >= left:
            return shifts + left
        h = best[1]
        shifts += 1


def pair(rng, longest):
    r = [rng.choice("abcdefghij"[:rng.randint(1, 10)]) for _ in range(rng.randint(0, longest))]
    h = list(r)
    for _ in range(rng.randint(0, 4)):
        k = rng.random()
        if k < 0.5 and len(h) > 2:
            s, n = rng.randrange(len(h)), rng.randint(1, 4)
            block, h = h[s:s + n], h[:s] + h[s + n:]
            to = rng.randint(0, len(h))
            h = h[:to] + block + h[to:]
        elif k < 0.7 and h:
            h[rng.randrange(len(h))] = "x"
        elif k < 0.85:
            h.insert(rng.randint(0, len(h)), rng.choice("abz"))
        elif h:
            del h[rng.randrange(len(h))]
    return h, r


def test_edit_distance_by_table():
    rng = random.Random(1)
    for _ in range(300):
        h, r = pair(rng, 90)
        d = {}
        for i in range(len(h) + 1):
            for j in range(len(r) + 1):
                d[i, j] = max(i, j) if not i or not j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (h[i - 1] != r[j - 1]))
        assert ter.edit_distance(*ter._ids(h, r)) == d[len(h), len(r)]


@pytest.mark.parametrize("beam,size,dist,most", [(25, 10, 50, 1000), (3, 3, 4, 1000), (25, 10, 50, 25)])
def test_rate_by_definition(monkeypatch, beam, size, dist, most):
    for name, value in zip(("BEAM", "MAX_SIZE", "MAX_DIST", "MAX_MOVES"), (beam, size, dist, most), strict=True):
        monkeypatch.setattr(ter, name, value)
    rng = random.Random(beam + most)
    for _ in range(120):
        h, r = pair(rng, 14)
        assert ter.ter_edits_ids(*ter._ids(h, r)) == rate_by_definition(h, r), (h, r)


def test_a_move_is_one_edit_and_identity_none():
    words = [f"w{k}" for k in range(300)]
    assert ter.ter_edits(" ".join(words[5:9] + words[:5] + words[9:]), " ".join(words)) == (1, 300)
    assert ter.ter_edits("A b C", "a B c") == (0, 3)
    assert ter.ter_edits(None, "") == (0, 0) and ter.ter_edits("a b", None) == (2, 0) and ter.ter_edits("", "a b") == (2, 2)


def test_long_pairs_take_seconds():
    rng = random.Random(3)
    ref = [f"w{rng.randint(0, 3000)}" for _ in range(5000)]
    hyp = list(ref)
    for _ in range(8):  # few wrong places, each moved a little
        s = rng.randrange(4900)
        hyp[s:s + 12] = hyp[s + 5:s + 12] + hyp[s:s + 5]
    t = time.time()
    assert 8 <= ter.ter_edits(" ".join(hyp), " ".join(ref))[0] <= 16
    assert ter.ter_edits(" ".join(rng.sample(hyp, 5000)), " ".join(ref))[0] > 4000
    assert time.time() - t < 60


def test_corpus_rate_is_of_sums(spark):
    rows = [("x", "a b c d", "a b c d"), ("x", "a b", "b a"), ("y", None, "z"), ("y", "", ""), ("z", None, None)]
    got = {r["k"]: r["ter"] for r in ter.corpus_ter(spark.createDataFrame(rows, "k string, ref string, hyp string"), "ref", "hyp", ["k"]).collect()}
    assert got == {"x": round(100 / 6, 4), "y": 100.0, "z": 0.0}


def test_query_is_the_sum_over_whole_turns(spark):
    from pivotscore.sources import tables
    got = {r["role"]: r["ter"] for r in registry.QUERIES["corpus_ter"](spark, SF).collect()}
    pairs = tables.conversation_pairs(spark, SF).collect()
    for role in got:
        parts = np.array([ter.ter_edits(p["candidate"], p["original"]) for p in pairs if p["role"] == role]).sum(0)
        assert got[role] == pytest.approx(100 * parts[0] / parts[1], abs=1e-4)


def test_moves_are_evaluated_without_padded_copies(monkeypatch):
    """Distances of several orders by the rows on either side are those of each order by itself."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(np, "pad", None)
    for n, m in [(3, 3), (12, 40), (40, 12), (2, 90), (60, 61)]:
        h, r = rng.integers(0, 6, n), rng.integers(0, 6, m)
        band = ter.Band(n, r)
        orders = [h] + [ter.moved(h, int(s), 1, int(t)) for s, t in zip(rng.integers(0, n, 9), rng.integers(0, n, 9), strict=True)]
        got = ter.distances(band, band.front(h), band.back(h), h, orders)
        assert got.tolist() == [int(band.front(o)[-1, m - band.low[-1]]) for o in orders]
