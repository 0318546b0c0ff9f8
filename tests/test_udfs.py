"""Arrow UDF metrics against brute force."""

import pytest

from pivotscore.functions import pvalues
from pivotscore.operators import ter


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


@pytest.mark.parametrize("h,r", [("a b c d", "a x c d e"), ("", "a b"), ("a b", ""), ("x y z", "z y x"),
                                 ("the cat the cat", "The cat sat on the mat")])
def test_word_edits_match_dp(h, r):
    e, n = ter.word_edits(h, r)
    assert e == lev(h.lower().split(), r.lower().split()) and n == len(r.split())


def test_ter_shift_is_one_edit():
    # moving a block costs one shift instead of two substitutions
    e, n = ter.ter_edits("b c a", "a b c")
    assert e == 1 and n == 3
    assert ter.ter_edits("a b c", "a b c") == (0, 3)


def test_ter_never_exceeds_word_edits():
    for h, r in [("d e a b c", "a b c d e"), ("one two three four", "four three two one")]:
        assert ter.ter_edits(h, r)[0] <= ter.word_edits(h, r)[0]


def test_f_pvalue_closed_form():
    # F(2, 2): P(F > f) = 1 / (1 + f)
    for f in (0.5, 1.0, 3.0, 63.76):
        assert pvalues.f_sf(f, 2, 2) == pytest.approx(1 / (1 + f), rel=1e-10)


def test_f_pvalue_small_tail_does_not_underflow():
    p = pvalues.f_sf(646.37, 1, 538)
    assert 0 < p < 1e-80


def test_r_pvalue():
    assert pvalues.r_sf(0.0, 10) == pytest.approx(1.0)
    # t = r*sqrt(n-2)/sqrt(1-r^2); for n = 4, p(r) = 1 - |r| ... closed form for df = 2
    r = 0.6
    t = r * (2 ** 0.5) / (1 - r * r) ** 0.5
    assert pvalues.r_sf(r, 4) == pytest.approx(1 - t / (2 + t * t) ** 0.5, rel=1e-9)


@pytest.mark.parametrize("h,r,edits", [
    ("b a c d e f g h j i", "a b c d e f g h i j", 2), ("b a c d f e g h j i", "a b c d e f g h i j", 3),
    ("a b c g h d e f", "a b c d e f g h", 1), ("d e f a b c g", "a b c d e f g", 1), ("x", "a b", 2)])
def test_each_shift_costs_one_edit(h, r, edits):
    assert ter.ter_edits(h, r)[0] == edits


def test_ter_is_at_least_the_cheapest_shift_sequence():
    """Greedy search against all sequences of block moves, on short texts."""
    import itertools
    import random

    def moves(w):
        for i in range(len(w)):
            for n in range(1, len(w) - i + 1):
                rest, block = w[:i] + w[i + n:], w[i:i + n]
                for k in range(len(rest) + 1):
                    yield rest[:k] + block + rest[k:]

    rng = random.Random(3)
    for _ in range(25):
        r = [rng.choice("abcde") for _ in range(5)]
        h = [rng.choice("abcde") for _ in range(5)]
        best, level = lev(h, r), {tuple(h)}
        for shifts in (1, 2):
            level = set(itertools.chain.from_iterable(map(tuple, moves(list(w))) for w in level))
            best = min([best, *(shifts + lev(w, r) for w in level)])
        got = ter.ter_edits(" ".join(h), " ".join(r))[0]
        assert best <= got <= lev(h, r)


@pytest.mark.parametrize("d", [1e3, 1e5, 1e7, 1e9])
def test_p_value_at_large_degrees_of_freedom(d):
    assert pvalues.f_sf(1.0, d, d) == pytest.approx(0.5, abs=1e-9)


def test_p_value_that_does_not_settle_raises(monkeypatch):
    monkeypatch.setattr(pvalues, "MOST_TERMS", 3)
    with pytest.raises(ArithmeticError):
        pvalues.f_sf(1.1, 1e6, 1e6)
