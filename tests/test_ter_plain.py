"""Pairs without anything to move need no tables of arrays."""

import random

import numpy as np
from test_ter import rate_by_definition

from pivotscore.operators import ter


def lossy(rng, longest):
    r = [rng.randrange(rng.choice([4, 40])) for _ in range(rng.randint(1, longest))]
    return [x if rng.random() < 0.8 else 1000 + x for x in r if rng.random() < 0.85] or [2000], r


def test_lost_and_changed_words_build_no_band(monkeypatch):
    monkeypatch.setattr(ter, "Band", None)
    words = "the quick brown fox jumps over a lazy dog and then runs far away".split()
    assert ter.ter_edits(" ".join(words[:3] + ["vox"] + words[5:]), " ".join(words)) == (2, len(words))
    assert ter.ter_edits("a b", "c") == (2, 1)


def test_unmovable_pairs_by_definition():
    rng, known = random.Random(3), 0
    for _ in range(400):
        h, r = lossy(rng, rng.choice([6, 20, 70]))
        got = ter.unmovable(h, r)
        known += got is not None
        if got is not None:
            assert got == rate_by_definition(h, r), (h, r)
    assert known > 100


def test_unmovable_is_the_band_with_its_alignment():
    rng = random.Random(4)
    for _ in range(300):
        h, r = lossy(rng, 120)
        band, a = ter.Band(len(h), np.array(r)), np.array(h)
        front = band.front(a)
        wrong = band.alignment(front, a)[2]
        left = int(front[-1, band.m - band.low[-1]])
        assert ter.unmovable(h, r) == (None if set(a[wrong].tolist()) & set(r) else left)
