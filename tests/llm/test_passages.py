"""op8 against all word windows, which know nothing of sentences."""

import collections
import random

from conftest import prose

from pivotscore.llm import op8_sentences


def uncovered(rows, w=op8_sentences.ENOUGH):
    """{id: words outside every window that occurs before}, by id and place."""
    first, out = {}, {}
    for d, t in sorted(rows):
        words = t.split()
        gone = [False] * len(words)
        for i in range(len(words) - w + 1):
            if first.setdefault(tuple(words[i:i + w]), (d, i)) != (d, i):
                gone[i:i + w] = [True] * w
        out[d] = [x for x, g in zip(words, gone, strict=True) if not g]
    return out


def inside(small, large):
    have = collections.Counter(large)
    have.subtract(small)
    return min(have.values(), default=0) >= 0


def test_passages_that_start_and_end_inside_sentences(spark):
    rng = random.Random(8)
    long_ = [f"w{k}" + "." * (k in (40, 75)) for k in range(110)]  # one whole sentence of 35 words
    bare = [f"v{k}" for k in range(69)]  # none
    other = prose(9, 300).split()
    rows = [(0, " ".join(["open"] * 4 + long_ + ["shut."] + bare + ["end."] + other))]
    for d in range(1, 12):
        s, e = rng.randint(0, 20), rng.randint(90, 110)
        t = prose(100 + d, 30).split() + long_[s:e] + prose(200 + d, 20).split() + bare[d % 4:] + prose(300 + d, 30).split()
        k = rng.randint(0, 200)
        rows.append((d, " ".join(t + other[k:k + rng.choice([49, 50, 51, 90])] + ["last."])))
    want = uncovered(rows)
    assert sum(len(t.split()) - len(want[d]) for d, t in rows) > 1500
    for r in op8_sentences.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        assert inside(r.text.split(), want[r.doc_id]), r.doc_id  # every repeated window is gone
        kept = [p.split() for k, p in enumerate(op8_sentences.sentences(dict(rows)[r.doc_id])) if k not in r.removed]
        assert inside(r.text.split(), sum(kept, []))
        if r.doc_id == 0:
            assert r.text == rows[0][1]


def test_windows_alone_are_cut_exactly(spark):
    """One sentence per text: no run of whole sentences is repeated."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for d in range(20):
        a, b = sorted(rng.sample(range(400), 2))
        rows.append((d, " ".join([f"a{d}", f"b{d}", *base[a:b], *base[b // 2:b // 2 + 60], f"c{d}"])))
    got = {r.doc_id: r.text.split() for r in op8_sentences.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == uncovered(rows)


def test_hot_kinds_are_dealt_without_loss(spark):
    rows = [(k % 7 if k % 3 else 99, k) for k in range(3000)]  # a third of the rows has one key
    df = spark.createDataFrame(rows, "h long, s int")
    kinds = df.groupBy("h").count().withColumnRenamed("count", "n").filter("h <> 5")
    got = sorted(tuple(r) for r in op8_sentences.met(df, kinds.withColumn("first", kinds.h * 2), ["h"]).select("h", "s", "first").collect())
    assert got == sorted((h, s, 2 * h) for h, s in rows if h != 5)
