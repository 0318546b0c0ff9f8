"""op11, op12 and op13 against brute force, held-out labels and numpy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF

from pivotscore.llm import op11_toxicity, op12_whitening, op13_runs, queries
from pivotscore.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- periodic runs ----------------------------------------------------------- #
def all_runs(w):
    """Every run (start, length, period) of a word list, distance by distance."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def told(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def repetitive(rng):
    letters = [f"w{k}" for k in range(rng.choice([1, 2, 3, 20, 300]))]
    w = []
    while len(w) < rng.choice([1, 12, 40, 150, 400]):
        r = rng.random()
        if r < 0.4:
            w += [rng.choice(letters) for _ in range(rng.randint(1, 20))]
        elif r < 0.8:
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 30))]
            w += unit * rng.randint(1, 6) + unit[:rng.randint(0, len(unit))]
        elif w:
            at = rng.randrange(len(w))
            w += w[at:at + rng.randint(1, 40)]
    return w


def test_runs_by_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        texts = [[x.encode() for x in repetitive(rng)] for _ in range(rng.randint(1, 4))] + [[]]
        rng.shuffle(texts)
        t = op13_runs.Texts(texts)
        expected = sorted((s + at, s + at + n, q) for at, w in zip(t.start.tolist(), texts, strict=True) for s, n, q in all_runs(w))
        assert sorted(map(tuple, op13_runs.find(t).tolist())) == expected


def test_transform_is_exact_beyond_one_prime():
    rng = np.random.RandomState(5)
    blocks = rng.randint(0, 40_000, (3, 8))
    windows = rng.randint(0, 40_000, (3, 23))
    windows[0, 4:12], windows[2, 15:23] = blocks[0], blocks[2]
    windows[1, 3:11] = blocks[1]
    windows[1, 5] += 1
    expected = np.array([[(windows[r, k:k + 8] == blocks[r]).all() for k in range(16)] for r in range(3)])
    assert (op13_runs.zero_mismatch(blocks, windows, 40_000) == expected).all() and expected.sum() == 2
    with pytest.raises(ValueError):
        op13_runs.zero_mismatch(blocks, windows, 10 ** 14)


def test_long_uniform_text():
    t = op13_runs.Texts([[b"a"] * 60_000, [b"a"] * 11, [b"b"] * 12])
    assert op13_runs.find(t).tolist() == [[0, 60_000, 1], [60_011, 60_023, 1]]


@pytest.mark.parametrize("source", ["awkward", "table"])
def test_run_columns(spark, docs, source):
    rows = docs if source == "awkward" else table(spark, SF, "documents")
    got = op13_runs.detect(rows).drop("runs").collect()
    texts = [(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()]
    # The brute force is quadratic; the awkward rows' one text of 60,000 words has no repeats of its own.
    small = [x for x in texts if len(x[1] or "") < 60_000]
    long = {x[0] for x in texts} - {x[0] for x in small}
    key = lambda r: tuple("" if c is None else str(c) for c in r)
    assert sorted((tuple(r) for r in got if r["doc_id"] not in long), key=key) == sorted((told(*x) for x in small), key=key)
    assert len(got) == len(texts)


def test_runs_of_no_rows(spark, no_docs):
    assert op13_runs.detect(no_docs).count() == 0


def test_runs_of_made_rows(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(repetitive(rng)) + rng.choice(["", "\x0b\x0cx\r\n", " y z"])) for k in range(120)]
    got = op13_runs.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.drop("runs").collect()) == sorted(told(*r) for r in rows)
    for r in got.select("start", "runs", "n_runs").collect():
        assert len(r["runs"]) == r["n_runs"] and (r["start"] is None) == (not r["runs"])


# ---- toxicity ---------------------------------------------------------------- #
def maximal(score):
    """Maximal scoring segments by their recursive definition: the best one, then left and right of it."""
    best = None
    for i in range(len(score)):
        for j in range(i + 1, len(score) + 1):
            total = sum(score[i:j])
            if total > 0 and (best is None or total > best[2] or (total == best[2] and j - i < best[1] - best[0])):
                best = (i, j, total)
    if best is None:
        return []
    i, j, _ = best
    right = [(a + j, b + j, t) for a, b, t in maximal(score[j:])]
    return [*maximal(score[:i]), best, *right]


def test_segments_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        # Powers of two apart, so that sums are exact and ties are rare but whole.
        score = [rng.choice([-1, 1]) * rng.randint(1, 2 ** 20) / 1024 for _ in range(rng.randint(0, 14))]
        assert op11_toxicity.segments(np.array(score, float)) == maximal(score)


def test_prior_goes_back_to_stems():
    counts = [("to*", 40, 10), ("tox*", 40, 2), ("toxic", 30, 0), ("toast", 0, 8), ("and", 500, 4500)]
    m = op11_toxicity.odds(counts, 1000, 9000)
    assert m.known["toxic"] > m.known["toxin"] > m.known["topaz"] > m.known["and"]
    assert m.known["unseen"] == -op11_toxicity.DRIFT and m.known["toxin"] == m.odds["tox*"] - op11_toxicity.DRIFT
    base = np.log(0.1 / 0.9)
    rate = (40 + 20 * 0.1) / (50 + 20)
    assert m.odds["to*"] == pytest.approx(np.log(rate / (1 - rate)) - base)


def test_law_finds_its_parameters():
    rng = np.random.RandomState(3)
    n = rng.randint(20, 5000, 20_000)
    best = (np.log(0.03 * n) - np.log(-np.log(rng.rand(len(n))))) / 1.4
    got = op11_toxicity.law(best, n)
    assert got.rate == pytest.approx(1.4, rel=0.2)  # the upper twentieth is set aside
    assert op11_toxicity.law(best[:5], n[:5]).rate == 1.0


def marked(seed, rows):
    """Documents in two languages of made-up words, some with words of a bad stem."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdegilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    docs, labels = [], []
    for k in range(rows):
        bad = rng.random() < 0.2
        w = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        for _ in range(max(3, len(w) // 40) if bad else 0):
            w[rng.randrange(len(w))] = "zwark" + rng.choice(["", "en", "ish", "ly", "s", "0", "est"])
        docs.append((k, " ".join(w), "en"))
        labels.append((k, 1, int(bad)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = marked(6, 900)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = op11_toxicity.train(frame, marks)
    got = {r["doc_id"]: r for r in op11_toxicity.score(frame, model).collect()}
    assert len(got) == len(docs)
    wrong = 0
    for (k, text, _), (_, _, toxic) in zip(docs, labels, strict=True):
        r = got[k]
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"]:
            wrong += r["predicted"] != toxic
        for p in r["passages"]:
            assert "zwark" in text[p["start"]:p["end"]] and p["expected"] <= op11_toxicity.EXPECT
    assert wrong <= 5  # of about 225

    # The labels of the held-out quarter, languages and ids are no inputs.
    turned = [(k, q, t if zlib.crc32(str(k).encode()) % 4 != 2 else 1 - t) for k, q, t in labels]
    again = op11_toxicity.train(frame.drop("lang"), spark.createDataFrame(turned, marks.schema))
    assert again.odds == model.odds and (again.weights == model.weights).all()


def test_toxicity_of_awkward_rows(spark, docs, no_docs):
    some = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 0, 0), (4, 0, 1), (4, 0, 0), (5, 1, 1), (9, 1, 0), (None, 1, 1), (6, 1, None)],
                                 "doc_id long, quality int, toxic int")
    model = op11_toxicity.train(docs, some)
    got = op11_toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (5, 6, 7)}
    assert len(empty) == 1 and all(r["n_passages"] == 0 for r in got if r["doc_id"] in (5, 6, 7))
    assert op11_toxicity.score(no_docs, model).count() == 0
    for none in (some.filter("toxic = 1"), some.limit(0)):
        assert op11_toxicity.train(docs, none) is None
    assert op11_toxicity.train(no_docs, some) is None
    assert {r["score"] for r in op11_toxicity.score(docs, None).collect()} == {0.0}


def test_passages_are_whole_characters():
    model = op11_toxicity.odds([("bad", 50, 0), ("good", 50, 450)], 100, 900)
    model.law, model.weights = op11_toxicity.Law(1.0, 0.01), np.zeros(4)
    text = "İİ good bad. BAD İ good"  # the dotted capital is two characters in lower case
    _, passages = op11_toxicity.summary(model, text)
    (span,) = op11_toxicity.places(text, passages)
    assert text[span["start"]:span["end"]] == "bad. BAD"


# ---- whitening --------------------------------------------------------------- #
def by_numpy(rows):
    """{vec_id: (deviation, |projections|)}, n and explained shares from the definition."""
    fine = [(k, v) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in fine], float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(16, len(e))
    return {i: (int(((n * r - s) ** 2).sum()), ((r - s / n) @ q[:, :k]) / np.sqrt(e[:k])) for (i, _), r in zip(fine, x, strict=True)}, n, e[:k] / e.sum()


def compare_whitening(got, rows):
    expected, n, share = by_numpy(rows)
    table_ = {}
    for r in got:
        table_.setdefault(r["vec_id"], {})[r["component"]] = r
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-6)
    assert set(table_) == set(expected) and len(got) == len(share) * len(expected)
    mine = np.array([[table_[k][c + 1]["whitened"] for c in range(len(share))] for k in expected])
    theirs = np.array([w for _, w in expected.values()])
    sign = np.sign((mine * theirs).sum(0))
    assert np.abs(mine * sign - theirs).max() < 1e-6
    assert all(table_[k][1]["deviation"] == d for k, (d, _) in expected.items())


def test_whitening_of_a_table(spark):
    vectors = table(spark, SF, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    compare_whitening(op12_whitening.whiten(vectors).collect(), rows)
    assert queries.QUERIES["op12_block_whitening"](spark, SF).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(op12_whitening, "BLOCK_BYTES", 512)
    monkeypatch.setattr(op12_whitening, "BLOCKS", 3)
    monkeypatch.setattr(op12_whitening, "HOT", 10)
    rng = np.random.RandomState(8)
    rows = [(k, (rng.randn(5) * [5, 3, 2, 1, 0.5]).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)]  # a vector of two rows in five
    rows += [(2000, None), (2001, [1.0, None, 2.0, 0.0, 0.0]), (2002, [float("nan")] * 5), (2003, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
             (2004, []), (2005, [1.0, 2.0]), (2006, [1e300, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, key string, n int").repartition(5)
    compare_whitening(op12_whitening.whiten(frame).collect(), [r for r in rows if r[0] < 2000])


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    got = op12_whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (None, [0.5, 1.0])], schema)).collect()
    assert len(got) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, 0.0, 0.0, 0.0)}
    line = op12_whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], schema)).collect()
    assert all(r["whitened"] == 0.0 for r in line if r["component"] == 2) and line[0]["identity_error"] < 1e-9
    for rows in ([], [(1, None), (2, [])]):
        assert op12_whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    far = op12_whitening.whiten(spark.createDataFrame([(1, [3e10]), (2, [-3e10])], schema)).collect()
    assert {r["deviation"] for r in far} == {None}
