"""op1, op3 and op8 against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from conftest import SF, awkward

from pivotscore.llm import op1_jaccard, op3_induced, op3_substring, op6_mix, op8_sentences
from pivotscore.llm.common import table


def grouped(rows, threshold=0.8):
    """(id, smallest id of the class, links) by comparing all pairs."""
    words = [op1_jaccard.WORDS.findall(t or "") for _, t in rows]
    sets = [{" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    up = list(range(len(rows)))
    links = [0] * len(rows)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    low = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[top(i)] += [d] if d is not None else []
    return sorted((str(rows[i][0]), str(min(low[top(i)], default=None)), links[i]) for i in range(len(rows)))


def test_jaccard_join_of_awkward_rows(docs, no_docs):
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in op1_jaccard.classes(docs).collect())
    assert got == grouped([(r[0], r[1]) for r in awkward()])
    assert op1_jaccard.classes(no_docs).count() == 0


def test_large_buckets_are_split_and_dealt_in_blocks(spark, monkeypatch):
    """Many near copies: buckets stay above the limit to the deepest split."""
    monkeypatch.setattr(op1_jaccard, "LIMIT", 4)
    monkeypatch.setattr(op1_jaccard, "DEEPEST", 2)
    monkeypatch.setattr(op1_jaccard, "MISS", 1e-2)
    monkeypatch.setattr(op1_jaccard, "BLOCK", 7)
    monkeypatch.setattr(op1_jaccard, "COLUMNS", 50)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(24):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in op1_jaccard.classes(df).collect()) == grouped(rows)


def test_every_pair_of_the_tables_is_found(spark):
    """The whole smallest table against all pairs."""
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = op1_jaccard.classes(table(spark, SF, "documents")).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == grouped(rows)


def test_a_group_gives_its_edges_once(spark):
    """Runs after the first ones add no edge inside a group of near copies."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for d in range(80):
        w = list(base)
        w[rng.randrange(200)] = f"x{d}"
        rows.append((d, " ".join(w)))
    sets = op1_jaccard.cut(op1_jaccard.sets(spark.createDataFrame(rows, "doc_id long, text string"), 5).select("sid", "n", "sig", "mark"))
    known = sets.withColumn("grp", op1_jaccard.F.lit(7).cast("long"))
    assert op1_jaccard.found_in(known, range(2, 14), 0.8).count() == 0
    two = sets.withColumn("grp", op1_jaccard.F.when(op1_jaccard.F.col("sid") < op1_jaccard.F.lit(b"\x80"), 7).otherwise(8).cast("long"))
    assert op1_jaccard.found_in(two, range(2, 14), 0.8).count() >= 1  # the two halves belong together
    alone = known.withColumn("grp", op1_jaccard.F.lit(0).cast("long"))
    assert op1_jaccard.found_in(alone, range(2), 0.8).count() >= 79


def test_columns_of_any_name_survive(spark):
    names = ["size_", "each", "n_", "d_", "rk_", "row", "likely", "n", "place", "grp"]
    rows = [(k, f"word{k % 5} two three four five six seven", "s", *names) for k in range(20)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    kept = op1_jaccard.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 5
    assert {tuple(r)[3:] for r in kept.collect()} == {tuple(names)}
    mixed = op6_mix.repeat(df)
    assert mixed.columns == df.columns and {tuple(r)[3:] for r in mixed.collect()} == {tuple(names)}


def test_one_of_each_class_stays(docs):
    kept = op1_jaccard.keep_one(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()
    ids = collections.Counter(r.doc_id for r in kept)
    assert ids[1] == 1 and not ids[3] and not ids[4] and ids[2] == 1 and ids[9] == 1 and not ids[10]
    assert ids[5] == ids[6] == ids[7] == 1  # without words: kept


def test_induced_sorting_finds_repeats():
    rng = random.Random(1)
    for k in range(600):
        t = [rng.randint(rng.random() < 0.5, rng.choice([2, 3, 5])) for _ in range(rng.randint(0, 60))]
        t = np.array(t + t[:len(t) // 2] * (k % 3 == 0) + [2] * rng.randint(0, 9) + [0], np.uint16)
        cap = rng.randint(2, 9)
        seen = collections.defaultdict(list)
        for i in range(len(t) - cap + 1):
            if t[i:i + cap].all():
                seen[t[i:i + cap].tobytes()].append(i)
        want = sorted(i for v in seen.values() if len(v) > 1 for i in v)
        assert np.flatnonzero(op3_induced.repeats(t, cap, memory=rng.choice([0, 200, 10 ** 8]))).tolist() == want


def removed(texts, w=400):
    count = collections.Counter(b[i:i + w] for b in texts for i in range(len(b) - w + 1))
    for b in texts:
        mark = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - w + 1):
            if count[b[i:i + w]] > 1:
                mark[i] += 1
                mark[i + w] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        yield len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(rest).hexdigest()


def test_substring_dedup_of_awkward_rows(docs, no_docs, monkeypatch):
    monkeypatch.setattr(op3_substring, "CHUNK", 20000)
    texts = [(str(r[0]), (r[1] or "").encode()) for r in awkward()]
    want = sorted((d, *x) for (d, _), x in zip(texts, removed([b for _, b in texts]), strict=True))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_substring.dedup(docs).collect())
    assert got == want
    assert op3_substring.dedup(no_docs).count() == 0


@pytest.mark.parametrize("shard", [3000, 60])
def test_heavy_anchors_are_split_by_offset(spark, monkeypatch, shard):
    """One passage in many texts, with shards smaller than its anchors' pieces, or even than one offset's windows."""
    monkeypatch.setattr(op3_substring, "SHARD", shard)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(700)
    rows = [(d, word(rng.randint(0, 900)) + passage[rng.randint(0, 80):700 - rng.randint(0, 80)] + word(rng.randint(0, 500))) for d in range(30)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(removed([t.encode() for _, t in rows])))


def test_sentence_spans_of_awkward_rows(docs, no_docs):
    rows = {(str(r[0]), hashlib.md5((r[1] or "").encode()).hexdigest()): r[1] or "" for r in awkward()}
    got = {(str(r.doc_id), r.n_sentences): r for r in op8_sentences.dedup(docs).collect()}
    seen = collections.defaultdict(list)
    for (d, k), t in rows.items():
        parts = [op8_sentences.WORDS.findall(s) for s in op8_sentences.sentences(t)]
        assert "".join(op8_sentences.sentences(t)) == t
        for s, e in op8_sentences.runs(np.array([len(p) for p in parts])) if parts else []:
            seen[" ".join(sum(parts[s:e], []))].append(((d == "None", int(d) if d != "None" else 0), k, s, e))
    gone = collections.defaultdict(set)
    for v in seen.values():
        first = min(v)[:3]
        for d, k, s, e in v:
            if (d, k, s) != first:
                gone[(str(d[1]) if not d[0] else "None", k)].update(range(s, e))
    # A copy's first occurrence is decided by id, so the text hash used for ties does not matter here.
    for (d, k), t in rows.items():
        r = got[(d, len(op8_sentences.sentences(t)))]
        assert sorted(r.removed) == sorted(gone[(d, k)]), d
        assert r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert op8_sentences.dedup(no_docs).count() == 0


def test_a_repeated_passage_goes_whole():
    words = np.array([4, 30, 26, 3, 8])
    found = op8_sentences.runs(words)
    assert (1, 3) in found  # two long sentences make a run
    assert all(e - s >= 3 or words[s:e].sum() >= op8_sentences.ENOUGH for s, e in found)


def test_a_known_group_is_compared_with_the_few_other_sets_and_not_split(spark, monkeypatch):
    monkeypatch.setattr(op1_jaccard, "LIMIT", 4)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for d in range(60):
        w = list(base)
        w[rng.randrange(200)] = f"x{d}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = op1_jaccard.sets(df, 5).selectExpr("doc_id", "sid", "n", "sig", "mark", "if(doc_id < 59, 7L, 0L) as grp").localCheckpoint()
    splits = []
    real = op1_jaccard.split
    monkeypatch.setattr(op1_jaccard, "split", lambda nodes, runs=None: (runs is None and splits.append(1), real(nodes, runs))[1])
    got = op1_jaccard.found_in(known, range(4), 0.8).collect()
    stranger = known.filter("grp = 0").first()["sid"]
    assert got and all(stranger in (r.a, r.b) for r in got)
    assert not splits
