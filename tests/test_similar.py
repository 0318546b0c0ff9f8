"""Near copies against all pairs, without buckets."""

import random

from conftest import SF
from pyspark.sql import functions as F

from pivotscore.operators import quality, similar


def smaller(rows):
    """{id: smallest smaller id at NEAR} by comparing all pairs."""
    sets = {}
    for d, t in rows:
        if t is not None:
            w = t.lower().split()
            sets[d] = {" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    out = {}
    for d in sets:
        for e in sorted(x for x in sets if x < d):
            both = len(sets[d] & sets[e])
            if 5 * both >= 4 * (len(sets[d]) + len(sets[e]) - both):
                out[d] = e
                break
    return out


def found(df):
    return {r.doc_id: r.rep_doc_id for r in quality.near_dups(df).collect()}


def changed(words, at):
    w = list(words)
    for k in at:
        w[k] = f"new{k}"
    return " ".join(w)


def test_partners_that_no_bucket_has_first(spark):
    """Copies of a text whose buckets hold a smaller, less similar one."""
    rng = random.Random(3)
    rows = [(1000, None), (1001, None), (1002, ""), (1003, ""), (1004, "a b"), (1005, "A b"), (1006, "a b c")]
    for g in range(40):
        w = [f"g{g}x{rng.randrange(10 ** 6)}" for _ in range(100)]
        first = changed(w, [10, 25, 40, 55])  # Jaccard 76 / 116 to w
        rows += [(5 * g, first), (5 * g + 1, " ".join(w)), (5 * g + 2, " ".join(w)), (5 * g + 3, changed(w, [70])), (5 * g + 4, changed(w, [1, 99]))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got == smaller(rows)
    assert got[2] == 1 and len(got) >= 120


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 5)
    monkeypatch.setattr(similar, "COLUMNS", 50)
    rng = random.Random(4)
    w = [f"w{k}" for k in range(120)]
    rows = [(d, changed(w, rng.sample(range(120), rng.randint(0, 5)))) for d in range(40)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == smaller(rows)


def test_near_copies_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, " ".join(r.w)) for r in docs.select("doc_id", quality.T.words(F.lower("text")).alias("w")).collect()]
    assert found(docs) == smaller(rows)


def test_members_unlike_their_groups_smallest(spark, monkeypatch):
    """Chains of edits: the smallest member of a group is too far for most, so all members are compared."""
    monkeypatch.setattr(similar, "BLOCK", 4)
    rng = random.Random(9)
    rows, d = [], 0
    for g in range(6):
        w = [f"c{g}x{k}" for k in range(100)]
        for _ in range(15):
            w = changed(w, rng.sample(range(100), rng.randint(1, 4))).split(" ")
            rows.append((d, " ".join(w)))
            d += 1
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == smaller(rows) and len(got) > 40


def test_near_copies_of_a_large_group_are_compared_once_each(spark):
    """A group whose members are all near its smallest leaves nothing for the second step."""
    rng = random.Random(10)
    w = [f"w{k}" for k in range(400)]
    texts = [" ".join(w)] + [changed(w, [rng.randrange(400)]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    h = quality.shingles(df).select(F.col("doc_id").alias("id"), F.array_distinct(F.transform("sh", lambda s: F.xxhash64(s))).alias("hs"))
    sets = similar.cut(h.dropDuplicates(["hs"]).select("id", F.size("hs").alias("n"), "hs"))
    held = similar.groups(sets, 4, 5)
    first = similar.with_smallest(held, sets, 4, 5)
    assert first.count() == sets.count() - 1 and {r.best for r in first.collect()} == {0}
    members = held.groupBy("grp").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    assert members.count() == members.select("ids").distinct().count()  # groups of the same members count once
