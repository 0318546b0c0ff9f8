"""Requests of equal texts lie together, so that their keys are stored little more than once."""

import hashlib
from collections import Counter

import pyarrow.parquet as pq

from pivotscore import registry
from pivotscore.plans import protocols as P

OWN = [f"Sentence {k} stands in one document." for k in range(30)]
SHARED = ["This line is in all of them.", "So is this one."]


def tables(spark, at):
    """Documents whose sentences mostly repeat, with a null text and an id that comes twice."""
    rows = [(k, f"{SHARED[0]} {OWN[k]}\n{SHARED[1]}", "d1") for k in range(30)]
    rows += [(30, None, "d1"), (31, "", "d2"), (32, SHARED[0], None), (32, SHARED[0], None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, "EUROPE")], "r_regionkey int, r_name string").write.parquet(f"{at}/region.parquet")
    spark.createDataFrame([(k, n, 0) for k, n in enumerate(["FRANCE", "GERMANY", "ROMANIA"])],
                          "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{at}/nation.parquet")


def wanted(names):
    sent = []
    for k in range(30):
        sent += [(f"{k}:0", SHARED[0]), (f"{k}:1", OWN[k]), (f"{k}:2", SHARED[1])]
    sent += [("32:0", SHARED[0])] * 2
    return Counter((b, "en", n, i, hashlib.md5(f"{b}|en|{n}|{t}".encode()).hexdigest()) for i, t in sent for n in names for b in registry.BACKENDS)


def test_rows_of_equal_texts_follow_one_another(spark, tmp_path):
    tables(spark, tmp_path)
    df = registry.QUERIES["request_keys"](spark, str(tmp_path))
    df.write.parquet(f"{tmp_path}/out")
    parts = [pq.read_table(f).to_pylist() for f in sorted((tmp_path / "out").glob("*.parquet"))]
    names = {r["tgt"] for p in parts for r in p}
    assert len(names) == 3
    assert Counter(tuple(r[c] for c in ("backend", "src", "tgt", "sent_id", "key")) for p in parts for r in p) == wanted(names)
    one = min(names)
    for p in parts:
        keys = [r["key"] for r in p if r["backend"] == "alpha" and r["tgt"] == one]
        assert 1 + sum(a != b for a, b in zip(keys, keys[1:])) == len(set(keys))


def test_a_frequent_text_is_dealt_over_tasks(spark):
    rows = spark.createDataFrame([("d", f"{k}:0", SHARED[0]) for k in range(400)], "domain string, sent_id string, text string").repartition(3)
    langs = spark.createDataFrame([("f", "aa", 1)], "family string, language string, code int")
    sizes = P.fan_by_text(rows, langs, ["alpha", "beta"]).rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(sizes) == 800 and max(sizes) < 400
    assert P.fan_by_text(rows.limit(0), langs, ["alpha"]).count() == 0 and P.fan_by_text(rows, langs, []).count() == 0
