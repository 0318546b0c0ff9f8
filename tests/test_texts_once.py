"""Bounded fan-outs are broadcast, and protocols ask each text once and weigh it by its rows."""

import pytest
from pyspark.sql import functions as F

from pivotscore.operators import quality, scoring, similar
from pivotscore.plans import audit
from pivotscore.plans import protocols as P
from pivotscore.sources.cache_store import CacheStore

TEXT = "Vivid quick kings zoom over nine brown foxes"
ROWS = [("d1", "1:0", TEXT), ("d1", "2:0", TEXT), ("d2", "3:0", TEXT), ("d2", "4:0", "My queen said very many words before breakfast"),
        (None, "5:0", "Damn good basic Greek music"), ("d2", "6:0", "one"), ("d2", "6:0", "twice the same id")]


@pytest.fixture
def given(spark):
    return (spark.createDataFrame(ROWS, "domain string, sent_id string, text string").repartition(3),
            spark.createDataFrame([("f", "aa", 1), ("f", "bb", 3)], "family string, language string, code int"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def near(df, other, keys):
    def rows(d):
        return {tuple(str(r[k]) for k in keys): {c: r[c] for c in d.columns if c not in keys} for r in d.collect()}

    got, want = rows(df), rows(other)
    assert got.keys() == want.keys() and got
    for k, values in want.items():
        assert got[k] == pytest.approx(values, abs=1e-9)


def test_bounded_dimensions_are_broadcast(spark, given):
    s, langs = given
    small = langs.join(langs.select("code"), "code")  # no estimate of its own
    got = P.fan(s, small, spark.createDataFrame([("x",)], "b string"), P.backends_frame(spark, ["alpha", "beta"]))
    assert "CartesianProduct" not in plan(got) and got.count() == len(ROWS) * 2 * 2
    assert P.backends_frame(spark, []).count() == 0


def test_reports_weigh_texts_by_their_rows(spark, given):
    s, langs = given
    bt = P.back_translate(s, langs, ["alpha", "beta"], CacheStore.fresh(spark))
    originals = s.select("sent_id", F.col("text").alias("original"))
    keys = ["backend", "family", "language", "domain"]
    want = scoring.aggregate_scores(scoring.score_pairs(bt.join(originals, "sent_id"), "original", "back"), keys)
    got = P.back_translation_cells(s, langs, ["alpha", "beta"], CacheStore.fresh(spark))
    near(got.withColumnRenamed("translator", "backend"), want, keys)
    assert {r.n_pairs for r in got.filter("domain = 'd1'").collect()} == {2}


def test_round_trip_weighs_texts_by_their_rows(spark, given):
    s, langs = given
    cache = CacheStore.fresh(spark)
    bt = P.back_translate(s, langs, ["alpha"], cache)
    leg = bt.select("*", F.lit("en").alias("src"), F.col("language").alias("tgt"), F.lit(None).cast("int").alias("src_code"),
                    F.col("code").alias("tgt_code"), F.col("back").alias("text"))
    third = P._step(leg, cache, ["alpha"], "third", "t", ["aa", "bb"])
    keys = ["backend", "language", "domain"]
    want = scoring.aggregate_scores(scoring.score_pairs(third, "forward", "third", encoder=False), keys, encoder=False, rounded=False)
    got = P.round_trip(s, langs, ["alpha"], CacheStore.fresh(spark), rounded=False).filter("direction = 'BAB'")
    near(got.withColumnRenamed("translator", "backend").drop("direction"), want.drop("n_pairs"), keys)


def test_replay_counts_rows_and_asks_texts_once(spark, given):
    s, langs = given
    chain = spark.createDataFrame([("o", 1, "aa", 1)], "order string, hop int, language string, code int")
    looks = audit.replay(s, langs, chain, langs, ["alpha"], CacheStore.fresh(spark))
    n = {r.protocol: (r.n_ops, r.n_hits) for r in audit.requests(looks).collect()}
    assert n == {"back_translation": (14, 0), "telephone_chain": (14, 0), "round_trip": (14, 0)}
    assert looks.filter("protocol = 'back_translation'").count() == 2 * len({t for *_, t in ROWS})


def test_word_vectors_travel_whole(spark):
    pairs = spark.createDataFrame([(1, "a b b", "b c"), (2, "a", "zz")], "i int, x string, y string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "word string, vector array<double>")
    got = scoring.word_vector_cosine(pairs, ["i"], "x", "y", vectors)
    assert not [x for x in plan(got).split("\n") if "Exchange" in x and "dim#" in x]
    assert {r.i: round(r.cosine, 6) for r in got.collect()} == {1: round(5 / 5, 6), 2: 0.0}


def test_near_duplicates_count_hashes_where_they_look_them_up(spark, monkeypatch):
    written = []
    cut = similar.cut
    monkeypatch.setattr(similar, "cut", lambda df: written.append(df.columns) or cut(df))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.rep_doc_id) for r in quality.near_dups(docs).collect()] == [(2, 1)]
    assert ["h", "c"] not in written


def test_lookups_in_directions_that_the_cache_lacks_are_not_joined(spark):
    cache = CacheStore.fresh(spark)
    entries = spark.createDataFrame([("k1", "en", "aa", "v1", "alpha"), ("k2", "aa", "en", "v2", "alpha")],
                                    "key string, src string, tgt string, value string, backend string")
    assert cache.held() == []
    cache.append(entries, 0)
    assert cache.held() == ["alpha|aa|en", "alpha|en|aa"]
    asked = spark.createDataFrame([("k1", "alpha", "en", "aa"), ("k1", "alpha", "en", "aa"), ("k2", "alpha", "aa", "en"), ("k3", "alpha", "aa", "en"),
                                   ("k4", "alpha", "en", "bb"), ("k5", "beta", "en", "aa"), ("k6", None, "en", "aa")],
                                  "key string, backend string, src string, tgt string")
    got = cache.attach(asked, held=cache.held())
    assert sorted(map(str, got.collect())) == sorted(map(str, cache.attach(asked).select(*got.columns).collect()))
    assert sum(r.cached is not None for r in got.collect()) == 3
    none = cache.attach(asked.filter("backend = 'beta'"), held=[])
    assert [r.cached for r in none.collect()] == [None]
    cache.append(spark.createDataFrame([("k7", None, None, "v7", "alpha")], entries.schema), 1)
    assert cache.held() is None  # may be of any direction


def test_cache_requests_ask_each_text_once(spark, monkeypatch):
    from pivotscore import registry
    rows = spark.createDataFrame(ROWS, "domain string, sent_id string, text string")
    monkeypatch.setattr(registry.tables, "sentences", lambda *_: rows)
    got = registry._fwd_requests(spark, "/root/testdata/sf0.001")
    texts = len({r[2] for r in ROWS})
    langs = registry.dims.pivots(spark, "/root/testdata/sf0.001").count()
    assert got.count() == texts * langs * 2
    assert got.agg({"n": "sum"}).first()[0] == len(ROWS) * langs * 2
