"""Protocol invariants on the smallest tables (one backend pair, whole tables)."""

from pyspark.sql import functions as F

from pivotscore import dims
from pivotscore.plans import protocols as P
from pivotscore.sources import tables
from pivotscore.sources.cache_store import CacheStore

from conftest import SF


def test_identity_round_trip_is_perfect(spark):
    s = tables.sentences(spark, SF)
    rt = P.round_trip(s, dims.round_trip_languages(spark, SF), ["identity"], CacheStore.fresh(spark))
    vals = rt.agg(F.min("bleu"), F.min("cosine")).collect()[0]
    assert vals[0] == 100.0 and vals[1] == 1.0


def test_chain_hop_zero_baseline_and_hop_one_equals_back_translation(spark):
    s = tables.sentences(spark, SF)
    cache = CacheStore.fresh(spark)
    ch = P.telephone_chain(s, dims.chain_dim(spark, SF), ["alpha"], cache)
    base = ch.filter("hop = 0").collect()
    assert base and all(r["bleu"] == 100.0 and r["cosine"] == 1.0 and r["lang_code"] == "en" for r in base)
    first = dims.chain_dim(spark, SF).filter("`order` = 'linguistic' AND hop = 1")
    bt = P.back_translation_cells(s, dims.pivots(spark, SF).join(first.select("language"), "language"),
                                  ["alpha"], cache)
    hop1 = ch.filter("`order` = 'linguistic' AND hop = 1").select("domain", "bleu", "cosine")
    assert sorted(hop1.collect()) == sorted(bt.select("domain", "bleu", "cosine").collect())
