"""Corpus quality rules as a data-quality job.

* ``length_profile`` -- words per sentence per domain, out-of-range counts,
  compound sentences joined by ';'.
* ``exact_dups`` -- documents whose text occurs more than once.
* ``near_dups`` -- exact Jaccard join over word 5-shingles (``similar``).  Equal
  shingle sets are collapsed first and no pair list is ever built: a text copied
  a million times costs a million rows, not half a trillion pairs.
* ``register_markers`` -- share of sentences with contractions / first person.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import similar

# Fixed values of the rules.
MIN_WORDS, MAX_WORDS = 8, 25
SWEET_MIN, SWEET_MAX = 12, 18
SHINGLE = 5
NEAR = 0.8
CONTRACTION = r"[a-z]'(s|t|re|ve|ll|d|m)([^a-z]|$)"
FIRST_PERSON = r"(^|[^a-z])(i|me|my|we|our|us)([^a-z]|$)"
# End of fixed values.


def length_profile(sentences: DataFrame) -> DataFrame:
    w = sentences.withColumn("nw", F.size(T.words(F.col("text"))))
    return w.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.min("nw").alias("min_words"),
        F.round(F.avg("nw"), 4).alias("avg_words"), F.max("nw").alias("max_words"),
        F.round(F.stddev_samp("nw"), 4).alias("sd_words"),
        F.sum((F.col("nw") < MIN_WORDS).cast("int")).alias("n_short"),
        F.sum((F.col("nw") > MAX_WORDS).cast("int")).alias("n_long"),
        F.sum(F.col("nw").between(SWEET_MIN, SWEET_MAX).cast("int")).alias("n_sweet"),
        F.sum(F.col("text").contains(";").cast("int")).alias("n_semicolon"))


def exact_dups(docs: DataFrame) -> DataFrame:
    return (docs.groupBy(F.md5("text").alias("text_md5"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
            .filter(F.col("n") > 1))


def shingles(docs: DataFrame) -> DataFrame:
    """(doc_id, sh): the distinct word shingles of each document."""
    d = docs.select("doc_id", T.words(F.lower("text")).alias("w"))
    return d.select("doc_id", F.array_distinct(F.when(F.size("w") >= SHINGLE, F.transform(
        F.sequence(F.lit(1), F.size("w") - SHINGLE + 1),
        lambda i: F.array_join(F.slice(F.col("w"), i, SHINGLE), " "))).otherwise(
        F.array(F.array_join("w", " ")))).alias("sh"))


def near_dups(docs: DataFrame) -> DataFrame:
    """(doc_id, rep_doc_id): documents that reach NEAR with a document of
    smaller id; the smallest such one is named.  A null text is like no other.
    """
    sh = shingles(similar.spread(docs.select("doc_id", "text").filter("text is not null")))
    hashes = F.array_sort(F.array_distinct(F.transform("sh", lambda s: F.xxhash64(s))))
    h = sh.select("doc_id", hashes.alias("hs")).withColumn("key", F.md5(F.concat_ws(",", F.col("hs").cast("array<string>"))))
    h = similar.cut(h)  # texts are split and hashed once
    rows = h.select("doc_id", "key")
    low = similar.cut(rows.groupBy("key").agg(F.min("doc_id").alias("low")))  # equal sets count once
    sets = similar.cut(h.join(low.select(F.col("low").alias("doc_id")), "doc_id")
                       .select(F.col("doc_id").cast("long").alias("id"), F.size("hs").alias("n"), "hs"))
    best = similar.cut(similar.smallest(sets, NEAR))
    told = low.join(best, low.low == best.id, "left").select("key", F.least("low", "best").alias("rep_doc_id"))
    return rows.join(told, "key").filter("rep_doc_id < doc_id").select("doc_id", "rep_doc_id")


def register_markers(sentences: DataFrame) -> DataFrame:
    low = F.lower("text")
    return sentences.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(low.rlike(CONTRACTION).cast("double")), 6).alias("contraction_share"),
        F.round(F.avg(low.rlike(FIRST_PERSON).cast("double")), 6).alias("first_person_share"))
