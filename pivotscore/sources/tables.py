"""The analysis inputs, derived from the driver's tables.

* ``facts`` -- one row per line item with the four metric stand-ins;
  ``cells`` -- the long fact table (translator, family, language, domain,
  cosine, bleu, ter, embedding), the mean of ``facts`` per cell.
* ``sentences`` -- every sentence of every document (domain := document
  language); documents are split on line breaks and sentence ends, nothing
  is cut.
* ``conversation_pairs`` -- consecutive turns of a conversation.
* ``vector_pairs`` -- embedding rows 2k and 2k+1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import load_table, pivots
from ..functions import text as T

CELL_KEYS = ["translator", "family", "language", "domain"]
METRIC_COLS = ["cosine", "bleu", "ter", "embedding"]
MEASURE_TYPE = "decimal(18,2)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ungrouped facts: one row per line item.

    Supplier and part are joined without hints: Catalyst broadcasts them only
    when its size estimate is under ``autoBroadcastJoinThreshold`` (and AQE
    re-checks the real size at runtime); beyond that it shuffles.  The
    nation/region dimension is bounded (25 rows) and always broadcast.
    """
    li = load_table(spark, sf_dir, "lineitem").select(
        "l_linestatus", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity",
        "l_discount", "l_tax")
    s = load_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    piv = pivots(spark, sf_dir).select("family", "language", "code")
    return (li.join(p, li.l_partkey == p.p_partkey)
            .join(s, li.l_suppkey == s.s_suppkey)
            .join(piv, F.col("s_nationkey") == F.col("code"))
            .select(F.col("l_linestatus").alias("translator"), "family", "language",
                    F.col("p_type").alias("domain"),
                    (F.col("l_extendedprice") / 1000).alias("bleu"),
                    F.col("l_quantity").alias("ter"),
                    F.col("l_discount").alias("cosine"),
                    F.col("l_tax").alias("embedding")))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long fact table: mean metrics per (translator, family, language, domain).

    Aggregation is pushed below the supplier join: line items are first
    summed per (status, supplier, part type) -- a map-side partial aggregate
    that shrinks the rows before the second join -- and only then mapped to
    nations and summed again.  The measures carry two decimals, so they are
    summed as DECIMAL: the sums are exact whatever the partitioning, and every
    engine derives the same double mean from them.
    """
    li = load_table(spark, sf_dir, "lineitem").select(
        "l_linestatus", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity",
        "l_discount", "l_tax")
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    s = load_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    piv = pivots(spark, sf_dir).select("family", "language", "code")
    def dsum(c):
        return F.sum(F.col(c).cast(MEASURE_TYPE))

    part_sums = (li.join(p, li.l_partkey == p.p_partkey)
                 .groupBy("l_linestatus", "l_suppkey", "p_type")
                 .agg(dsum("l_extendedprice").alias("sp"), dsum("l_quantity").alias("sq"),
                      dsum("l_discount").alias("sd"), dsum("l_tax").alias("st"),
                      F.count(F.lit(1)).alias("n")))
    g = (part_sums.join(s, part_sums.l_suppkey == s.s_suppkey)
         .join(piv, F.col("s_nationkey") == F.col("code"))
         .groupBy(F.col("l_linestatus").alias("translator"), "family", "language",
                  F.col("p_type").alias("domain"))
         .agg(F.sum("sp").alias("sp"), F.sum("sq").alias("sq"), F.sum("sd").alias("sd"),
              F.sum("st").alias("st"), F.sum("n").alias("n")))
    def mean(c):
        return F.col(c).cast("double") / F.col("n")

    return g.select(*CELL_KEYS, mean("sd").alias("cosine"), (mean("sp") / 1000).alias("bleu"),
                    mean("sq").alias("ter"), mean("st").alias("embedding"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, sent_id, doc_id, text): every non-blank sentence of every document.

    ``sent_id`` is ``doc_id:position``, so no document, however long, can take
    the ids of another.
    """
    d = load_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    pieces = F.split(F.regexp_replace("text", r"([.!?])[ \t]+", "$1\n"), "\n")
    x = d.select("doc_id", F.col("lang").alias("domain"), F.posexplode(pieces).alias("pos", "piece"))
    x = x.withColumn("text", T.strip_ws(F.col("piece"))).filter(F.col("text") != "")
    return x.select("domain", F.concat_ws(":", "doc_id", "pos").alias("sent_id"),
                    "doc_id", "text")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, original, candidate): turn t against turn t+1.

    An equi-join on (conv_id, turn) keeps a very long conversation spread
    over many tasks, which a window partitioned by conversation would not.
    """
    c = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate"))
    return (c.join(nxt, ["conv_id", "turn"])
            .select("conv_id", "turn", "role", F.col("text").alias("original"), "candidate"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, label, a, b): vectors 2k and 2k+1, grouped (at most 2 rows per key)."""
    e = load_table(spark, sf_dir, "embeddings")
    g = (e.groupBy((F.col("vec_id") / 2).cast("long").alias("pair_id"))
         .agg(F.min_by("embedding", "vec_id").alias("a"), F.max_by("embedding", "vec_id").alias("b"),
              F.min_by("label", "vec_id").alias("label"), F.count(F.lit(1)).alias("n")))
    return g.filter(F.col("n") == 2).select("pair_id", "label", "a", "b")
