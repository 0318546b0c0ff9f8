"""Helpers shared by the operators of this subpackage.

Every operator reads only the columns it names, so extra columns of the
input, whatever they are called, never clash with its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import storage_root

#: The documents' words: runs of anything but blanks, tabs and line ends.
WORD = r"[^\x20\x09-\x0D]+"
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of one Arrow batch; small, as texts may be very long.
BATCH_ROWS = 256


def session(spark: SparkSession) -> SparkSession:
    """Set the Arrow batch size that bounds a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back.

    Cuts the lineage: a lost executor rereads files and recomputes nothing.
    """
    spark = df.sparkSession
    path = f"{storage_root(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*cols: str) -> Column:
    """A 128-bit key of the row's named columns; null differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols]
    sizes = [F.length(p).cast("string") for p in parts]
    return F.unhex(F.md5(F.concat_ws("|", *sizes, *parts)))


def word_count(text: Column) -> Column:
    """Words of a text (long), 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected ``links(a, b)``: rows (id, root).

    Large-star and small-star steps (Kiveris et al., 2014) alternate until
    the links no longer change; each step is a join-free aggregation whose
    result is written out.  The root is the smallest id.  Ids on no link get
    no row.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .filter("u <> v").distinct())

    def star(x: DataFrame, large: bool) -> DataFrame:
        both = x.unionByName(x.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else x
        low = cut(both.groupBy("u").agg(F.min("v").alias("m"))
                  .select("u", F.least("u", "m").alias("m")))
        hung = both.join(low, "u")
        if large:  # neighbours above u hang on the smallest of u and its neighbours
            hung = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            return cut(hung.filter("u <> v").distinct())
        hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.select("u", F.col("m").alias("v"))
        return cut(hung.unionByName(own).filter("u <> v").distinct())

    def state(x: DataFrame):
        return x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = state(e)
    while now[0]:
        e = star(star(e, True), False)
        was, now = now, state(e)
        if was == now:
            break
    rooted = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return rooted.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
