"""Corpora kept as text files, one file per domain and one sentence per line (A1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.translate import materialize


def load_corpora(spark: SparkSession, folder: str) -> DataFrame:
    """(domain, sent_id, text): the lines of ``folder/*.txt`` that are not blank, as written.

    The domain is the file's name; ``sent_id`` counts the kept lines of a file
    from 0.  Lines are read and numbered split by split: a line's number is
    its place in its split plus the kept lines of the file's earlier splits.
    """
    lines = spark.read.text(f"{folder.rstrip('/')}/*.txt").select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)\.txt$", 1).alias("domain"),
        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"))
    kept = materialize(lines.filter(F.trim("text") != ""), "corpora")
    per = kept.groupBy("domain", "at").agg(F.count(F.lit(1)).alias("n"))  # a row per split
    before = F.coalesce(F.sum("n").over(Window.partitionBy("domain").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("domain", "at", before.alias("ahead"))
    own = F.row_number().over(Window.partitionBy("domain", "at").orderBy("row")) - 1
    return kept.join(per, ["domain", "at"]).select("domain", (own + F.col("ahead")).alias("sent_id"), "text")
