"""Result files: typed readers and writers of the fact tables.

* ``read_results`` -- a long/wide/chain/round-trip file with an explicit schema
  (CSV or parquet), never an inferred one.
* ``load_many`` -- several files, missing ones skipped with a warning,
  combined with ``unionByName(allowMissingColumns=True)``; ``None`` if none.
* ``write_facts`` -- partitioned, idempotent sinks (dynamic partition
  overwrite), e.g. one partition per family or per (translator, order).
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from ..session import path_exists

log = logging.getLogger(__name__)

LONG_SCHEMA = ("translator string, family string, language string, domain string, "
               "cosine double, bleu double, ter double, embedding double")
CHAIN_SCHEMA = ("translator string, `order` string, domain string, hop int, lang_code string, "
                "cosine double, bleu double, ter double")
ROUND_TRIP_SCHEMA = ("translator string, language string, domain string, direction string, "
                     "cosine double, bleu double, ter double")


def read_results(spark: SparkSession, path: str, schema: str = LONG_SCHEMA) -> DataFrame:
    if path.endswith(".csv") or path.endswith(".csv.gz"):
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).parquet(path)


def load_many(spark: SparkSession, paths: list[str], schema: str | None = None,
              fmt: str = "parquet") -> DataFrame | None:
    frames = []
    for p in paths:
        if not path_exists(spark, p):
            log.warning("skipping missing result file %s", p)
            continue
        r = spark.read.format(fmt)
        if schema:
            r = r.schema(schema)
        if fmt == "csv":
            r = r.option("header", True)
        frames.append(r.load(p))
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_facts(df: DataFrame, path: str, partition_by: list[str], fmt: str = "parquet") -> None:
    """Partitioned write that replaces only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).format(fmt).save(path))
