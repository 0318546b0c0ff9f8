"""The corpus pipeline: five stages from raw documents to tokens.

Each stage is a function of (spark, docs, sf_dir) and works on all rows of
its predecessor, which ``run`` writes as Parquet and reads again:

1. ``quality``: documents that the quality rules reject go;
2. ``near_copies``: of each class of near copies one document stays;
3. ``personal_data``: personal data is replaced by its kind in brackets, and
   ``n_chars`` counts the new text;
4. ``source_mix``: each document is repeated as often as the mix takes it;
5. ``tokens``: every document is encoded and decoded again.

All but the last return the columns of ``documents``.  Learned steps and the
recursive join have no SQL form, so there is no oracle; the tests compare
the stages with brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pivotscore.llm import op1_jaccard, op2_quality, op5_pii, op6_mix, op9_bpe
from pivotscore.llm.common import DOC_COLUMNS, cut, session, table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    session(spark)
    model = op2_quality.train(docs, table(spark, sf_dir, "labels"))
    return op2_quality.judge(docs, model, keep=DOC_COLUMNS).filter("kept").select(*DOC_COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    session(spark)
    return op1_jaccard.keep_one(docs.select(*DOC_COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    session(spark)
    hidden = op5_pii.redact(docs.select(*DOC_COLUMNS), op5_pii.train(docs))
    return hidden.withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    session(spark)
    return op6_mix.repeat(docs.select(*DOC_COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    session(spark)
    return op9_bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_copies", near_copies), ("personal_data", personal_data),
    ("source_mix", source_mix), ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
