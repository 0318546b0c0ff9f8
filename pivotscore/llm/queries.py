"""The registered queries of this subpackage: ``opN_<name>`` and ``pipeline``.

Each applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    op1_jaccard,
    op2_quality,
    op3_substring,
    op4_tokens,
    op5_pii,
    op6_mix,
    op7_html,
    op8_sentences,
    op9_bpe,
    op10_ann,
    op11_toxicity,
    op12_whitening,
    op13_runs,
)
from .common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = op1_jaccard.classes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "class_id", "n_links", "n_copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op2_quality.judge(docs, op2_quality.train(docs, table(spark, sf_dir, "labels")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_substring.dedup(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_tokens.count(table(spark, sf_dir, "documents"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op5_pii.find(docs, op5_pii.train(docs))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_mix.copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_html.extract(table(spark, sf_dir, "pages"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = op8_sentences.dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_sentences", "n_removed", "removed", "kept_sha256")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_bpe.digests(table(spark, sf_dir, "documents"))


def op10_ann_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return op10_ann.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op11_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = op11_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return op11_toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", "n_passages")


def op12_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_runs.detect(table(spark, sf_dir, "documents")).drop("runs")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ngram_jaccard, op2_quality_rules, op3_suffix_dedup, op4_token_counts, op5_pii_spans, op6_source_mix,
        op7_html_text, op8_sentence_spans, op9_byte_bpe, op10_ann_partitions, op11_toxic_segments, op12_block_whitening,
        op13_word_runs, pipeline)
}
ORACLES: dict[str, str] = {"op6_source_mix": op6_mix.oracle()}
