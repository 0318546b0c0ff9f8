"""Readers, encoders and per-worker state."""

import os

import pytest
from pyspark.sql import functions as F


def test_corpora_keep_lines_as_written(spark, tmp_path):
    from pivotscore.sources.corpora import load_corpora
    (tmp_path / "legal.txt").write_text("one \n\n  two\n \nthree", encoding="utf-8")
    (tmp_path / "idiomatic.txt").write_text("été\n", encoding="utf-8")
    got = sorted((r["domain"], r["sent_id"], r["text"]) for r in load_corpora(spark, str(tmp_path)).collect())
    assert got == [("idiomatic", 0, "été"), ("legal", 0, "one "), ("legal", 1, "  two"), ("legal", 2, "three")]


def test_corpora_are_numbered_across_splits(spark, tmp_path):
    from pivotscore.sources.corpora import load_corpora
    (tmp_path / "a.txt").write_text("".join(f"line {k}\n" for k in range(3000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["sent_id"]: r["text"] for r in load_corpora(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {k: f"line {k}" for k in range(3000)}


def test_encoder_batches_and_sets_up_once_per_worker(spark, tmp_path):
    from pivotscore.functions.channels import encoder
    log = str(tmp_path / "log")

    def setup():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return 2.0

    def encode(texts, state):
        assert len(texts) <= 3
        return [[len(t) * state, 1.0] for t in texts]

    run = encoder("test", encode, setup, batch=3)
    df = spark.createDataFrame([("x" * k,) for k in range(20)] + [(None,)], "t string").repartition(6)
    got = {len(r["t"]) if r["t"] is not None else None: r["v"] for r in df.select("t", run("t").alias("v")).collect()}
    assert got[None] is None and all(got[k] == [2.0 * k, 1.0] for k in range(20))
    pids = open(log).read().split()
    assert len(pids) == len(set(pids))


def test_word_vectors_by_hand(spark):
    from pivotscore.operators.scoring import word_vector_cosine
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<double>")
    p = spark.createDataFrame([(1, "a", "a a"), (2, "a", "b"), (3, "A b", "a"), (4, "x", "a"), (5, None, "a")], "i long, o string, c string")
    got = {r["i"]: r["cosine"] for r in word_vector_cosine(p, ["i"], "o", "c", v).collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0, 3: pytest.approx(0.5 ** 0.5), 4: 0.0, 5: 0.0}


def test_calls_to_a_slow_backend_are_dealt_out(spark):
    from pivotscore.functions.channels import PandasBackend, register
    from pivotscore.plans import translate as TR
    register(PandasBackend("echo", lambda pdf, state: pdf["text"], None))
    rows = [("echo", "en", "L", None, 1, f"t{k}", f"k{k}") for k in range(400)]
    miss = spark.createDataFrame(rows, "backend string, src string, tgt string, src_code int, tgt_code int, text string, key string").coalesce(1)
    assert TR.enrich(miss, ["echo"]).withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
