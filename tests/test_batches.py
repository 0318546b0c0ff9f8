"""Pairs are scored a batch at a time, and an answer is computed once for its filter and its column."""

from collections import Counter
from math import sqrt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pivotscore.functions import text as T
from pivotscore.operators import scoring as S
from pivotscore.plans import protocols as P
from pivotscore.plans import translate as TR

ODD = ["", " ", None, "&quot;A&amp;B&quot; <skipped>x-\ny", ".5,6.7-8 -9-", "ÜBER Straße. İs", "a b\x0bc\x1cd", "😀😀 .😀, 1😀.5", "..", "1.2.3,,4",
       "[x]`^_{y}~|!\"#$%&'()*+,-./:;<=>?@\\", "the cat and the cat and the dog", "The cat, and the cat and a dog.", "x" * 30, "a a a a b b"]


def cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    return sum(a[w] * b[w] for w in a) / sqrt(float(sum(c * c for c in a.values())) * float(sum(c * c for c in b.values())))


def brute(h: str, r: str, low_h: str, low_r: str) -> list:
    h, r = ((x or "").split(" ") if x else [] for x in (h, r))
    grams = [[Counter(tuple(x[k:k + n]) for k in range(len(x) - n + 1)) for x in (h, r)] for n in range(1, 5)]
    chars = [Counter(x[k:k + 3] for k in range(len(x or "") - 2)) for x in (low_h or "", low_r or "")]
    return [*[sum((a & b).values()) for a, b in grams], len(h), len(r),
            cosine(Counter(w.lower() for w in h), Counter(w.lower() for w in r)), cosine(*chars)]


def tokenized(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "k long, s string").select("k", T.tokenize_13a(F.col("s")).alias("t"), F.lower("s").alias("low"))
    return [(r.t, r.low) for r in df.orderBy("k").collect()]


def test_tokens_of_a_batch_are_the_columns_tokens(spark):
    flat, n = T.tokens_13a(pa.array(ODD))
    at = np.cumsum(n) - n
    got = [flat.to_pylist()[a:a + k] for a, k in zip(at, n, strict=True)]
    assert got == [t.split(" ") if t else [] for t, _ in tokenized(spark)]
    assert len(T.tokens_13a(pa.array([None, ""], pa.string()))[0]) == 0


@pytest.mark.parametrize("size", [1, 60, 200_000])
def test_partials_are_those_of_each_pair(spark, monkeypatch, size):
    monkeypatch.setattr(S, "SLICE", size)
    rows = tokenized(spark)
    pairs = [(i, j) for i in range(len(ODD)) for j in range(len(ODD))]
    h, r = pa.array([ODD[i] for i, _ in pairs]), pa.array([ODD[j] for _, j in pairs])
    cut = list(S.slices(h, r))
    assert [k for s in cut for k in range(len(pairs))[s]] == list(range(len(pairs)))
    got = np.concatenate([np.stack(S._partials(h[s], r[s], True, True), 1) for s in cut])
    want = [brute(rows[i][0], rows[j][0], rows[i][1], rows[j][1]) for i, j in pairs]
    assert got == pytest.approx(np.array(want), abs=1e-12)


def test_answers_are_computed_once(spark):
    s = spark.createDataFrame([("d", "1", "Vivid quick kings zoom over nine brown foxes")], "domain string, sent_id string, text string")
    langs = spark.createDataFrame([("f", "aa", 1), ("f", "bb", 3)], "family string, language string, code int")
    asked = TR.with_key(P._forward(s, langs, ["alpha"])).withColumn("cached", F.lit(None).cast("string"))
    plan = TR._new(TR._in_rows(asked, ["alpha"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(") == 2  # en -> L and L -> en
    assert TR._new(TR._in_rows(asked, ["alpha"])).count() == 2
