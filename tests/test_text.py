"""Pair scoring against brute-force Python, and the metric invariants."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pivotscore.operators import scoring


def tok13a(s):
    for a, b in [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"),
                 ("&lt;", "<"), ("&gt;", ">")]:
        s = s.replace(a, b)
    s = f" {s} "
    s = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", s)
    s = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", s)
    s = re.sub(r"([\.,])([^0-9])", r" \1 \2", s)
    s = re.sub(r"([0-9])(-)", r"\1 \2 ", s)
    return s.split()


def brute_bleu(refs, hyps):
    m, t = [0] * 4, [0] * 4
    hl = rl = 0
    for r, h in zip(refs, hyps):
        rt, ht = tok13a(r), tok13a(h)
        hl += len(ht)
        rl += len(rt)
        for n in range(1, 5):
            hc = Counter(tuple(ht[i:i + n]) for i in range(len(ht) - n + 1))
            rc = Counter(tuple(rt[i:i + n]) for i in range(len(rt) - n + 1))
            m[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            t[n - 1] += max(len(ht) - n + 1, 0)
    if sum(m) == 0:
        return 0.0
    bp = 1.0 if hl >= rl else (math.exp(1 - rl / hl) if hl else 0.0)
    smooth, logs = 1.0, []
    for n in range(4):
        if t[n] == 0:
            return 0.0
        if m[n] == 0:
            smooth *= 2
            logs.append(math.log(100.0 / (smooth * t[n])))
        else:
            logs.append(math.log(100.0 * m[n] / t[n]))
    return bp * math.exp(sum(logs) / 4)


def brute_cos(a, b):
    ca, cb = Counter(w.lower() for w in tok13a(a)), Counter(w.lower() for w in tok13a(b))
    na, nb = sum(v * v for v in ca.values()), sum(v * v for v in cb.values())
    if na == 0 or nb == 0:
        return 0.0
    return sum(v * cb[w] for w, v in ca.items()) / math.sqrt(na * nb)


@pytest.mark.parametrize("line,tokens", [
    ("In 2020.", "In 2020 ."), (".5 of it", ". 5 of it"), ("3,500.25 - 4-5", "3,500.25 - 4 - 5"),
    ("&quot;A&amp;B&quot;", '" A & B "'), ("well-\nknown, yes", "wellknown , yes")])
def test_tokens_by_hand(spark, line, tokens):
    from pivotscore.functions import text as T
    got = spark.createDataFrame([(line,)], "s string").select(T.tokenize_13a(F.col("s")).alias("t")).first()["t"]
    assert got == tokens


PAIRS = [("The cat sat on the mat, and the dog sat too.", "the cat sat on a mat and the dog too"),
         ("It costs 3.50 dollars (approx.) - really!", "It costs 3.50 dollars really"),
         ("a a a a b b", "a a b b b b"),
         ("Short.", ""),
         ("Übermäßig große Straße; ça va?", "übermäßig grosse strasse ca va")]


def run(spark, pairs):
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(pairs)], "g long, ref string, hyp string")
    st = scoring.score_pairs(df, "ref", "hyp")
    return st, scoring.aggregate_scores(st.withColumn("k", F.lit(1)), ["k"]).collect()[0]


def test_corpus_bleu_matches_brute_force(spark):
    _, row = run(spark, PAIRS)
    refs, hyps = zip(*PAIRS)
    assert row["bleu"] == pytest.approx(round(brute_bleu(refs, hyps), 4), abs=1e-4)


def test_pair_cosine_matches_brute_force(spark):
    st, _ = run(spark, PAIRS)
    got = {r["g"]: r["pair_cosine"] for r in st.select("g", "pair_cosine").collect()}
    for i, (r, h) in enumerate(PAIRS):
        assert got[i] == pytest.approx(brute_cos(h, r), abs=1e-12)


def test_identity_scores_are_perfect(spark):
    same = [(r, r) for r, _ in PAIRS if r]
    _, row = run(spark, same)
    assert row["bleu"] == 100.0 and row["cosine"] == 1.0 and row["embedding"] == 1.0


def test_zero_norm_gives_zero(spark):
    st, _ = run(spark, [("", "")])
    r = st.collect()[0]
    assert r["pair_cosine"] == 0.0 and r["pair_embedding"] == 0.0


def test_vector_cosine_zero_norm(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(scoring.vector_cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 1.0]
