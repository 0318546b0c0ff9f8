"""Toxicity by maximum-scoring segments of token log-odds.

A token is a lower-case run of letters.  Its log-odds are those of its toxic
share against the labelled sample's, with a hierarchical Dirichlet prior: a
word's counts are smoothed by ``PRIOR`` pseudo-counts split as its longest
prefix is, that prefix's as the next shorter one's, and so on to the sample's
own share.  So unseen and rare words take their stems' part, and most words
score about zero.

Less ``DRIFT`` for each token, the scores of a text sum to a walk that falls
outside toxic passages.  ``segments`` finds all its maximal scoring segments
(Ruzzo and Tompa) in linear time.  The greatest segment of clean text of n
tokens follows an extreme-value law, ``P(S >= x) = 1 - exp(-K n exp(-L x))``;
K and L are fitted on the sample's clean documents, and a segment is a toxic
passage if its expected number in clean text, ``K n exp(-L x)``, is at most
``EXPECT``.  A document's score is a logistic function of its best segment's
excess over that law, of the sum of its significant passages and of that sum
against its length, fitted on the sample.  All of this calibration uses
scores from the other half of the sample, so a text never judges itself.

The labels come from a bounded sample: the ``SAMPLE_ROWS`` labelled ids of
least hash outside the held-out quarter, and of the counted words and
prefixes at most ``VOCABULARY``, those that set the classes apart most.

Defined results: null and empty texts, and texts without letters, have no
passage and get the score of an empty text; held_out is false for a null id;
an id labelled twice counts with its lowest label; without labels of both
classes every score is 0.0; repeated rows are scored alike; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

TOKENS = re.compile(r"[^\W\d_]+")
#: Code points of the prefixes that a word's prior goes back to, shortest first.
PREFIXES = (2, 3, 4, 5, 6, 7, 8)
#: Pseudo-counts of a prior, cost of a token, expected number of a passage in clean text, cut of the verdict.
PRIOR, DRIFT, EXPECT, CUT = 20.0, 0.4, 0.05, 0.3
#: Bounds of the model: labelled documents, words and prefixes, and the least occurrences of one of them.
SAMPLE_ROWS, VOCABULARY, LEAST = 20_000, 200_000, 5
#: Words whose score a Python worker remembers.
MEMO = 500_000
SCHEMA = ("doc_id long, held_out boolean, score double, predicted int, n_passages long, "
          "passages array<struct<start:long,end:long,weight:double,expected:double>>")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 4 == 2, F.lit(False))


def chain(word: str) -> list[str]:
    """A word's prefixes (marked, as they aren't words), shortest first, and the word."""
    return [word[:k] + "*" for k in PREFIXES if len(word) > k] + [word]


# ---- segments ---------------------------------------------------------------- #
def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, sum) of a row of scores, in order, in linear time."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    up = np.diff((score > 0).astype(np.int8), prepend=0, append=0)
    # Candidates: (first, end, sum before, sum with, the nearest earlier one that starts lower).
    open_: list[tuple[int, int, float, float, int]] = []
    for s, e in zip(np.flatnonzero(up == 1).tolist(), np.flatnonzero(up == -1).tolist(), strict=True):
        low, high = float(total[s]), float(total[e])
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= low:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= high:
                break
            s, low = open_[j][0], open_[j][2]
            del open_[j:]
        open_.append((s, e, low, high, j))
    return [(s, e, high - low) for s, e, low, high, _ in open_]


# ---- model ------------------------------------------------------------------- #
@dataclass
class Law:
    """The extreme-value law of the greatest segment in clean text."""

    rate: float
    scale: float

    def excess(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Minus the log of the expected number of such segments in clean text of n tokens."""
        return self.rate * best - math.log(self.scale) - np.log(np.maximum(n, 1))


class Scores(dict):
    """Scores of the words met so far: log-odds of a word's longest counted part, less the drift."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        got = self.odds.get(word)
        if got is None:
            parts = (self.odds.get(word[:k] + "*") for k in reversed(PREFIXES) if k < len(word))
            got = next((x for x in parts if x is not None), 0.0)
        self[word] = got - DRIFT
        return got - DRIFT


@dataclass
class Model:
    """Log-odds of words and prefixes, the law and the calibration."""

    odds: dict[str, float]
    law: Law | None = None
    weights: np.ndarray | None = None

    def __post_init__(self):
        self.known = Scores(self.odds)

    def __getstate__(self):  # what a worker remembers isn't sent to another
        return {"odds": self.odds, "law": self.law, "weights": self.weights}

    def __setstate__(self, state: dict):
        self.__dict__.update(state)
        self.known = Scores(self.odds)

    def scores(self, text: str) -> np.ndarray:
        words = TOKENS.findall(text.lower())
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(_design(x) @ self.weights, -500, 500)))


def _design(x: np.ndarray) -> np.ndarray:
    """Columns of the calibration from (excess, sum of passages, tokens)."""
    excess, total, n = x.T
    return np.stack([np.ones(len(x)), np.clip(excess, -5, -math.log(EXPECT)), np.log1p(total), total / np.sqrt(n + 30)], 1)


def summary(model: Model, text: str | None) -> tuple[tuple[float, float, int], list[tuple[int, int, float, float]]]:
    """(excess of the best segment, sum of the passages, tokens) of a text, and its passages by token."""
    score = model.scores(text or "")
    found = segments(score)
    n = len(score)
    if not found:
        return (float(model.law.excess(np.zeros(1), np.array([n]))[0]), 0.0, n), []
    weight = np.array([w for _, _, w in found])
    excess = model.law.excess(weight, np.array([n]))
    some = np.flatnonzero(excess >= -math.log(EXPECT))
    passages = [(*found[k], math.exp(-excess[k])) for k in some]
    return (float(excess.max()), float(weight[some].sum()), n), passages


def odds(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> Model:
    """Log-odds of counted words and prefixes (token, toxic count, clean count) with their priors."""
    share = toxic / (toxic + clean)
    table = {t: (a, b) for t, a, b in counts}
    rates: dict[str, float] = {}
    for token in sorted(table, key=len):  # a prefix, with its mark, is never longer than what it leads to
        stem = token[:-1] if token.endswith("*") else token
        rate = share
        for k in reversed([k for k in PREFIXES if k < len(stem)]):
            if stem[:k] + "*" in rates:
                rate = rates[stem[:k] + "*"]
                break
        a, b = table[token]
        rates[token] = (a + PRIOR * rate) / (a + b + PRIOR)
    base = math.log(share / (1 - share))
    return Model({t: math.log(r / (1 - r)) - base for t, r in rates.items()})


def law(best: np.ndarray, n: np.ndarray) -> Law:
    """Rate and scale of the law by maximum likelihood, on texts with a segment; robust to mislabelled ones.

    With the rate fixed, the scale has a closed form; the rate's score
    equation is solved by bisection on the lower 95 % of length-corrected
    maxima, as some texts labelled clean are not.
    """
    some = (best > 0) & (n > 0)
    best, n = best[some], n[some].astype(float)
    if len(best) < 20:
        return Law(1.0, 1.0)
    adjusted = best - np.log(n)
    keep = adjusted <= np.quantile(adjusted, 0.95)
    best, n = best[keep], n[keep]

    def slope(rate: float) -> float:
        w = n * np.exp(-rate * (best - best.min()))
        return 1 / rate - best.mean() + (w * best).sum() / w.sum()

    low, high = 1e-3, 50.0
    for _ in range(60):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    rate = math.sqrt(low * high)
    log_scale = math.log(len(best)) - math.log((n * np.exp(-rate * (best - best.min()))).sum()) + rate * best.min()
    return Law(rate, math.exp(min(max(log_scale, -50.0), 50.0)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Logistic weights by Newton steps with a small ridge; evidence with a negative weight is left out."""
    a = _design(x)
    live = np.ones(a.shape[1], bool)
    while True:
        w = np.zeros(live.sum())
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a[:, live] @ w, -30, 30)))
            g = a[:, live].T @ (y - p) - ridge * w
            h = (a[:, live] * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a[:, live] + ridge * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w += step / max(1.0, np.abs(step).max())
            if np.abs(step).max() < 1e-8:
                break
        out = np.zeros(len(live))
        out[live] = w
        if (out[1:] >= 0).all():
            return out
        live[1 + int(out[1:].argmin())] = False


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, y, half, text): one text for each of at most ``rows`` labelled ids that aren't held out."""
    picked = (labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # At most ``rows`` rows of 12 bytes, whatever the input's size.
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
             .groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text")))
    return cut(texts.select("doc_id", (F.col("y") > 0).alias("y"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("half"), "text"))


def counts(texts: DataFrame, vocabulary: int) -> tuple[dict, list]:
    """Tokens per (half, class), and the counted words and prefixes (token, four counts) that set the classes apart."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Counter() for _ in range(4)]
            sizes = [0] * 4
            for t, y, half in zip(*(b.column(c).to_pylist() for c in ("text", "y", "half")), strict=True):
                words = TOKENS.findall((t or "").lower())
                sizes[2 * half + y] += len(words)
                for w, c in Counter(words).items():
                    for token in chain(w):
                        got[2 * half + y][token] += c
            token = list(set().union(*got))
            columns = [pa.array([*(g[t] for t in token), n], pa.int64()) for g, n in zip(got, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([*token, ""], pa.string()), *columns], names=["token", "c0", "c1", "c2", "c3"])

    four = ["c0", "c1", "c2", "c3"]
    summed = cut(texts.mapInArrow(rows, "token string, c0 long, c1 long, c2 long, c3 long")
                 .groupBy("token").agg(*[F.sum(c).alias(c) for c in four]).filter(f"token = '' or c0 + c1 + c2 + c3 >= {LEAST}"))
    sizes = summed.filter("token = ''").first()
    if sizes is None or not sizes["c0"] + sizes["c2"] or not sizes["c1"] + sizes["c3"]:
        return {}, []
    share = (sizes["c1"] + sizes["c3"]) / sum(sizes[c] for c in four)
    n, toxic = F.col("c0") + F.col("c1") + F.col("c2") + F.col("c3"), F.col("c1") + F.col("c3")
    apart = F.abs(toxic - n * F.lit(share)) / F.sqrt(n)
    kept = summed.filter("token <> ''").orderBy(apart.desc(), "token").limit(vocabulary)
    return sizes.asDict(), [tuple(r) for r in kept.collect()]


def measured(texts: DataFrame, halves: list[Model]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, tokens and all segment weights above zero of the sample, each text scored by the other half's model."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, weights = [], []
            for t, half in zip(b.column("text").to_pylist(), b.column("half").to_pylist(), strict=True):
                score = halves[1 - half].scores(t or "")
                n.append(len(score))
                weights.append(sorted(w for _, _, w in segments(score)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(n, pa.int64()), pa.array(weights, pa.list_(pa.float64()))],
                                             names=["doc_id", "y", "n", "weights"])

    got = texts.mapInArrow(rows, "doc_id long, y boolean, n long, weights array<double>")
    best = F.coalesce(F.array_max("weights"), F.lit(0.0))
    found = cut(got.withColumn("best", best))
    first = found.filter("not y").select("best", "n").orderBy("doc_id").collect()
    fitted = law(np.array([r["best"] for r in first]), np.array([r["n"] for r in first]))
    # A passage is significant from this weight on.
    least = (F.log(F.greatest(F.col("n"), F.lit(1))) + F.lit(math.log(fitted.scale) - math.log(EXPECT))) / F.lit(fitted.rate)
    passages = F.aggregate(F.filter("weights", lambda w: w >= least), F.lit(0.0), lambda a, w: a + w)
    rest = found.select("y", "best", "n", passages.alias("total")).orderBy("doc_id").collect()
    n = np.array([r["n"] for r in rest])
    x = np.stack([fitted.excess(np.array([r["best"] for r in rest]), n), [r["total"] for r in rest], n], 1).astype(float)
    return fitted, x, np.array([r["y"] for r in rest], float)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> Model | None:
    """The model of the labelled sample, or None without labels of both classes."""
    texts = sample(docs, labels, rows)
    size, tokens = counts(texts, vocabulary)
    if not size:
        return None
    clean, toxic = size["c0"] + size["c2"], size["c1"] + size["c3"]
    halves = []
    for h in (0, 1):
        own = (size[f"c{2 * h + 1}"], size[f"c{2 * h}"])
        if not all(own):  # too few labels for halves
            own = (toxic, clean)
        halves.append(odds([(r[0], r[2 + 2 * h], r[1 + 2 * h]) for r in tokens if r[2 + 2 * h] + r[1 + 2 * h]], *own))
    model = odds([(r[0], r[2] + r[4], r[1] + r[3]) for r in tokens], toxic, clean)
    model.law, x, y = measured(texts, halves)
    model.weights = calibrate(x, y)
    return model


# ---- scoring ----------------------------------------------------------------- #
def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Each document's score, verdict and significant passages (code points, end exclusive)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, double = pa.int64(), pa.float64()
        span = pa.list_(pa.struct([("start", longs), ("end", longs), ("weight", double), ("expected", double)]))
        for b in batches:
            x, spans = [], []
            for t in b.column("text").to_pylist():
                got, passages = summary(model, t) if model else ((0.0, 0.0, 0), [])
                x.append(got)
                spans.append(places(t, passages) if passages else [])
            p = (model.probability(np.array(x, float).reshape(-1, 3)) if model else np.zeros(len(x)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(p, double), pa.array((p >= CUT).astype(np.int32)),
                 pa.array([len(s) for s in spans], longs), pa.array(spans, span)],
                names=["doc_id", "held_out", "score", "predicted", "n_passages", "passages"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(rows, SCHEMA)


def places(text: str, passages: list[tuple[int, int, float, float]]) -> list[dict]:
    """The passages with code points of the text instead of tokens."""
    # Lower case may change a text's length, so the tokens are taken from its characters one by one.
    at = [i for i, c in enumerate(text) for _ in c.lower()] if len(text.lower()) != len(text) else None
    spans = [m.span() for m in TOKENS.finditer(text.lower())]
    out = []
    for first, last, weight, expected in passages:
        s, e = spans[first][0], spans[last - 1][1]
        out.append({"start": at[s] if at else s, "end": (at[e - 1] + 1) if at else e, "weight": weight, "expected": expected})
    return out
