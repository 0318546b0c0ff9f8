"""Quality rules: gradient-boosted trees over document statistics.

``statistics`` computes per-document counts, ``fit`` grows boosted trees on a
bounded sample of labelled rows, and the fitted trees are flattened to numpy
node arrays so that a batch of documents is scored by a few array look-ups.
Chosen features are monotonic: more symbols, repeated lines, repeated words
or capitals can only lower the score.

Defined results: a null text counts as empty (all counts 0, base_failed
true); an empty table gives no rows; repeated rows are judged alike; with no
labelled rows, or labels of one class only, the model gives 1.0 for every
document and the base rule alone decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?", "…")
#: Latin capitals; other scripts' are not counted.
CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature and its constraint: -1 lowers the score as it grows, 0 is free.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1,
            "repeat_share": -1, "upper_share": -1, "digit_share": 0, "distinct_share": 0,
            "end_share": 0, "words_per_line": 0, "mark_share": 0, "top_word_share": 0}
#: At most so many labelled documents are collected for fitting.
SAMPLE_ROWS = 20_000


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Positions inside 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    if distinct < 2_000_000:
        w = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
        _, inverse, count = np.unique(w, return_inverse=True, return_counts=True)
    else:
        w = np.stack([ids[:-2], ids[1:-1], ids[2:]], 1)
        _, inverse, count = np.unique(w, axis=0, return_inverse=True, return_counts=True)
    starts = count[inverse.ravel()] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k:len(ids) - 2 + k] |= starts
    return int(covered.sum())


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The contract's five counts and the model's features of one whole text."""
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeats = len(lines) - len(set(lines))
    covered = repeated_words(ids, len(seen))
    counts = [n, chars, symbols, repeats, covered]
    one = max(n, 1)
    letters = max(chars, 1)
    upper = len(CAPITALS.findall(text))
    digits = sum(map(text.count, "0123456789"))
    marks = sum(map(text.count, ".,;:!?"))
    top = int(np.bincount(ids).max()) if n else 0
    ends = sum(w.endswith(ENDS) for w in words)
    return counts, [float(np.log1p(n)), chars / one, symbols / letters, repeats / max(len(lines), 1),
                    covered / one, upper / letters, digits / letters, len(seen) / one ** 0.8,
                    ends / one, n / max(len(lines), 1), marks / letters, top / one]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


@dataclass
class Trees:
    """Flattened boosted trees: one row per tree, node k has children 2k+1 and 2k+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for the rows of ``x``."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            margin += v[node]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 60, depth: int = 4,
        rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 4.0) -> Trees | None:
    """Second-order boosting on logistic loss with histogram splits.

    A split on a constrained feature must order its children's values; the
    midpoint of the two then bounds every value below either child.  Returns
    None if ``y`` lacks one of the classes.
    """
    if len(np.unique(y)) < 2:
        return None
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, base)
    size = 2 ** (depth + 1) - 1
    out: list[tuple] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(size, np.int64), np.full(size, np.inf)
        value, low, high = np.zeros(size), np.full(size, -np.inf), np.full(size, np.inf)
        node = np.zeros(n, np.int64)
        for k in range(2 ** depth - 1):
            rows = np.flatnonzero(node == k)
            if k == 0:
                value[0] = np.clip(g.sum() / (h.sum() + l2), low[0], high[0])
            best = (1e-6, None)
            if len(rows) >= 2:
                gt, ht = g[rows].sum(), h[rows].sum()
                for j in range(m):
                    b = binned[rows, j]
                    k_bins = len(edges[j])
                    gl = np.cumsum(np.bincount(b, g[rows], k_bins + 1))[:k_bins]
                    hl = np.cumsum(np.bincount(b, h[rows], k_bins + 1))[:k_bins]
                    gr, hr = gt - gl, ht - hl
                    vl = np.clip(gl / (hl + l2), low[k], high[k])
                    vr = np.clip(gr / (hr + l2), low[k], high[k])
                    ok = (hl >= least) & (hr >= least) & (monotone[j] * (vr - vl) >= 0)
                    gain = np.where(ok, (gl * vl - (hl + l2) * vl ** 2 / 2) + (gr * vr - (hr + l2) * vr ** 2 / 2)
                                    - (gt * value[k] - (ht + l2) * value[k] ** 2 / 2), -np.inf)
                    if len(gain) and gain.max() > best[0]:
                        s = int(gain.argmax())
                        best = (gain[s], (j, s, vl[s], vr[s]))
            left, right = 2 * k + 1, 2 * k + 2
            low[[left, right]], high[[left, right]] = low[k], high[k]
            if best[1] is None:  # all go left, with the value unchanged
                value[left] = value[right] = value[k]
                node[rows] = left
                continue
            j, s, vl, vr = best[1]
            feature[k], cut[k] = j, edges[j][s]
            value[left], value[right] = vl, vr
            if monotone[j]:
                middle = (vl + vr) / 2
                (high if monotone[j] > 0 else low)[left] = middle
                (low if monotone[j] > 0 else high)[right] = middle
            node[rows] = np.where(binned[rows, j] > s, right, left)
        margin += rate * value[node]
        out.append((feature, cut, rate * value))
    f, c, v = (np.stack(a) for a in zip(*out, strict=True))
    return Trees(f, c, v, base, depth)


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents.

    The labelled ids of least hash are taken, so any run picks the same ones;
    an id labelled more than once counts with its lowest label.
    """
    picked = (labels.filter("doc_id is not null and quality is not null")
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t)[1] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(got, pa.list_(pa.float64()))],
                                             names=["doc_id", "y", "x"])

    # ``picked`` has at most ``rows`` rows of 12 bytes, whatever the input's size.
    got = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
           .mapInArrow(features, "doc_id long, y int, x array<double>")
           .orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).collect())
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    return x, np.array([r["y"] > 0 for r in got], float)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees | None:
    return fit(*sample(docs, labels, rows), list(FEATURES.values()))


def judge(docs: DataFrame, model: Trees | None, least: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Each document's counts, score and verdict; ``keep`` names input columns to pass through."""
    keep = keep or ["doc_id"]
    sent = docs.select(*[F.col(c).alias(f"in_{c}") for c in keep], F.col("text").alias("_text"))
    kept = sent.drop("_text").schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
                       + [f"{c} long" for c in COUNTS] + ["base_failed boolean", "score double", "kept boolean"])
    names = [f.name for f in kept]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t) for t in b.column("_text").to_pylist()]
            counts = np.array([c for c, _ in got], np.int64).reshape(len(got), len(COUNTS))
            x = np.array([f for _, f in got], float).reshape(len(got), len(FEATURES))
            score = model.score(x) if model else np.ones(len(got))
            failed = np.array([base_failed(c[0], c[4]) for c in counts], bool)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [pa.array(counts[:, k]) for k in range(len(COUNTS))]
                + [pa.array(failed), pa.array(score), pa.array(~failed & (score >= least))],
                names=[*names, *COUNTS, "base_failed", "score", "kept"])

    out = sent.mapInArrow(rows, schema)
    return out.withColumnsRenamed({f"in_{c}": c for c in keep})
