"""Pair scoring as distributed aggregates (corpus BLEU, lexical cosine,
stand-in embedding cosine, vector cosine).

Every metric is split into per-pair *partials* that are computed inside the
row (no explode, no shuffle) and *sums* that a ``groupBy`` combines with a
map-side partial aggregate.  Corpus BLEU is therefore the BLEU of the summed
n-gram statistics, not a mean of sentence scores.

An Arrow UDF counts the n-grams, words and character trigrams of all pairs of
a batch together, as numbers: each word gets one, an n-gram is numbered from
those of the n-gram one word shorter and its last word, and the counts of both
sides are sums by number.  Only n-grams that the other side has are made
longer, so the work is linear in the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import text as T
from .ter import rate

ORDERS = range(1, T.MAX_ORDER + 1)
_COUNTS = ["m1", "m2", "m3", "m4", "hyp_len", "ref_len"]
#: Characters of the pairs that are counted together (a longer pair is by itself).
SLICE = 200_000


def _cos(dot: Column, na: Column, nb: Column) -> Column:
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(
        dot.cast("double") / F.sqrt(na.cast("double") * nb.cast("double")))


class _Rows:
    """Items of the candidates' rows and then of the references' rows, one after another."""

    def __init__(self, items: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.n = len(starts) // 2
        row = np.repeat(np.arange(len(lengths)), lengths)
        within = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.item = items[within + starts[row]]
        self.left = lengths[row] - within  # items from here to the row's end
        self.theirs = row >= self.n
        self.pair = row - self.n * self.theirs

    def counts(self, number: np.ndarray, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For numbers from 0 on, each of one pair: how often either side has it, and its pair."""
        theirs, size = self.theirs[at], int(number.max(initial=-1)) + 1
        of = np.zeros(size, np.int64)
        of[number] = self.pair[at]
        return np.bincount(number[~theirs], minlength=size), np.bincount(number[theirs], minlength=size), of

    def add(self, values: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whole numbers, summed by pair."""
        return np.bincount(of, weights=values, minlength=self.n).astype(np.int64)

    def cosine(self, number: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Cosine of the two bags of each pair, 0 if one is empty."""
        a, b, of = self.counts(number, at)
        squares = self.add(a * a, of).astype(float) * self.add(b * b, of).astype(float)
        return np.divide(self.add(a * b, of), np.sqrt(squares), out=np.zeros(self.n), where=squares > 0)


def _number(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers from 0 on for the pairs of two small numbers."""
    return pd.factorize(first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second)[0]


def clipped_matches(words: _Rows) -> list[np.ndarray]:
    """By order, how many n-grams of the candidates are in the reference, each at most as often as there."""
    out = []
    at, number = np.arange(len(words.item)), _number(words.pair, words.item)
    for n in ORDERS:
        mine, theirs, of = words.counts(number, at)
        both = np.minimum(mine, theirs)
        out.append(words.add(both, of))
        go = (both[number] > 0) & (words.left[at] > n)  # what does not match, nor does a longer one
        at = at[go]
        number = _number(number[go], words.item[at + n])
    return out


def trigram_cosine(hyp: pa.Array, ref: pa.Array) -> np.ndarray:
    """Cosine of the character trigrams of lower-cased texts, by pair."""
    low = [x.lower() if x else "" for side in (hyp, ref) for x in side.to_pylist()]
    lengths = np.array([len(x) for x in low])
    chars = pd.factorize(np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32))[0]
    rows = _Rows(chars, np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(rows.left > 2)
    grams = _number(_number(rows.item[at], rows.item[at + 1]), rows.item[at + 2])
    return rows.cosine(_number(rows.pair[at], grams), at)


def slices(hyp: pa.Array, ref: pa.Array) -> Iterator[slice]:
    """Stretches of rows that are counted together."""
    size = sum(pc.fill_null(pc.utf8_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (hyp, ref))
    part = np.cumsum(size) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    return (slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b)


def _partials(hyp: pa.Array, ref: pa.Array, lexical: bool, encoder: bool) -> list[np.ndarray]:
    n = len(hyp)
    refs = pc.fill_null(ref, "").dictionary_encode()  # an original has many candidates
    flat, lengths = T.tokens_13a(pa.concat_arrays([hyp, refs.dictionary]))
    vocabulary = flat.dictionary_encode()
    text = np.r_[np.arange(n), n + refs.indices.to_numpy()]
    words = _Rows(vocabulary.indices.to_numpy(), (np.cumsum(lengths) - lengths)[text], lengths[text])
    out = [*clipped_matches(words), lengths[text[:n]], lengths[text[n:]]]
    if lexical:
        low = pd.factorize(np.array([w.lower() for w in vocabulary.dictionary.to_pylist()], object))[0]
        out.append(words.cosine(_number(words.pair, low[words.item])))
    if encoder:
        out.append(trigram_cosine(hyp, ref))
    return out


def partials_udf(lexical: bool, encoder: bool):
    """A function (candidate, reference) -> partials of the metrics that are wanted."""
    cosines = ["pair_cosine"] * lexical + ["pair_embedding"] * encoder
    schema = StructType([StructField(c, LongType()) for c in _COUNTS] + [StructField(c, DoubleType()) for c in cosines])

    @F.arrow_udf(schema)
    def run(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        hyp, ref = (x.cast(pa.string()) for x in (hyp, ref))
        parts = [_partials(hyp[s], ref[s], lexical, encoder) for s in slices(hyp, ref)]
        types = [pa.int64()] * len(_COUNTS) + [pa.float64()] * len(cosines)
        columns = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], t) for k, t in enumerate(types)]
        return pa.StructArray.from_arrays(columns, names=[*_COUNTS, *cosines])

    return run


def score_pairs(df: DataFrame, ref_col: str, hyp_col: str, lexical: bool = True,
                encoder: bool = True) -> DataFrame:
    """Add the per-pair partials of the candidates ``hyp_col`` and references ``ref_col``."""
    df = df.withColumn("_p", partials_udf(lexical, encoder)(F.col(hyp_col), F.col(ref_col)))
    cols = {f"m{n}": F.col(f"_p.m{n}") for n in ORDERS}
    cols.update({f"t{n}": F.greatest(F.col("_p.hyp_len") - (n - 1), F.lit(0).cast("long")) for n in ORDERS})
    cols.update({c: F.col(f"_p.{c}") for c in ("hyp_len", "ref_len")})
    if lexical:
        cols["pair_cosine"] = F.col("_p.pair_cosine")
    if encoder:
        cols["pair_embedding"] = F.col("_p.pair_embedding")
    return df.withColumns(cols).drop("_p")


def bleu_partial_aggs(weight: Column) -> list[Column]:
    parts = [f"m{n}" for n in ORDERS] + [f"t{n}" for n in ORDERS] + ["hyp_len", "ref_len"]
    return [F.sum(F.col(c) * weight).alias(c) for c in parts]


def corpus_bleu(m: list[Column], t: list[Column], hyp_len: Column, ref_len: Column) -> Column:
    """Corpus BLEU (exponential smoothing, max order 4) from summed statistics."""
    bp = (F.when(hyp_len >= ref_len, F.lit(1.0))
          .when(hyp_len == 0, F.lit(0.0))
          .otherwise(F.exp(1.0 - ref_len.cast("double") / hyp_len.cast("double"))))
    zeros = F.lit(0)
    logs = []
    for mn, tn in zip(m, t):
        zeros = zeros + F.when(mn == 0, 1).otherwise(0)
        p = F.when(mn > 0, 100.0 * mn / tn).otherwise(100.0 / (F.pow(F.lit(2.0), zeros) * tn))
        logs.append(F.log(p))
    any_match = sum(m[1:], m[0]) > 0
    all_totals = t[-1] > 0
    return (F.when(~any_match | ~all_totals, F.lit(0.0))
            .otherwise(bp * F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / 4.0)))


def bleu_from_sums(prefix: str = "") -> Column:
    return corpus_bleu([F.col(f"{prefix}m{n}") for n in ORDERS],
                       [F.col(f"{prefix}t{n}") for n in ORDERS],
                       F.col(f"{prefix}hyp_len"), F.col(f"{prefix}ref_len"))


def aggregate_scores(pairs: DataFrame, keys: list[str], lexical: bool = True,
                     encoder: bool = True, rounded: bool = True, edits: bool = False,
                     weight: str | None = None) -> DataFrame:
    """groupBy(keys) -> bleu (4 dp), cosine (6 dp), embedding (6 dp), n_pairs.

    ``weight`` names the column that tells how many pairs a row stands for (none: one).
    ``edits`` adds ter (4 dp) from the pairs' ``edits`` and ``ref_words``.
    ``rounded=False`` keeps the values as they are, for reports that average
    them before they round.
    """
    def edge(c, digits):
        return F.round(c, digits) if rounded else c

    w = F.col(weight) if weight else F.lit(1).cast("long")
    aggs = bleu_partial_aggs(w) + [F.sum(w).alias("n_pairs")]
    if lexical:
        aggs.append((F.sum(F.col("pair_cosine") * w) / F.sum(w)).alias("cosine"))
    if encoder:
        aggs.append((F.sum(F.col("pair_embedding") * w) / F.sum(w)).alias("embedding"))
    if edits:
        aggs += [F.sum(F.col(c) * w).alias(c) for c in ("edits", "ref_words")]
    g = pairs.groupBy(*keys).agg(*aggs)
    out = [*keys, edge(bleu_from_sums(), 4).alias("bleu")]
    if lexical:
        out.append(edge(F.col("cosine"), 6).alias("cosine"))
    if encoder:
        out.append(edge(F.col("embedding"), 6).alias("embedding"))
    if edits:
        out.append(edge(rate(F.col("edits"), F.col("ref_words")), 4).alias("ter"))
    out.append("n_pairs")
    return g.select(*out)


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, 0.0 when either norm is 0 (JVM-side)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda acc, v: acc + v)
    na = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    nb = F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / F.sqrt(na * nb))


def word_vector_cosine(pairs: DataFrame, ids: list[str], ref: str, hyp: str, vectors: DataFrame) -> DataFrame:
    """Cosine of the mean word vectors of two texts, per pair (``ids``).

    ``vectors(word, vector)`` holds lower-cased words; words without a vector
    are left out, and a text without any has cosine 0.  The mean's length
    does not matter, so vectors are summed: words are counted per text, joined
    once, and summed by dimension.  The join carries no hint, so a vector
    table of any size will do.
    """
    def side(text, name):
        tokens = T.split_tokens(T.tokenize_13a(F.lower(F.coalesce(F.col(text), F.lit("")))))
        return pairs.select(*ids, F.lit(name).alias("side"), F.explode(tokens).alias("word"))

    counted = side(ref, "r").unionByName(side(hyp, "h")).groupBy(*ids, "side", "word").agg(F.count(F.lit(1)).alias("n"))
    dims = (counted.join(vectors.select("word", "vector"), "word")
            .repartition(*ids)  # vectors travel whole; both sums below follow this exchange
            .select(*ids, "side", "n", F.posexplode("vector").alias("dim", "v")))

    def total(name):
        return F.sum(F.when(F.col("side") == name, F.col("n") * F.col("v").cast("double")).otherwise(0.0)).alias(name)

    sums = dims.groupBy(*ids, "dim").agg(total("r"), total("h"))
    parts = sums.groupBy(*ids).agg(F.sum(F.col("r") * F.col("h")).alias("dot"), F.sum(F.col("r") * F.col("r")).alias("rr"),
                                   F.sum(F.col("h") * F.col("h")).alias("hh"))
    parts = parts.select(*ids, _cos(F.col("dot"), F.col("rr"), F.col("hh")).alias("cosine"))
    return pairs.select(*ids).join(parts, ids, "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
