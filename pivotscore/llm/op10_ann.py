"""Approximate nearest neighbours by learned partitions.

On a bounded sample the exact neighbour graph is built and split into equal
parts so that few edges are cut.  A small classifier (one hidden layer)
learns how a point's neighbours spread over the parts.  Every vector goes to
its most probable part; a query is sent to its several most probable parts
and compared exactly, in double precision, with all vectors there.  The
number of parts probed is the least that reaches ``AIM`` recall on sampled
points held out from the fit, measured by brute force over the sample.  A
query whose parts hold too few vectors goes to more of them, so that it never
gets fewer results than there are.

Queries and vectors meet in cells of bounded size: a part's vectors and its
queries are both dealt over blocks by hash.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; neither do null ids; rows that repeat an id count once, with
the least of their vectors in element order; ties in distance go to the smaller id;
with fewer than ten candidates all are returned; a table too small for a fit
is one part; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of the fit's sample, neighbours in its graph, parts, hidden units, held-out recall.
SAMPLE, EDGES, PARTS, HIDDEN, AIM = 6000, 10, 16, 64, 0.97
#: Vectors and queries of a cell, about.
CELL_VECTORS, CELL_QUERIES = 20_000, 2_000


def nearest(x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k rows of x nearest to each row of q (unordered beyond distance)."""
    out = []
    for at in range(0, len(q), 512):
        d = (x ** 2).sum(1)[None, :] - 2 * q[at:at + 512] @ x.T
        got = np.argpartition(d, min(k, len(x) - 1), axis=1)[:, :k]
        out.append(np.take_along_axis(got, np.argsort(np.take_along_axis(d, got, 1), 1), 1))
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def balanced(edges: np.ndarray, x: np.ndarray, parts: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """A partition of the graph into equal parts by capacity-bound label propagation.

    It starts from recursive halving along the widest direction; then, round
    by round, nodes ask for the part that holds most of their neighbours, and
    the strongest wishes are granted while a part has room.
    """
    n = len(x)
    label = np.zeros(n, np.int64)
    for _ in range(int(math.log2(parts))):
        finer = np.zeros(n, np.int64)
        for p in np.unique(label):
            rows = np.flatnonzero(label == p)
            c = x[rows] - x[rows].mean(0)
            axis = np.linalg.eigh(c.T @ c)[1][:, -1]
            finer[rows] = 2 * p + (np.argsort(np.argsort(c @ axis, kind="stable"), kind="stable") >= len(rows) // 2)
        label = finer
    cap = math.ceil(1.05 * n / parts)
    rng = np.random.RandomState(seed)
    votes = np.zeros((n, parts), np.int32)
    for _ in range(rounds):
        votes[:] = 0
        for j in range(edges.shape[1]):
            np.add.at(votes, (np.arange(n), label[edges[:, j]]), 1)
            np.add.at(votes, (edges[:, j], label), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.lexsort((rng.rand(n), -gain)):
            if gain[i] <= 0:
                break
            if size[want[i]] < cap and rng.rand() < 0.7:
                size[label[i]] -= 1
                size[want[i]] += 1
                label[i] = want[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """The classifier and the number of parts to probe."""

    shift: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def train(x: np.ndarray, target: np.ndarray, parts: int, epochs: int = 40, seed: int = 11) -> Router:
    """Cross-entropy against the spread of each point's neighbours over the parts, by Adam."""
    rng = np.random.RandomState(seed)
    shift, scale = x.mean(0), float(x.std() or 1.0)
    p = [rng.randn(x.shape[1], HIDDEN) * math.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.randn(HIDDEN, parts) * math.sqrt(1 / HIDDEN), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z = (x - shift) / scale
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at:at + 256]
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            o = h @ p[2] + p[3]
            o = np.exp(o - o.max(1, keepdims=True))
            d = (o / o.sum(1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ p[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((z[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= 0.005 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Router(shift, scale, *p, probes=parts)


def fit(x: np.ndarray, parts: int = PARTS, aim: float = AIM) -> Router | None:
    """A router from the sample; None (one part) if the sample is too small."""
    if len(x) < 20 * parts:
        return None
    held = np.arange(len(x)) % 6 == 0
    own, out = x[~held], x[held]
    edges = nearest(own, own, EDGES + 1)[:, 1:]
    label = balanced(edges, own, parts)
    spread = np.zeros((len(own), parts))
    for j in range(edges.shape[1]):
        spread[np.arange(len(own)), label[edges[:, j]]] += 1
    spread[np.arange(len(own)), label] += 1
    router = train(own, spread / spread.sum(1, keepdims=True), parts)
    part = router.ranked(own)[:, 0]
    true = nearest(own, out, 10)
    order = router.ranked(out)
    place = np.argsort(order, axis=1)  # of each part in a held-out point's ranking
    need = np.take_along_axis(place, part[true], 1)
    recall = [(need < k).mean() for k in range(1, parts + 1)]
    router.probes = next(k for k, r in enumerate(recall, 1) if r >= aim or k == parts)
    return router


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    e = F.transform("embedding", lambda c: c.cast("double"))
    v = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = v.filter(F.coalesce(fine, F.lit(False)) & F.exists("embedding", lambda c: c != 0))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _stack(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, parts: int = PARTS, aim: float = AIM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest vectors but itself.

    All vectors of one call have the same length.
    """
    base = cut(usable(vectors))
    asked = cut(usable(queries))
    got = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    x = np.array([r["embedding"] for r in got], float)
    router = fit(x, parts, aim) if len(got) else None
    n, m = base.count(), asked.count()
    probes, used = (router.probes, parts) if router else (1, 1)
    v_blocks = max(1, math.ceil(n / used / CELL_VECTORS))
    q_blocks = max(1, math.ceil(m * probes / used / CELL_QUERIES))

    def route(most: int, sizes: np.ndarray | None = None):
        """The ``most`` likeliest parts, and with ``sizes`` as many more as it takes to hold k vectors and the query's own."""
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                ids = b.column("vec_id")
                top = router.ranked(_stack(b.column("embedding"))) if router else np.zeros((len(b), 1), np.int64)
                if sizes is None:
                    lists = top[:, :most].tolist()
                else:
                    need = np.maximum((np.cumsum(sizes[top], axis=1) <= k).sum(1) + 1, most)
                    lists = [t[:n].tolist() for t, n in zip(top, need, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, b.column("embedding"), pa.array(lists, pa.list_(pa.int32()))], names=["vec_id", "embedding", "parts"])
        return rows

    routed = "vec_id long, embedding array<double>, parts array<int>"
    held = np.zeros(used, np.int64)
    if router:  # a row for each part
        for r in base.mapInArrow(route(1), routed).groupBy(F.col("parts")[0].alias("part")).count().collect():
            held[r["part"]] = r["count"]

    def dealt(df: DataFrame, to, own: int, other: int, first: bool) -> DataFrame:
        """A row for each part to probe and each block of the other side."""
        block = F.pmod(F.xxhash64("vec_id"), F.lit(own)).cast("int")
        x = (df.mapInArrow(to, routed)
             .select("vec_id", "embedding", F.explode("parts").alias("part"))
             .withColumn("mine", block).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))))
        return x.select("vec_id", "embedding", "part", F.col("mine" if first else "theirs").alias("vb"), F.col("theirs" if first else "mine").alias("qb"))

    def cell(_key, v: pa.Table, q: pa.Table) -> pa.Table:
        vid, qid = v.column("vec_id").to_numpy(), q.column("vec_id").to_numpy()
        out = ([], [], [])
        if len(v) and len(q):
            a, b = _stack(v.column("embedding").combine_chunks()), _stack(q.column("embedding").combine_chunks())
            for at in range(0, len(b), 64):
                part = b[at:at + 64]
                rough = (a ** 2).sum(1)[None, :] - 2 * part @ a.T
                rough[qid[at:at + 64, None] == vid[None, :]] = np.inf
                # Rounding of the quick form is far below this margin; exact distances decide.
                top = np.partition(rough, min(k, len(a)) - 1, axis=1)[:, min(k, len(a)) - 1]
                slack = 1e-9 * ((a ** 2).sum(1).max() + (part ** 2).sum(1)) + 1e-300
                for i in range(len(part)):
                    near = np.flatnonzero((rough[i] <= top[i] + slack[i]) & (rough[i] < np.inf))
                    d = np.sqrt(((a[near] - part[i]) ** 2).sum(1))
                    for j in np.lexsort((vid[near], d))[:k]:
                        out[0].append(qid[at + i]), out[1].append(vid[near[j]]), out[2].append(d[j])
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    left = dealt(base, route(1), v_blocks, q_blocks, True)
    right = dealt(asked, route(probes, held if router else None), q_blocks, v_blocks, False)
    found = (left.groupBy("part", "vb", "qb").cogroup(right.groupBy("part", "vb", "qb"))
             .applyInArrow(cell, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
