"""N-gram Jaccard join by chosen paths.

A document is the set of its word shingles.  Equal sets are collapsed first
and carry the number of their documents.  Each distinct set is embedded by
min-hashing into a fixed number of tokens (coordinate, minimum), of which two
sets share the fraction that is their Jaccard similarity.  A run splits all
sets recursively: at a node each set picks a few of its tokens by a hash of
the node's path and the token, and goes on to the nodes named after them, so
similar sets tend to pick a shared token.  Buckets of at most ``LIMIT`` sets
are compared pair by pair; larger ones are split again.  Runs are repeated
until the chance of missing a pair at the threshold is below ``MISS``; all
runs go through the cluster side by side.  A bucket that is still too large
after the deepest split is compared in blocks, so nothing is dropped.

A bucket gives no list of pairs but a forest that connects its similar sets.
The first ``FIRST`` runs go ahead; what they connect is a known group, and the
other runs only add edges between groups: a bucket that holds one known group
and nothing else is left out, neither split nor compared, and one that holds
a known group and at most ``WIDE * LIMIT`` other sets is not split, as only
these are compared, with blocks of the group.  Before a larger bucket is
split, all its sets are compared with ``PIVOTS`` of them, which connects most
of a large group of copies in the first runs.  So such a group gives its
edges once and is not split in every run.
The forests' components are the candidate groups; inside each, all pairs are
checked exactly on the whole shingle sets, block by block for large groups,
and give each set's number of links and again a forest.  So what is written
and shuffled grows with the sets, not with the pairs.

Defined results: words are as written; a text of one to four words is one
shingle, its word list; a text without words, or null, links to nothing and
is a class of its own; repeated rows and equal shingle sets are copies and
link to each other; a null id is never chosen as class id unless its class
has no other; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, components, cut, row_key

WORDS = re.compile(WORD)
#: Words of a shingle, tokens of the embedding, sets of a brute-forced bucket, deepest split.
SHINGLE, TOKENS, LIMIT, DEEPEST = 5, 64, 1024, 3
#: The similarity at which a set keeps one chosen token on average; below the
#: threshold, so that the splitting of true pairs does not die out.
PICK = 0.6
#: The chance of missing a pair at the threshold through all runs.
MISS = 1e-5
#: A larger bucket is split only if so many times LIMIT of its sets are outside its largest known group.
WIDE = 4
#: Runs that go ahead of the others; sets of a large bucket (on average) that all its sets are compared with before it is split.
FIRST, PIVOTS = 4, 64
#: Bits of the filter that keeps other texts out of the exact check's shuffle: a bound, whatever the input's size.
FILTER_BITS = 1 << 26
#: Sets of a block in the exact check, and columns of its matrix products.
BLOCK, COLUMNS = 256, 16_384
_SLACK = 0.25  # of the estimate from the embedding, five standard deviations
_RNG = np.random.RandomState(7)
_MUL = _RNG.randint(1, 2 ** 62, TOKENS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.randint(1, 2 ** 62, TOKENS).astype(np.uint64)
_POW = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = WORDS.findall(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[str, int] = {}
    h = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words),
                    np.uint64, len(words))
    width = min(size, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = (out + h[k:k + len(out)]) * _POW[k % len(_POW)]
        out ^= out >> np.uint64(29)
    return np.unique(mix(out + np.uint64(width)))


def embed(s: np.ndarray) -> np.ndarray:
    """The set's minimum under each of ``TOKENS`` hash functions."""
    low = np.full(TOKENS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(s), 512):
        np.minimum(low, (s[at:at + 512, None] * _MUL + _ADD).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def survival(depth: int, threshold: float) -> float:
    """Chance that a pair at the threshold still meets after ``depth`` splits."""
    q, mean = 1.0, threshold / PICK
    for _ in range(depth):
        q = 1 - math.exp(-mean * q)
    return q


def runs(threshold: float) -> int:
    """Runs that bring the chance of a miss below MISS, even where all splits are needed."""
    return math.ceil(math.log(MISS) / math.log(1 - survival(DEEPEST, threshold)))


def chosen(nodes: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child nodes of the tokens that the rows' sets pick at their nodes."""
    token = mix(sigs.astype(np.uint64) + (np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)))
    child = mix(token ^ mix(nodes)[:, None])
    at, k = np.nonzero(mix(child + np.uint64(0x51ED)) < np.uint64(int(2 ** 64 / (PICK * TOKENS))))
    return at, child[at, k]


def sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, rk, sid, n, sig, mark): every row's set id, set size and embedding; sid null without words."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, n, sig, mark = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, size)
                n.append(len(s))
                sid.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                low = embed(s) if len(s) else None
                sig.append(low.tobytes() if len(s) else None)
                mark.append((low & np.uint32(0xFF)).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), pa.array(sid, pa.binary()), pa.array(n, pa.int32()),
                                              pa.array(sig, pa.binary()), pa.array(mark, pa.binary())], names=["doc_id", "rk", "sid", "n", "sig", "mark"])

    return (docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("rk"), "text")
            .mapInArrow(rows, "doc_id long, rk binary, sid binary, n int, sig binary, mark binary"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def split(nodes: DataFrame, run_numbers: range | None = None) -> DataFrame:
    """(node, sid, grp): one split of ``nodes(node, sid, sig, grp)``, or the first one of each of the runs."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, ids, grp = _matrix(b.column("sig")), b.column("sid"), b.column("grp")
            for start in ([np.full(len(ids), r + 1, np.uint64) for r in run_numbers] if run_numbers
                          else [b.column("node").to_numpy().view(np.uint64)]):
                at, child = chosen(start, sigs)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), ids.take(pa.array(at)), grp.take(pa.array(at))],
                                                 names=["node", "sid", "grp"])

    cols = ["sid", "sig", "grp"] if run_numbers else ["node", "sid", "sig", "grp"]
    return nodes.select(*cols).mapInArrow(rows, "node long, sid binary, grp long")


def forest(n: int, pairs, known: tuple = ((), ())) -> list[tuple[int, int]]:
    """Edges that connect what the pairs (two arrays each) of 0..n-1 connect and the ``known`` pairs don't."""
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(*known, strict=True):
        i, j = top(i), top(j)
        up[max(i, j)] = min(i, j)
    out = []
    for x, y in pairs:
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            i, j = top(i), top(j)
            if i != j:
                up[max(i, j)] = min(i, j)
                out.append((i, j))
    return out


def compare(cells: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a forest of the pairs inside a cell that the embeddings and sizes allow.

    ``cells(cell, side, sid, n, mark, grp)``: with side -1 a cell's sets are
    all compared, else those of side 0 with those of side 1; sets of side -1
    beside some of side 1 are compared with all of the cell.  A mark holds
    the last byte of each token, so it never hides an agreement.  Sets of the
    same ``grp`` (0: none) are connected already.
    """
    least = math.floor(TOKENS * (threshold - _SLACK))

    def allowed(i, j, same, n):
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        return (same >= least) & (low >= threshold * high - 1e-9)

    def few(starts, size, n, sig):
        """Pairs in all the cells of one small size at once."""
        p, q = np.triu_indices(size, 1)
        for at in range(0, len(starts), max(1, 20_000 // len(p))):
            first = starts[at:at + max(1, 20_000 // len(p)), None]
            i, j = (first + p).ravel(), (first + q).ravel()
            keep = allowed(i, j, (sig[i] == sig[j]).sum(1), n)
            yield i[keep], j[keep]

    def many(s, e, side, n, sig):
        """Pairs in one larger cell, by rows of 64, only against sets of a near enough size."""
        left = s + np.flatnonzero(side[s:e] != 1)
        right = s + np.flatnonzero(side[s:e] != 0)
        left, right = left[np.argsort(n[left], kind="stable")], right[np.argsort(n[right], kind="stable")]
        for at in range(0, len(left), 64):
            rows = left[at:at + 64]
            lo = np.searchsorted(n[right], math.floor(n[rows[0]] * threshold))
            hi = np.searchsorted(n[right], math.ceil(n[rows[-1]] / threshold), side="right")
            cols = right[lo:hi]
            same = np.zeros((len(rows), len(cols)), np.int16)
            for k in range(TOKENS):
                same += sig[rows, k][:, None] == sig[cols, k][None, :]
            x, y = np.nonzero(same >= least)
            i, j = rows[x], cols[y]
            keep = allowed(i, j, same[x, y], n) & ((i < j) | (side[i] != side[j]))
            yield i[keep], j[keep]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            cell = held.column("cell").to_numpy()
            done = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on
            if done:
                yield from emit(held.slice(0, done))
                held = held.slice(done)
        if held is not None and len(held):
            yield from emit(held)

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, n = t.column("cell").to_numpy(), t.column("n").to_numpy()
        side = t.column("side").to_numpy()
        ids = t.column("sid").to_pylist()
        sig = np.frombuffer(b"".join(t.column("mark").to_pylist()), np.uint8).reshape(-1, TOKENS)
        grp = t.column("grp").to_numpy()
        grouped = np.flatnonzero(grp)
        grouped = grouped[np.lexsort((grp[grouped], cell[grouped]))]
        chain = (cell[grouped[1:]] == cell[grouped[:-1]]) & (grp[grouped[1:]] == grp[grouped[:-1]])
        known = (grouped[1:][chain].tolist(), grouped[:-1][chain].tolist())
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
        sizes, starts = np.diff(starts), starts[:-1]
        small = (sizes <= 32) & (side[starts] < 0)
        got = [x for z in np.unique(sizes[small & (sizes > 1)]) for x in few(starts[small & (sizes == z)], z, n, sig)]
        for k in np.flatnonzero(~small & (sizes > 1)):
            got += many(starts[k], starts[k] + sizes[k], side, n, sig)
        # Cells share no row, so one forest over the rows holds each cell's own.
        found = {(ids[i], ids[j]) if ids[i] < ids[j] else (ids[j], ids[i]) for i, j in forest(len(ids), got, known)}
        a, b = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    dealt = cells.select("cell", "side", "sid", "n", "mark", "grp").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(rows, "a binary, b binary")


def candidates(distinct: DataFrame, threshold: float) -> DataFrame:
    """(id, root): groups that hold the candidate pairs of ``distinct(sid, n, sig, mark)`` from all runs."""
    every = runs(threshold)
    ahead = found_in(distinct.withColumn("grp", F.lit(0).cast("long")), range(min(FIRST, every)), threshold)
    groups = cut(components(ahead))
    if every <= FIRST:
        return groups
    named = groups.select(F.col("id").alias("sid"), F.xxhash64("root").alias("grp"))
    known = cut(distinct.join(named, "sid", "left").withColumn("grp", F.coalesce("grp", F.lit(0).cast("long"))))
    later = found_in(known, range(FIRST, every), threshold)
    return cut(components(ahead.unionByName(later)))


def found_in(known: DataFrame, run_numbers: range, threshold: float) -> DataFrame:
    """(a, b): forests of the candidate pairs of some runs, beyond the groups of ``known(sid, n, sig, mark, grp)``."""
    found = None
    nodes = split(known, run_numbers)
    sets_ = known.select("sid", "n", "mark", "grp").hint("merge")
    for depth in range(1, DEEPEST + 1):
        nodes = cut(nodes).repartition("node")  # counted and looked up in one exchange
        per = nodes.groupBy("node", "grp").agg(F.count(F.lit(1)).alias("rows"))
        most = F.max(F.when(F.col("grp") != 0, F.struct("rows", "grp")))
        sizes = (per.groupBy("node").agg(F.sum("rows").alias("members"), most.alias("most"))
                 .select("node", "members", F.coalesce("most.rows", F.lit(0)).alias("held"), F.coalesce("most.grp", F.lit(0)).alias("top"))
                 .filter("members > 1 and members > held"))
        filled = cut(nodes.join(sizes.hint("merge"), "node"))
        small = filled.filter(F.col("members") <= LIMIT).select(F.col("node").alias("cell"), F.lit(-1).alias("side"), "sid")
        strange = F.col("members") - F.col("held")  # sets outside the bucket's largest known group
        beside = filled.filter((F.col("members") > LIMIT) & (strange <= WIDE * LIMIT))
        large = filled.filter(strange > WIDE * LIMIT)
        pivot = F.pmod(F.xxhash64("node", "sid"), F.col("members")) < PIVOTS
        cells = (small.unionByName(everywhere(beside, (F.col("grp") == 0) | (F.col("grp") != F.col("top")), F.col("held")))
                 .unionByName(everywhere(large, pivot, F.col("members"))))
        got = cut(compare(cells.join(sets_, "sid"), threshold).distinct())
        found = got if found is None else found.unionByName(got)
        if not large.limit(1).count():
            return cut(found.distinct())
        if depth < DEEPEST:
            nodes = split(large.join(known.select("sid", "sig").hint("merge"), "sid").select("node", "sid", "sig", "grp"))
    # Still too large: every pair of blocks of such a bucket is a cell of its own.
    dealt = blocks(large, "node", F.col("members"), LIMIT)
    found = found.unionByName(compare(dealt.select("cell", "side", "sid").join(sets_, "sid"), threshold))
    return cut(found.distinct())


def bitmap(keys: DataFrame) -> np.ndarray:
    """Which of ``FILTER_BITS`` bits the keys' (``rk``) hashes set."""
    place = F.pmod(F.xxhash64("rk"), F.lit(FILTER_BITS))
    words = (keys.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rk), {FILTER_BITS}) % 64 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def marked(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``texts`` with ``likely``: false only if ``rk`` is surely none of the keys."""
    bits = bitmap(keys)

    @F.pandas_udf("boolean")
    def held(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((bits[at >> 6] >> (at & 63)) & 1 == 1)

    return texts.withColumn("likely", held(F.pmod(F.xxhash64("rk"), F.lit(FILTER_BITS))))


def blocks(members: DataFrame, key: str, count, size: int) -> DataFrame:
    """Deal the rows of a group (``key``, with ``count`` rows) into cells: one for each pair of its blocks."""
    n = F.ceil(count / size).cast("int")
    own = F.pmod(F.xxhash64("sid"), n.cast("long")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return (dealt.withColumn("cell", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")))
            .withColumn("side", F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))))


def everywhere(filled: DataFrame, few: Column, count: Column) -> DataFrame:
    """(cell, side, sid): large buckets (``node``) of which the ``few`` are compared with all.

    The other sets, ``count`` at most, are dealt into blocks, each once; the
    few go to every block and are compared with it and among each other.  As
    at most ``WIDE * LIMIT`` are few, the rows grow with the bucket's.
    """
    n = F.greatest(F.ceil(count / LIMIT), F.lit(1)).cast("int")
    at = F.when(few, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.pmod(F.xxhash64("sid"), n.cast("long")).cast("int")))
    return (filled.withColumn("few", few).withColumn("block", F.explode(at))
            .select(F.xxhash64("node", "block").alias("cell"), F.when(F.col("few"), -1).otherwise(1).alias("side"), "sid"))


def intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of two lists of sorted sets.

    Only hashes in both lists count; they become the columns of 0/1 matrices
    whose product, some columns at a time, is exact in single precision.
    """
    out = np.zeros((len(one), len(two)), np.float32)
    x, y = np.concatenate(one), np.concatenate(two)
    common = np.intersect1d(x, y) if one is not two else np.unique(x)
    rows = [np.repeat(np.arange(len(z)), [len(v) for v in z]) for z in (one, two)]
    cols = [np.searchsorted(common, v) for v in (x, y)]
    keep = [common[np.minimum(c, len(common) - 1)] == v if len(common) else np.zeros(len(v), bool) for c, v in zip(cols, (x, y), strict=True)]
    rows, cols = [r[k] for r, k in zip(rows, keep, strict=True)], [c[k] for c, k in zip(cols, keep, strict=True)]
    order = [np.argsort(c, kind="stable") for c in cols]
    rows, cols = [r[o] for r, o in zip(rows, order, strict=True)], [c[o] for c, o in zip(cols, order, strict=True)]
    for at in range(0, len(common), COLUMNS):
        m = []
        for r, c, z in zip(rows, cols, (one, two), strict=True):
            lo, hi = np.searchsorted(c, [at, at + COLUMNS])
            d = np.zeros((len(z), min(COLUMNS, len(common) - at)), np.float32)
            d[r[lo:hi], c[lo:hi] - at] = 1
            m.append(d)
        out += m[0] @ m[1].T
    return out


def verify(docs: DataFrame, distinct: DataFrame, groups: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Exact links inside the candidate groups: (sid, others) per set, and (a, b), a forest of the links.

    ``distinct(sid, rk, copies)`` names one row of each set, ``groups(id,
    root)`` the sets of each group.  Only these sets' texts are read again.
    A link counts with the copies of the set on its other end.
    """
    num, den = threshold.as_integer_ratio() if threshold != 0.8 else (4, 5)
    counts = groups.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    need = cut(groups.withColumnRenamed("id", "sid").join(distinct.select("sid", "rk", "copies"), "sid").join(counts, "root"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets_ = pa.array([shingles(t, size).tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("root"), b.column("members"), b.column("copies"), sets_],
                                             names=["sid", "root", "members", "copies", "set"])

    keyed = marked(docs.select(row_key("doc_id", "text").alias("rk"), "text"), need).filter("likely").drop("likely")
    texts = (keyed.join(need.hint("merge"), "rk")
             .groupBy("sid", "root", "members", "copies").agg(F.first("text").alias("text")))  # rows repeated whole
    whole = cut(texts.mapInArrow(hashes, "sid binary, root binary, members long, copies long, set binary"))
    dealt = blocks(whole, "root", F.col("members"), BLOCK).select("cell", "side", "sid", "copies", "set")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["cell"] != r["cell"]:
                    yield linked(held)
                    held = []
                held.append(r)
        if held:
            yield linked(held)

    def linked(rows: list[dict]) -> pa.RecordBatch:
        side, copies = np.array([r["side"] for r in rows]), np.array([r["copies"] for r in rows], np.int64)
        whole_sets = [np.frombuffer(r["set"], np.uint64) for r in rows]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        others, edges = np.zeros(len(rows), np.int64), []
        if len(left) and len(right):
            one = [whole_sets[k] for k in left]
            both = intersections(one, one if (side < 0).all() else [whole_sets[k] for k in right]).astype(np.int64)
            n = np.array([len(v) for v in whole_sets], np.int64)
            near = den * both >= num * (n[left][:, None] + n[right][None, :] - both)
            near &= left[:, None] != right[None, :]
            others[left] += near @ copies[right]
            if not (side < 0).all():
                others[right] += near.T @ copies[left]
            x, y = np.nonzero(near)
            edges = forest(len(rows), [(left[x], right[y])])
        a = [r["sid"] for r in rows] + [rows[i]["sid"] for i, _ in edges]
        b = [None] * len(rows) + [rows[j]["sid"] for _, j in edges]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([*others.tolist(), *[0] * len(edges)], pa.int64())],
                                          names=["a", "b", "others"])

    told = cut(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(test, "a binary, b binary, others long"))
    degree = told.filter("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("others").alias("others"))
    return degree, told.filter("b is not null").select("a", "b")


def classes(docs: DataFrame, size: int = SHINGLE, threshold: float = 0.8) -> DataFrame:
    """(doc_id, rk, class_id, class_key, n_links, n_copies) of every row.

    ``n_links`` counts the other rows whose similarity reaches the threshold,
    copies included; classes are the links' connected components, named by
    their smallest id (``class_key`` by a set, for grouping).
    """
    rows = cut(sets(docs, size))
    distinct = cut(rows.filter("sid is not null").groupBy("sid")
                   .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.min("rk").alias("rk"),
                        F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("mark").alias("mark")))
    groups = candidates(distinct.select("sid", "n", "sig", "mark"), threshold)
    degree, links = verify(docs, distinct, groups, size, threshold)
    root = components(links).select(F.col("id").alias("sid"), "root")
    named = (distinct.select("sid", "copies", "low").join(root, "sid", "left")
             .withColumn("root", F.coalesce("root", "sid")))
    lows = named.groupBy("root").agg(F.min("low").alias("class_id"))
    told = cut(named.join(lows, "root").join(degree, "sid", "left")
               .select("sid", "class_id", F.col("root").alias("class_key"),
                       (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")))
    linked = rows.filter("sid is not null").select("doc_id", "rk", "sid").join(told, "sid").drop("sid")
    alone = (rows.filter("sid is null")
             .select("doc_id", "rk", F.col("doc_id").alias("class_id"), F.lit(None).cast("binary").alias("class_key"),
                     F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")))
    return linked.select(*alone.columns).unionByName(alone)


def keep_one(docs: DataFrame, size: int = SHINGLE, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row of smallest id (then key) stays.

    Rows without words all stay.
    """
    told = cut(classes(docs, size, threshold))
    first = told.filter("class_key is not null").groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk"))["rk"].alias("rk"))
    often = told.groupBy("rk").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("class_key").isNull()).alias("alone"))
    named = often.join(first.withColumn("first", F.lit(True)), "rk", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    # Rows that go or are repeated; all others stay as they are and are not moved.
    special = cut(named.filter("not alone and not (rows = 1 and first)").select("rk", "first"))
    whole = docs.select(row_key("doc_id", "text").alias("rk"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = marked(whole, special)
    told = whole.filter("likely").join(special.hint("merge"), "rk", "left")
    once = told.filter("first").dropDuplicates(["rk"])
    return whole.filter("not likely").select("row.*").unionByName(told.filter("first is null").select("row.*")).unionByName(once.select("row.*"))
