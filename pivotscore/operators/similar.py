"""Exact Jaccard join of sets of hashes: every set's smallest similar one.

Which sets can be similar is told by shared hashes alone, so no pair at the
threshold is missed.  A set is dropped if fewer of its hashes than the
threshold asks for occur in any other set.  Of the others, two similar sets
share a hash among their rarest ones (prefix filter; every set orders its
hashes alike).  The sets that hold such a hash are a group; groups of the same
members count once.

Candidates are verified before anything is closed over them.  First every set
is compared with its groups' smallest members, if the sizes allow it, so a
large group of near copies costs one comparison a member.  A set that is
similar to the smallest of them all is done, since no smaller one is possible.
Only the sets that are left are compared with all members of their groups,
block by block, and keep the smallest similar one; pairs are never written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import subpath

#: Sets of a block, and columns of the matrix products that count shared hashes.
BLOCK, COLUMNS = 256, 16_384
_NONE = np.iinfo(np.int64).max


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back."""
    path = subpath(df.sparkSession, f"similar-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it comes in fewer splits than there are cores; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of two lists of sets."""
    out = np.zeros((len(one), len(two)), np.float32)
    x, y = np.concatenate(one), np.concatenate(two)
    common = np.intersect1d(x, y)
    sides = []
    for sets, flat in ((one, x), (two, y)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        keep = np.isin(flat, common)
        col = np.searchsorted(common, flat[keep])
        order = np.argsort(col, kind="stable")
        sides.append((row[keep][order], col[order]))
    for at in range(0, len(common), COLUMNS):  # exact: the sums stay far below 2**24
        parts = []
        for (row, col), sets in zip(sides, (one, two), strict=True):
            lo, hi = np.searchsorted(col, [at, at + COLUMNS])
            m = np.zeros((len(sets), min(COLUMNS, len(common) - at)), np.float32)
            m[row[lo:hi], col[lo:hi] - at] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def groups(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(grp, id, n, low, low_n, members): the sets of ``sets(id, n, hs)`` that share one of their rarest hashes.

    ``low`` is the group's smallest id and ``low_n`` the size of that set.
    """
    # Every hash is moved once, by itself: it is counted where it is looked up.
    tokens = sets.select("id", "n", F.explode("hs").alias("h")).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h")))
    least = F.ceil(F.lit(num) * F.col("n") / F.lit(den)).cast("int")  # hashes that a similar set shares
    known = (tokens.filter("c > 1").groupBy("id", "n").agg(F.collect_list(F.struct("c", "h")).alias("known"))  # bounded by one set
             .withColumn("spare", F.size("known") - least).filter("spare >= 0"))
    rare = cut(known.select("id", "n", F.explode(F.slice(F.sort_array("known"), F.lit(1), F.col("spare") + 1)).alias("x")).select("id", "n", "x.h"))
    mark = F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)"))
    held = (rare.groupBy("h").agg(F.min(F.struct("id", "n")).alias("first"), F.count(F.lit(1)).alias("members"), mark.alias("mark"))
            .filter("members > 1"))
    once = cut(held.groupBy("first", "members", "mark").agg(F.min("h").alias("h")).drop("mark"))
    return cut(rare.join(once, "h").select(F.col("h").alias("grp"), "id", "n", F.col("first.id").alias("low"), F.col("first.n").alias("low_n"), "members"))


def compare(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """(id, best): the smallest similar id below each set of side 0 among the sets of side 1 in its cells.

    ``dealt(cell, side, id, hs)``; a cell is compared in one task, so it has a bounded number of sets.
    """
    def test(rows: list[tuple]) -> pa.RecordBatch:
        side, ids = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        best = np.zeros(0, np.int64)
        if len(left) and len(right):
            both = shared([rows[k][2] for k in left], [rows[k][2] for k in right]).astype(np.int64)
            n = np.array([len(r[2]) for r in rows], np.int64)
            near = (den * both >= num * (n[left][:, None] + n[right][None, :] - both)) & (ids[right][None, :] < ids[left][:, None])
            best = np.where(near, ids[right][None, :], _NONE).min(1)
        found = left[:len(best)][best < _NONE]
        return pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(best[best < _NONE])], names=["id", "best"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            hashes = b.column("hs")
            for k, (cell, side, i) in enumerate(zip(*(b.column(c).to_pylist() for c in ("cell", "side", "id")), strict=True)):
                if held and cell != now:
                    yield test(held)
                    held = []
                now = cell
                held.append((side, i, hashes[k].values.to_numpy()))
        if held:
            yield test(held)

    found = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(cells, "id long, best long")
    return found.groupBy("id").agg(F.min("best").alias("best"))


def with_smallest(held: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, best): comparison of each set with its groups' smallest members, ``BLOCK`` sets to a cell.

    A group's smallest member is copied once for each block of sets that need it.
    """
    pairs = cut(held.filter("id > low").filter(F.lit(den) * F.least("n", "low_n") >= F.lit(num) * F.greatest("n", "low_n"))
                .select("id", "low").distinct())
    blocks = pairs.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    upper = pairs.join(blocks, "low").select(F.xxhash64("low", own).alias("cell"), F.lit(0).alias("side"), "id")
    lower = (blocks.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.xxhash64("low", "own").alias("cell"), F.lit(1).alias("side"), F.col("low").alias("id")))
    return compare(upper.unionByName(lower).join(sets.select("id", "hs"), "id").select("cell", "side", "id", "hs"), num, den)


def with_all(held: DataFrame, left: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, best): comparison of the sets ``left(id)`` with all smaller ones of their groups, block by block."""
    groups_ = held.filter("members > 2")  # a group of two has been compared
    open_ = groups_.join(left, "id", "left_semi")
    sizes = cut(open_.groupBy("grp").agg(F.count(F.lit(1)).alias("open"), F.max("members").alias("members"), F.max("id").alias("top"))
                .select("grp", "top", *[F.ceil(F.col(c) / F.lit(BLOCK)).cast("int").alias(c) for c in ("open", "members")]))

    def deal(rows, mine, others, side):
        block = F.pmod(F.xxhash64("id", F.lit(side)), F.col(mine).cast("long")).cast("int")
        place = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        both = rows.select("grp", "id").join(sizes, "grp").filter("id <= top").withColumn("own", block).withColumn("other", place)
        cell = F.xxhash64("grp", "own", "other") if side == 0 else F.xxhash64("grp", "other", "own")
        return both.select(cell.alias("cell"), F.lit(side).alias("side"), "id")

    dealt = deal(open_, "open", "members", 0).unionByName(deal(groups_, "members", "open", 1))
    return compare(dealt.join(sets.select("id", "hs"), "id").select("cell", "side", "id", "hs"), num, den)


def smallest(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, best): the smallest id below a set's own whose Jaccard similarity reaches the threshold.

    ``sets(id, n, hs)`` with distinct ids and n distinct hashes each.
    """
    num, den = Fraction(str(threshold)).as_integer_ratio()
    held = groups(sets, num, den)
    first = cut(with_smallest(held, sets, num, den))
    possible = held.groupBy("id").agg(F.min("low").alias("possible"), F.max("members").alias("most"))
    left = cut(possible.filter("possible < id and most > 2").join(first, "id", "left").filter("best is null or best > possible").select("id"))
    return first.unionByName(with_all(held, left, sets, num, den)).groupBy("id").agg(F.min("best").alias("best"))
