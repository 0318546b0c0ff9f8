"""Relations between metrics and between backends.

Correlations are single-pass aggregates (``corr``, ``regr_*``) with
GROUPING SETS for the pooled row.  Rank statistics (Spearman, Kendall) run
over *group tables* -- cells or group means -- whose size is bounded by the
dimension cardinalities (languages x domains), not by the data volume.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import stack_metrics

CELL = ["family", "language", "domain"]


def corr_matrix(df: DataFrame, metrics: list[str], by: str = "translator") -> DataFrame:
    """Pearson r of every ordered metric pair per group, listwise NULL drop,
    diagonal left out."""
    present = [m for m in metrics if m in df.columns]
    clean = df.dropna(subset=present)
    aggs = [F.corr(a, b).alias(f"{a}__{b}") for a, b in combinations(present, 2)]
    aggs.append(F.count(F.lit(1)).alias("n"))
    g = clean.groupBy(by).agg(*aggs)
    pairs = [(a, b) for a in present for b in present if a != b]
    items = ", ".join(
        f"'{a}', '{b}', `{a}__{b}`" if (a, b) in combinations(present, 2) else f"'{a}', '{b}', `{b}__{a}`"
        for a, b in pairs)
    return g.selectExpr(by, "n", f"stack({len(pairs)}, {items}) as (m1, m2, r)").select(
        by, "m1", "m2", F.round("r", 6).alias("r"), "n")


def corr_pooled(df: DataFrame, pairs: list[tuple[str, str]], by: str = "translator") -> DataFrame:
    """Pearson r per group and pooled (GROUPING SETS ((by), ())), pairwise drop."""
    frames = []
    for a, b in pairs:
        sub = df.dropna(subset=[a, b])
        g = sub.rollup(by).agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n"),
                               F.grouping(by).alias("_g"))
        frames.append(g.select(F.when(F.col("_g") == 1, F.lit("pooled")).otherwise(F.col(by)).alias("scope"),
                               F.lit(f"{a}~{b}").alias("pair"), F.round("r", 6).alias("r"), "n"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ols_fit(df: DataFrame, pairs: list[tuple[str, str]], by: str = "translator") -> DataFrame:
    """y = slope * x + intercept per group (needs >= 2 rows)."""
    frames = []
    for x, y in pairs:
        g = df.dropna(subset=[x, y]).groupBy(by).agg(
            F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
            F.regr_count(y, x).alias("n"))
        frames.append(g.filter(F.col("n") >= 2).select(
            by, F.lit(x).alias("x"), F.lit(y).alias("y"), F.round("slope", 6).alias("slope"),
            F.round("intercept", 6).alias("intercept"), "n"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def average_rank(value: str, part: list[str]):
    """Average rank (ties share the mean of their positions), as Spearman needs."""
    w = Window.partitionBy(*part).orderBy(F.col(value))
    wt = Window.partitionBy(*part, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0


def cross_backend_cells(df: DataFrame, metrics: list[str], keys: list[str] = CELL,
                        by: str = "translator") -> DataFrame:
    """Cells of two backends matched on keys (a < b), metrics suffixed."""
    a = df.select(F.col(by).alias("translator_a"), *keys, *[F.col(m).alias(f"{m}_a") for m in metrics])
    b = df.select(F.col(by).alias("translator_b"), *keys, *[F.col(m).alias(f"{m}_b") for m in metrics])
    return a.join(b, keys).filter(F.col("translator_a") < F.col("translator_b"))


def spearman(pairs: DataFrame, x: str, y: str, part: list[str]) -> DataFrame:
    """Spearman ρ = Pearson r of average ranks, per ``part`` group."""
    r = (pairs.dropna(subset=[x, y])
         .withColumn("_rx", average_rank(x, part)).withColumn("_ry", average_rank(y, part)))
    return r.groupBy(*part).agg(F.round(F.corr("_rx", "_ry"), 6).alias("rho"),
                                F.count(F.lit(1)).alias("n"))


def backend_agreement(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Per backend pair and metric: r, ρ, both means, matched n."""
    m = cross_backend_cells(df, metrics)
    long = None
    for met in metrics:
        part = m.select("translator_a", "translator_b", F.lit(met).alias("metric"),
                        F.col(f"{met}_a").alias("va"), F.col(f"{met}_b").alias("vb"))
        long = part if long is None else long.unionByName(part)
    keys = ["translator_a", "translator_b", "metric"]
    pear = long.dropna(subset=["va", "vb"]).groupBy(*keys).agg(
        F.round(F.corr("va", "vb"), 6).alias("r"), F.round(F.avg("va"), 4).alias("mean_a"),
        F.round(F.avg("vb"), 4).alias("mean_b"), F.count(F.lit(1)).alias("n"))
    return pear.join(spearman(long, "va", "vb", keys).drop("n"), keys)


def group_means(df: DataFrame, factor: str, metric: str, by: str = "translator") -> DataFrame:
    return df.groupBy(by, factor).agg(F.avg(metric).alias("mean"))


def backend_delta(df: DataFrame, factor: str, metric: str, by: str = "translator") -> DataFrame:
    """Group means of two backends side by side, with the difference."""
    g = group_means(df, factor, metric, by)
    a = g.select(F.col(by).alias("translator_a"), factor, F.col("mean").alias("mean_a"))
    b = g.select(F.col(by).alias("translator_b"), factor, F.col("mean").alias("mean_b"))
    j = a.join(b, factor).filter(F.col("translator_a") < F.col("translator_b"))
    return j.select("translator_a", "translator_b", factor, F.round("mean_a", 4).alias("mean_a"),
                    F.round("mean_b", 4).alias("mean_b"),
                    F.round(F.col("mean_b") - F.col("mean_a"), 4).alias("delta"))


def spearman_groups(df: DataFrame, factor: str, metric: str, by: str = "translator") -> DataFrame:
    """Spearman ρ between two backends' group-mean rankings."""
    g = group_means(df, factor, metric, by)
    a = g.select(F.col(by).alias("translator_a"), factor, F.col("mean").alias("va"))
    b = g.select(F.col(by).alias("translator_b"), factor, F.col("mean").alias("vb"))
    j = a.join(b, factor).filter(F.col("translator_a") < F.col("translator_b"))
    return spearman(j, "va", "vb", ["translator_a", "translator_b"]).withColumn(
        "factor", F.lit(factor))


def spearman_cells(df: DataFrame, metrics: list[str]) -> DataFrame:
    """E13 cell level: ρ per metric between two backends' matched cells."""
    m = cross_backend_cells(df, metrics)
    out = None
    for met in metrics:
        s = spearman(m, f"{met}_a", f"{met}_b", ["translator_a", "translator_b"]).withColumn(
            "metric", F.lit(met))
        out = s if out is None else out.unionByName(s)
    return out


def kendall_tau(df: DataFrame, factor: str, x_metric: str, y_metric: str,
                by: str = "translator") -> DataFrame:
    """Kendall τ-b between the group-mean rankings by two metrics.

    Group count k is a dimension size, so the a < b self-join is k²/2 rows.
    """
    g = df.groupBy(by, factor).agg(F.avg(x_metric).alias("x"), F.avg(y_metric).alias("y"))
    a = g.select(by, F.col(factor).alias("fa"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = g.select(by, F.col(factor).alias("fb"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    j = a.join(b, by).filter(F.col("fa") < F.col("fb"))
    s = j.groupBy(by).agg(
        F.sum(F.signum(F.col("xa") - F.col("xb")) * F.signum(F.col("ya") - F.col("yb"))).alias("s"),
        F.count(F.lit(1)).alias("n0"),
        F.sum((F.col("xa") == F.col("xb")).cast("int")).alias("tx"),
        F.sum((F.col("ya") == F.col("yb")).cast("int")).alias("ty"))
    tau = F.try_divide(F.col("s"), F.sqrt((F.col("n0") - F.col("tx")) * (F.col("n0") - F.col("ty"))))
    return s.select(by, F.lit(factor).alias("factor"), F.lit(f"{x_metric}~{y_metric}").alias("pair"),
                    F.round(tau, 6).alias("tau"), F.col("n0").alias("n_pairs"))


def group_ranks(df: DataFrame, factor: str, metrics: list[str], by: str = "translator") -> DataFrame:
    """rank of each group per (backend, metric), best = 1, ties by key."""
    long = stack_metrics(df, [by, factor], metrics)
    g = long.groupBy(by, "metric", factor).agg(F.avg("value").alias("mean"))
    sign = F.when(F.col("metric") == "ter", F.lit(1.0)).otherwise(F.lit(-1.0))
    w = Window.partitionBy(by, "metric").orderBy((F.round("mean", 4) * sign).asc(), F.col(factor))
    return g.select(by, "metric", factor, F.round("mean", 4).alias("mean"),
                    F.row_number().over(w).alias("rank"))


def rank_movement(df: DataFrame, factor: str, metric: str, by: str = "translator") -> DataFrame:
    """a group's rank under two backends and the move between them."""
    r = group_ranks(df, factor, [metric], by)
    a = r.select(F.col(by).alias("translator_a"), factor, F.col("rank").alias("rank_a"))
    b = r.select(F.col(by).alias("translator_b"), factor, F.col("rank").alias("rank_b"))
    return (a.join(b, factor).filter(F.col("translator_a") < F.col("translator_b"))
            .withColumn("movement", F.col("rank_a") - F.col("rank_b")))


def asymmetry(rt: DataFrame) -> DataFrame:
    """|mean ABA cosine - mean BAB cosine| per (translator, language);
    a language missing either direction is dropped."""
    g = rt.groupBy("translator", "language").agg(
        F.avg(F.when(F.col("direction") == "ABA", F.col("cosine"))).alias("aba"),
        F.avg(F.when(F.col("direction") == "BAB", F.col("cosine"))).alias("bab"))
    return (g.filter(F.col("aba").isNotNull() & F.col("bab").isNotNull())
            .select("translator", "language", F.round(F.abs(F.col("aba") - F.col("bab")), 4).alias("asymmetry")))



def language_sets(df: DataFrame, by: str = "translator") -> DataFrame:
    """Languages that only one of two backends has (both 0: the sets agree).

    One row per backend and language is compared, not the facts.
    """
    has = df.select(by, "language").distinct()
    names = has.select(by).distinct()
    pairs = names.select(F.col(by).alias(f"{by}_a")).join(names.select(F.col(by).alias(f"{by}_b")), F.col(f"{by}_a") < F.col(f"{by}_b"))
    held = has.groupBy(by).agg(F.collect_set("language").alias("langs"))
    a = held.select(F.col(by).alias(f"{by}_a"), F.col("langs").alias("la"))
    b = held.select(F.col(by).alias(f"{by}_b"), F.col("langs").alias("lb"))
    j = pairs.join(a, f"{by}_a").join(b, f"{by}_b")
    return j.select(f"{by}_a", f"{by}_b", F.size(F.array_except("la", "lb")).cast("long").alias("n_only_a"),
                    F.size(F.array_except("lb", "la")).cast("long").alias("n_only_b"))
