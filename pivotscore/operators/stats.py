"""Group statistics over a long fact table (summary, ANOVA, η², extremes).

Every statistic is one ``groupBy`` pass that yields per-group (n, Σx, M2)
-- a map-side partial aggregate, so a hot group costs nothing extra -- and a
second aggregate over the (tiny) group table.  Nothing collects a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import METRIC_HIGHER_IS_BETTER
from ..functions.pvalues import f_pvalue


def direction(metric: str) -> int:
    """+1 when higher is better, -1 otherwise (TER)."""
    return 1 if METRIC_HIGHER_IS_BETTER.get(metric, True) else -1


def summary_by(df: DataFrame, group: str, metric: str, by: list[str] = ("translator",)) -> DataFrame:
    """Mean, sample SD, non-null n per group, 4 dp, best first (``rank``)."""
    by = list(by)
    g = (df.groupBy(*by, group)
         .agg(F.round(F.avg(metric), 4).alias("mean"), F.round(F.stddev_samp(metric), 4).alias("std"),
              F.count(metric).alias("n")))
    w = Window.partitionBy(*by).orderBy((F.col("mean") * -direction(metric)).asc_nulls_last(),
                                        F.col(group))
    return g.withColumn("rank", F.row_number().over(w))


def group_moments(df: DataFrame, factor: str, metric: str, by: list[str]) -> DataFrame:
    """Per (by, factor level): n, mean, M2 (sum of squared deviations)."""
    return (df.filter(F.col(factor).isNotNull())
            .groupBy(*by, factor)
            .agg(F.count(metric).alias("n_g"), F.avg(metric).alias("mean_g"),
                 (F.var_pop(metric) * F.count(metric)).alias("m2_g")))


def anova_raw(df: DataFrame, factor: str, metric: str, by: list[str] = ("translator",)) -> DataFrame:
    """Unrounded ANOVA sums: by..., n, k, ssb, ssw."""
    by = list(by)
    g = group_moments(df, factor, metric, by)
    tot = g.groupBy(*by).agg(
        F.sum("n_g").alias("n"), F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("mean_g") * F.col("n_g")) / F.sum("n_g")).alias("grand"))
    j = g.join(tot, by) if by else g.crossJoin(tot)
    return j.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("k").alias("k"),
        F.sum(F.col("n_g") * F.pow(F.col("mean_g") - F.col("grand"), 2)).alias("ssb"),
        F.sum(F.coalesce("m2_g", F.lit(0.0))).alias("ssw"))


def f_stat() -> Column:
    return F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1),
                        F.try_divide(F.col("ssw"), F.col("n") - F.col("k")))


def eta2() -> Column:
    return F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw"))


def anova(df: DataFrame, factor: str, metric: str, by: list[str] = ("translator",)) -> DataFrame:
    """One-way ANOVA of ``metric`` across ``factor`` within each ``by`` group.

    Returns by..., factor, metric, F, p, df_between, df_within, ss_between,
    ss_within, ss_total, eta_squared.  Rows with a NULL factor are left out of
    every sum; a level whose values are all NULL still counts as a group.
    """
    by = list(by)
    s = anova_raw(df, factor, metric, by)
    return s.select(
        *by, F.lit(factor).alias("factor"), F.lit(metric).alias("metric"),
        F.round(f_stat(), 4).alias("F"),
        f_pvalue(f_stat(), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")).alias("p"),
        (F.col("k") - 1).cast("int").alias("df_between"),
        (F.col("n") - F.col("k")).cast("int").alias("df_within"),
        F.round("ssb", 6).alias("ss_between"), F.round("ssw", 6).alias("ss_within"),
        F.round(F.col("ssb") + F.col("ssw"), 6).alias("ss_total"),
        F.round(eta2(), 6).alias("eta_squared"))


def variance_decomposition(df: DataFrame, metric: str, by: list[str] = ("translator",),
                           factors: tuple[str, ...] = ("family", "domain")) -> DataFrame:
    """SS (3 dp) and η² (4 dp) per factor, plus a total row (η² = 1)."""
    by = list(by)
    parts = [anova_raw(df, f, metric, by).withColumn("factor", F.lit(f)) for f in factors]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    rows = u.select(*by, "factor", F.round("ssb", 3).alias("ss"), F.round(eta2(), 4).alias("eta_squared"))
    total = parts[0].select(*by, F.lit("total").alias("factor"),
                            F.round(F.col("ssb") + F.col("ssw"), 3).alias("ss"),
                            F.lit(1.0).alias("eta_squared"))
    return rows.unionByName(total)


def stack_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metrics -> (keys..., metric, value)."""
    present = [m for m in metrics if m in df.columns]
    expr = "stack({n}, {items}) as (metric, value)".format(
        n=len(present), items=", ".join(f"'{m}', cast(`{m}` as double)" for m in present))
    return df.selectExpr(*[f"`{k}`" for k in keys], expr)


def eta2_all_metrics(df: DataFrame, metrics: list[str], by: list[str] = ("translator",)) -> DataFrame:
    """η² of family and domain for every metric in one plan, with the ratio."""
    by = list(by)
    long = stack_metrics(df, by + ["family", "domain"], metrics)
    fam = anova_raw(long, "family", "value", by + ["metric"]).select(*by, "metric", eta2().alias("ef"))
    dom = anova_raw(long, "domain", "value", by + ["metric"]).select(*by, "metric", eta2().alias("ed"))
    j = fam.join(dom, by + ["metric"])
    return j.select(*by, "metric", F.round("ef", 6).alias("eta2_family"),
                    F.round("ed", 6).alias("eta2_domain"),
                    F.round(F.try_divide(F.col("ef"), F.col("ed")), 4).alias("ratio"))


def headline(df: DataFrame, metric: str = "bleu") -> DataFrame:
    """Per translator, η² of family vs domain, their ratio, F and n."""
    fam = anova_raw(df, "family", metric).select("translator", eta2().alias("ef"), f_stat().alias("ff"))
    dom = anova_raw(df, "domain", metric).select("translator", eta2().alias("ed"), f_stat().alias("fd"))
    n = df.groupBy("translator").agg(F.count(F.lit(1)).alias("n"))
    j = n.join(fam, "translator").join(dom, "translator")
    return j.select("translator", "n", F.round("ef", 6).alias("eta2_family"),
                    F.round("ff", 4).alias("f_family"), F.round("ed", 6).alias("eta2_domain"),
                    F.round("fd", 4).alias("f_domain"),
                    F.round(F.try_divide(F.col("ef"), F.col("ed")), 4).alias("ratio"))


def best_worst_gap(df: DataFrame, factor: str, metric: str, by: list[str] = ("translator",)) -> DataFrame:
    """Best and worst group mean (ties -> smaller key) and the gap."""
    by = list(by)
    means = df.groupBy(*by, factor).agg(F.avg(metric).alias("mean"))
    d = direction(metric)
    best = F.min_by(F.struct(F.col(factor), F.col("mean")), F.struct(F.col("mean") * -d, F.col(factor)))
    worst = F.min_by(F.struct(F.col(factor), F.col("mean")), F.struct(F.col("mean") * d, F.col(factor)))
    g = means.groupBy(*by).agg(best.alias("b"), worst.alias("w"))
    return g.select(*by, F.lit(factor).alias("factor"), F.lit(metric).alias("metric"),
                    F.col("b")[factor].alias("best"), F.round(F.col("b")["mean"], 4).alias("best_mean"),
                    F.col("w")[factor].alias("worst"), F.round(F.col("w")["mean"], 4).alias("worst_mean"),
                    F.round(F.col("b")["mean"] - F.col("w")["mean"], 4).alias("gap"))


def top_n_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """Rows ranked 1..n per ``by`` group.

    Spark limits each group to n rows per task before the shuffle (window
    group limit), so a hot group sends n rows from each task and no more.
    ``order`` must be a total order (add key columns).
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def extreme_cells(df: DataFrame, metric: str, n: int = 5, by: list[str] = ("translator",),
                  keys: tuple[str, ...] = ("family", "language", "domain")) -> DataFrame:
    """Best and worst ``n`` cells per group, direction-aware.

    Ties are broken by the cell keys (the order is total, so the result is
    deterministic).
    """
    by, keys = list(by), list(keys)
    d = direction(metric)
    base = df.filter(F.col(metric).isNotNull()).select(*by, *keys, metric)
    best = top_n_per_group(base, by, [(F.col(metric) * -d).asc()] + [F.col(k) for k in keys], n)
    worst = top_n_per_group(base, by, [(F.col(metric) * d).asc()] + [F.col(k) for k in keys], n)
    return (best.withColumn("kind", F.lit("best"))
            .unionByName(worst.withColumn("kind", F.lit("worst")))
            .select(*by, "kind", "rank", *keys, F.round(metric, 4).alias(metric)))


def coverage(df: DataFrame, keys: list[str], metrics: list[str], by: str = "translator") -> DataFrame:
    """Rows, distinct members, duplicate cells and NULL metrics per group."""
    dup = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1)
           .groupBy(by).agg(F.sum(F.col("c") - 1).alias("duplicates")))
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.countDistinct(k).alias(f"n_{k}") for k in keys if k != by]
    aggs += [F.sum(F.col(m).isNull().cast("int")).alias(f"null_{m}") for m in metrics]
    base = df.groupBy(by).agg(*aggs)
    return base.join(dup, by, "left").fillna(0, subset=["duplicates"])
