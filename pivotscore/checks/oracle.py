"""DuckDB SQL that recomputes each registered query from the raw tables.

These strings are the correctness oracle: the same answers, written
independently as plain SQL over the parquet views (region, nation, supplier,
part, lineitem, documents, conversations, embeddings, ...).  Shared pieces
are composed as CTEs.
"""

from __future__ import annotations

PIV = ("piv AS (SELECT r_name AS family, n_name AS language, n_nationkey AS code, "
       "r_regionkey AS family_ord, n_nationkey AS lang_ord "
       "FROM nation JOIN region ON n_regionkey = r_regionkey)")

def _mean(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / count(*)"


CELLS = ("cells AS (SELECT l_linestatus AS translator, family, language, p_type AS domain, "
         f"{_mean('l_discount')} AS cosine, {_mean('l_extendedprice')} / 1000 AS bleu, "
         f"{_mean('l_quantity')} AS ter, {_mean('l_tax')} AS embedding "
         "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey "
         "JOIN piv ON s_nationkey = code GROUP BY ALL)")

BASE = [PIV, CELLS]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def anova_raw(name: str, src: str, factor: str, metric: str, by: list[str]) -> list[str]:
    """CTE ``name``(by..., n, k, ssb, ssw)."""
    b = ", ".join(by)
    bsel = (b + ", ") if by else ""
    join = f"JOIN {name}_t USING ({b})" if by else f"CROSS JOIN {name}_t"
    grp = f"GROUP BY {b}" if by else ""
    return [
        f"{name}_g AS (SELECT {bsel}{factor}, count({metric}) AS n_g, avg({metric}) AS mean_g, "
        f"var_pop({metric}) * count({metric}) AS m2_g FROM {src} WHERE {factor} IS NOT NULL "
        f"GROUP BY {bsel}{factor})",
        f"{name}_t AS (SELECT {bsel}sum(n_g) AS n, count(*) AS k, sum(mean_g * n_g) / sum(n_g) AS grand "
        f"FROM {name}_g {grp})",
        f"{name} AS (SELECT {bsel}any_value(n) AS n, any_value(k) AS k, "
        f"sum(n_g * pow(mean_g - grand, 2)) AS ssb, sum(coalesce(m2_g, 0)) AS ssw "
        f"FROM {name}_g {join} {grp})",
    ]


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


def f_stat(p: str = "") -> str:
    return div(div(f"{p}ssb", f"{p}k - 1"), div(f"{p}ssw", f"{p}n - {p}k"))


def eta2(p: str = "") -> str:
    return div(f"{p}ssb", f"{p}ssb + {p}ssw")


F_STAT = f_stat()
ETA2 = eta2()


def anova_select(by: list[str], factor: str, metric: str, src: str) -> str:
    bsel = "".join(f"{x}, " for x in by)
    return (f"SELECT {bsel}'{factor}' AS factor, '{metric}' AS metric, round({F_STAT}, 4) AS \"F\", "
            f"CAST(k - 1 AS INTEGER) AS df_between, CAST(n - k AS INTEGER) AS df_within, "
            f"round(ssb, 6) AS ss_between, round(ssw, 6) AS ss_within, round(ssb + ssw, 6) AS ss_total, "
            f"round({ETA2}, 6) AS eta_squared FROM {src}")


def stack(src: str, keys: list[str], metrics: list[str], name: str) -> str:
    parts = [f"SELECT {', '.join(keys)}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {src}"
             for m in metrics]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


METRICS4 = ["cosine", "bleu", "ter", "embedding"]
METRICS3 = ["cosine", "bleu", "ter"]


def summary_sql(group: str, metric: str) -> str:
    order = "DESC" if metric != "ter" else "ASC"
    return with_(BASE, f"""SELECT translator, {group}, round(avg({metric}), 4) AS mean,
 round(stddev_samp({metric}), 4) AS std, count({metric}) AS n,
 row_number() OVER (PARTITION BY translator ORDER BY round(avg({metric}), 4) {order} NULLS LAST, {group}) AS rank
 FROM cells GROUP BY translator, {group}""")


def anova_sql(factor: str, metric: str, by: list[str]) -> str:
    src = "cells"
    return with_(BASE + anova_raw("a", src, factor, metric, by), anova_select(by, factor, metric, "a"))


def headline_sql() -> str:
    ctes = BASE + anova_raw("fa", "cells", "family", "bleu", ["translator"]) + \
        anova_raw("da", "cells", "domain", "bleu", ["translator"])
    return with_(ctes, f"""SELECT translator, nn.n AS n,
 round({eta2('fa.')}, 6) AS eta2_family, round({f_stat('fa.')}, 4) AS f_family,
 round({eta2('da.')}, 6) AS eta2_domain, round({f_stat('da.')}, 4) AS f_domain,
 round({div(eta2('fa.'), eta2('da.'))}, 4) AS ratio
 FROM (SELECT translator, count(*) AS n FROM cells GROUP BY translator) nn
 JOIN fa USING (translator) JOIN da USING (translator)""")


def variance_decomposition_sql(metric: str) -> str:
    ctes = BASE + anova_raw("fa", "cells", "family", metric, ["translator"]) + \
        anova_raw("da", "cells", "domain", metric, ["translator"])
    return with_(ctes, f"""SELECT translator, 'family' AS factor, round(ssb, 3) AS ss, round({ETA2}, 4) AS eta_squared FROM fa
 UNION ALL SELECT translator, 'domain', round(ssb, 3), round({ETA2}, 4) FROM da
 UNION ALL SELECT translator, 'total', round(ssb + ssw, 3), 1.0 FROM fa""")


def eta2_all_sql() -> str:
    ctes = BASE + [stack("cells", ["translator", "family", "domain"], METRICS4, "lng")] + \
        anova_raw("fa", "lng", "family", "value", ["translator", "metric"]) + \
        anova_raw("da", "lng", "domain", "value", ["translator", "metric"])
    ef, ed = eta2("fa."), eta2("da.")
    return with_(ctes, f"""SELECT translator, metric, round({ef}, 6) AS eta2_family, round({ed}, 6) AS eta2_domain,
 round({div(ef, ed)}, 4) AS ratio FROM fa JOIN da USING (translator, metric)""")


def best_worst_sql(factor: str, metric: str) -> str:
    d = "DESC" if metric != "ter" else "ASC"
    w = "ASC" if metric != "ter" else "DESC"
    return with_(BASE + [f"m AS (SELECT translator, {factor}, avg({metric}) AS mean FROM cells GROUP BY ALL)",
                         f"r AS (SELECT *, row_number() OVER (PARTITION BY translator ORDER BY mean {d}, {factor}) AS rb, "
                         f"row_number() OVER (PARTITION BY translator ORDER BY mean {w}, {factor}) AS rw FROM m)"],
                 f"""SELECT b.translator, '{factor}' AS factor, '{metric}' AS metric, b.{factor} AS best,
 round(b.mean, 4) AS best_mean, w.{factor} AS worst, round(w.mean, 4) AS worst_mean, round(b.mean - w.mean, 4) AS gap
 FROM r b JOIN r w ON b.translator = w.translator AND b.rb = 1 AND w.rw = 1""")


def extreme_sql(metric: str, n: int) -> str:
    d = "DESC" if metric != "ter" else "ASC"
    w = "ASC" if metric != "ter" else "DESC"
    return with_(BASE, f"""SELECT translator, kind, rank, family, language, domain, round({metric}, 4) AS {metric} FROM (
 SELECT translator, 'best' AS kind, row_number() OVER (PARTITION BY translator ORDER BY {metric} {d}, family, language, domain) AS rank,
  family, language, domain, {metric} FROM cells WHERE {metric} IS NOT NULL
 UNION ALL
 SELECT translator, 'worst', row_number() OVER (PARTITION BY translator ORDER BY {metric} {w}, family, language, domain),
  family, language, domain, {metric} FROM cells WHERE {metric} IS NOT NULL) WHERE rank <= {n}""")


def coverage_sql() -> str:
    return with_(BASE + ["d AS (SELECT translator, sum(c - 1) AS duplicates FROM (SELECT translator, family, language, domain, count(*) AS c FROM cells GROUP BY ALL HAVING count(*) > 1) GROUP BY translator)"],
                 """SELECT b.*, coalesce(d.duplicates, 0) AS duplicates FROM (
 SELECT translator, count(*) AS rows, count(DISTINCT family) AS n_family, count(DISTINCT language) AS n_language,
 count(DISTINCT domain) AS n_domain, sum(CAST(cosine IS NULL AS INTEGER)) AS null_cosine,
 sum(CAST(bleu IS NULL AS INTEGER)) AS null_bleu, sum(CAST(ter IS NULL AS INTEGER)) AS null_ter,
 sum(CAST(embedding IS NULL AS INTEGER)) AS null_embedding FROM cells GROUP BY translator) b
 LEFT JOIN d USING (translator)""")


def corr_matrix_sql() -> str:
    ms = METRICS3
    pairs = [(a, b) for a in ms for b in ms if a != b]
    sel = " UNION ALL ".join(
        f"SELECT translator, '{a}' AS m1, '{b}' AS m2, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM c3 GROUP BY translator"
        for a, b in pairs)
    return with_(BASE + ["c3 AS (SELECT * FROM cells WHERE cosine IS NOT NULL AND bleu IS NOT NULL AND ter IS NOT NULL)"], sel)


CORR_PAIRS = [("bleu", "cosine"), ("bleu", "embedding"), ("cosine", "embedding"), ("bleu", "ter")]
OLS_PAIRS = [("bleu", "cosine"), ("bleu", "embedding"), ("cosine", "embedding")]


def corr_pooled_sql() -> str:
    parts = []
    for a, b in CORR_PAIRS:
        parts.append(f"SELECT CASE WHEN grouping(translator) = 1 THEN 'pooled' ELSE translator END AS scope, "
                     f"'{a}~{b}' AS pair, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM cells "
                     f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ROLLUP (translator)")
    return with_(BASE, " UNION ALL ".join(parts))


def ols_sql() -> str:
    parts = []
    for x, y in OLS_PAIRS:
        parts.append(f"SELECT translator, '{x}' AS x, '{y}' AS y, round(regr_slope({y}, {x}), 6) AS slope, "
                     f"round(regr_intercept({y}, {x}), 6) AS intercept, regr_count({y}, {x}) AS n FROM cells "
                     f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY translator HAVING regr_count({y}, {x}) >= 2")
    return with_(BASE, " UNION ALL ".join(parts))


def avg_rank(v: str, part: str) -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {v}) + "
            f"(count(*) OVER (PARTITION BY {part}, {v}) - 1) / 2.0)")


def xcells_cte() -> str:
    cols_a = ", ".join(f"a.{m} AS {m}_a" for m in METRICS4)
    cols_b = ", ".join(f"b.{m} AS {m}_b" for m in METRICS4)
    return (f"x AS (SELECT a.translator AS translator_a, b.translator AS translator_b, a.family, a.language, a.domain, "
            f"{cols_a}, {cols_b} FROM cells a JOIN cells b ON a.family = b.family AND a.language = b.language "
            f"AND a.domain = b.domain AND a.translator < b.translator)")


def cross_backend_sql() -> str:
    cols = ", ".join(f"round({m}_{k}, 6) AS {m}_{k}" for k in "ab" for m in METRICS4)
    return with_(BASE + [xcells_cte()], f"SELECT translator_a, translator_b, family, language, domain, {cols} FROM x")


def spearman_cells_sql() -> str:
    parts = []
    for m in METRICS4:
        parts.append(f"SELECT translator_a, translator_b, round(corr(ra, rb), 6) AS rho, count(*) AS n, '{m}' AS metric FROM ("
                     f"SELECT translator_a, translator_b, {avg_rank(m + '_a', 'translator_a, translator_b')} AS ra, "
                     f"{avg_rank(m + '_b', 'translator_a, translator_b')} AS rb FROM x WHERE {m}_a IS NOT NULL AND {m}_b IS NOT NULL) "
                     f"GROUP BY translator_a, translator_b")
    return with_(BASE + [xcells_cte()], " UNION ALL ".join(parts))


def agreement_sql() -> str:
    parts = [f"SELECT translator_a, translator_b, '{m}' AS metric, {m}_a AS va, {m}_b AS vb FROM x" for m in METRICS4]
    lng = "lng AS (" + " UNION ALL ".join(parts) + ")"
    k = "translator_a, translator_b, metric"
    return with_(BASE + [xcells_cte(), lng, "l2 AS (SELECT * FROM lng WHERE va IS NOT NULL AND vb IS NOT NULL)"],
                 f"""SELECT p.*, s.rho FROM (SELECT {k}, round(corr(va, vb), 6) AS r, round(avg(va), 4) AS mean_a,
 round(avg(vb), 4) AS mean_b, count(*) AS n FROM l2 GROUP BY {k}) p JOIN
 (SELECT {k}, round(corr(ra, rb), 6) AS rho FROM (SELECT {k}, {avg_rank('va', k)} AS ra, {avg_rank('vb', k)} AS rb FROM l2) GROUP BY {k}) s
 USING (translator_a, translator_b, metric)""")


def gmeans_cte(factor: str, metric: str) -> str:
    return f"g AS (SELECT translator, {factor}, avg({metric}) AS mean FROM cells GROUP BY ALL)"


def backend_delta_sql(factor: str, metric: str) -> str:
    return with_(BASE + [gmeans_cte(factor, metric)], f"""SELECT a.translator AS translator_a, b.translator AS translator_b,
 a.{factor}, round(a.mean, 4) AS mean_a, round(b.mean, 4) AS mean_b, round(b.mean - a.mean, 4) AS delta
 FROM g a JOIN g b ON a.{factor} = b.{factor} AND a.translator < b.translator""")


def spearman_groups_sql(factor: str, metric: str) -> str:
    k = "translator_a, translator_b"
    return with_(BASE + [gmeans_cte(factor, metric),
                         f"j AS (SELECT a.translator AS translator_a, b.translator AS translator_b, a.mean AS va, b.mean AS vb "
                         f"FROM g a JOIN g b ON a.{factor} = b.{factor} AND a.translator < b.translator)"],
                 f"""SELECT {k}, round(corr(ra, rb), 6) AS rho, count(*) AS n, '{factor}' AS factor FROM (
 SELECT {k}, {avg_rank('va', k)} AS ra, {avg_rank('vb', k)} AS rb FROM j WHERE va IS NOT NULL AND vb IS NOT NULL) GROUP BY {k}""")


def kendall_sql(factor: str, x: str, y: str) -> str:
    return with_(BASE + [f"g AS (SELECT translator, {factor}, avg({x}) AS x, avg({y}) AS y FROM cells GROUP BY ALL)",
                         f"j AS (SELECT a.translator, a.x AS xa, b.x AS xb, a.y AS ya, b.y AS yb FROM g a JOIN g b "
                         f"ON a.translator = b.translator AND a.{factor} < b.{factor})",
                         "s AS (SELECT translator, sum(sign(xa - xb) * sign(ya - yb)) AS s, count(*) AS n0, "
                         "sum(CAST(xa = xb AS INTEGER)) AS tx, sum(CAST(ya = yb AS INTEGER)) AS ty FROM j GROUP BY translator)"],
                 f"""SELECT translator, '{factor}' AS factor, '{x}~{y}' AS pair,
 round({div('s', 'sqrt((n0 - tx) * (n0 - ty))')}, 6) AS tau, n0 AS n_pairs FROM s""")


def group_ranks_sql(factor: str) -> str:
    return with_(BASE + [stack("cells", ["translator", factor], METRICS4, "lng"),
                         f"g AS (SELECT translator, metric, {factor}, avg(value) AS mean FROM lng GROUP BY ALL)"],
                 f"""SELECT translator, metric, {factor}, round(mean, 4) AS mean,
 row_number() OVER (PARTITION BY translator, metric ORDER BY round(mean, 4) * (CASE WHEN metric = 'ter' THEN 1.0 ELSE -1.0 END), {factor}) AS rank
 FROM g""")


def rank_movement_sql(factor: str, metric: str) -> str:
    order = "ASC" if metric == "ter" else "DESC"
    return with_(BASE + [gmeans_cte(factor, metric),
                         f"r AS (SELECT translator, {factor}, row_number() OVER (PARTITION BY translator ORDER BY round(mean, 4) {order}, {factor}) AS rank FROM g)"],
                 f"""SELECT a.{factor}, a.translator AS translator_a, a.rank AS rank_a, b.translator AS translator_b,
 b.rank AS rank_b, a.rank - b.rank AS movement FROM r a JOIN r b ON a.{factor} = b.{factor} AND a.translator < b.translator""")


def mean_sd_sql(keys: list[str], metrics: list[str]) -> str:
    k = ", ".join(keys)
    return with_(BASE + [stack("cells", keys, metrics, "lng")],
                 f"""SELECT {k}, metric, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, count(value) AS n
 FROM lng GROUP BY {k}, metric""")


def box_sql(keys: list[str], metric: str) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"c.{x} = s.{x}" for x in keys)
    return with_(BASE + [f"cl AS (SELECT * FROM cells WHERE {metric} IS NOT NULL)",
                         f"s AS (SELECT {k}, count(*) AS n, quantile_cont({metric}, 0.25) AS q1, quantile_cont({metric}, 0.5) AS median, "
                         f"quantile_cont({metric}, 0.75) AS q3 FROM cl GROUP BY {k})",
                         f"w AS (SELECT {', '.join('s.' + x for x in keys)}, min(CASE WHEN {metric} >= q1 - 1.5 * (q3 - q1) THEN {metric} END) AS whisker_lo, "
                         f"max(CASE WHEN {metric} <= q3 + 1.5 * (q3 - q1) THEN {metric} END) AS whisker_hi, "
                         f"sum(CAST(({metric} < q1 - 1.5 * (q3 - q1)) OR ({metric} > q3 + 1.5 * (q3 - q1)) AS INTEGER)) AS n_outliers "
                         f"FROM cl c JOIN s ON {on} GROUP BY {', '.join('s.' + x for x in keys)})"],
                 f"""SELECT {k}, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
 round(whisker_lo, 4) AS whisker_lo, round(whisker_hi, 4) AS whisker_hi,
 round(median - 1.57 * (q3 - q1) / sqrt(n), 4) AS notch_lo, round(median + 1.57 * (q3 - q1) / sqrt(n), 4) AS notch_hi,
 n_outliers FROM s JOIN w USING ({k})""")


def radar_sql() -> str:
    return with_(BASE, """SELECT translator, family, round(avg(cosine), 6) AS cosine, round(avg(bleu) / 100, 6) AS bleu_scaled,
 round(1 - avg(ter) / 100, 6) AS ter_scaled FROM cells WHERE cosine IS NOT NULL AND bleu IS NOT NULL AND ter IS NOT NULL
 GROUP BY translator, family""")


def scale_flags_sql(limits: dict) -> str:
    vals = ", ".join(f"('{m}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for m, (lo, hi) in limits.items())
    return with_(BASE + [stack("cells", ["translator"], METRICS4, "lng"),
                         f"lim(metric, vmin, vmax) AS (VALUES {vals})",
                         """g AS (SELECT translator, metric, any_value(vmin) AS vmin, any_value(vmax) AS vmax,
 round(min(value), 4) AS min, round(max(value), 4) AS max, sum(CAST(value < vmin AS INTEGER)) AS n_below,
 sum(CAST(value > vmax AS INTEGER)) AS n_above FROM lng JOIN lim USING (metric) GROUP BY translator, metric)"""],
                 """SELECT *, CASE WHEN n_below > 0 AND n_above > 0 THEN 'both' WHEN n_below > 0 THEN 'min'
 WHEN n_above > 0 THEN 'max' ELSE 'neither' END AS extend FROM g""")


def spot_sql(family: str, domain: str, metric: str, thr: float) -> str:
    return with_(BASE, f"""SELECT translator, language, domain, round({metric}, 4) AS {metric}, {metric} > {thr} AS above
 FROM cells WHERE family = '{family}' AND domain = '{domain}'""")


def wide_sql(domains: list[str], metrics: list[str]) -> str:
    cols = []
    for d in domains:
        for m in metrics:
            cols.append(f"round(max(CASE WHEN domain = '{d}' THEN {m} END), 6) AS {d.lower().replace(' ', '_')}_{m}")
    cols += [f"round(avg({m}), 6) AS topical_{m}" for m in metrics]
    return with_(BASE, f"SELECT translator, family, language, {', '.join(cols)}, count(*) AS n_cells FROM cells "
                       f"GROUP BY translator, family, language")


def heatmap_sql(domains: list[str], metric: str) -> str:
    cols = [f"round(avg(CASE WHEN domain = '{d}' THEN {metric} END), 6) AS {d.lower().replace(' ', '_')}_{metric}"
            for d in domains]
    return with_(BASE, f"SELECT translator, family, language, {', '.join(cols)} FROM cells GROUP BY translator, family, language")


def zscore_sql(metric: str, zlim: float) -> str:
    return with_(BASE + [f"m AS (SELECT translator, language, domain, avg({metric}) AS v FROM cells GROUP BY ALL)",
                         "s AS (SELECT translator, avg(v) AS mu, stddev_pop(v) AS sd FROM m GROUP BY translator)",
                         "z AS (SELECT m.*, CASE WHEN sd = 0 THEN 0.0 ELSE (v - mu) / sd END AS zz FROM m JOIN s USING (translator))"],
                 f"SELECT translator, language, domain, round(v, 6) AS {metric}, round(zz, 6) AS z, abs(zz) > {zlim} AS beyond_limit FROM z")


def bands_sql() -> str:
    return with_(BASE + ["p AS (SELECT DISTINCT language FROM cells)",
                         "j AS (SELECT p.language, coalesce(piv.family, 'unclassified') AS family, "
                         "coalesce(piv.family_ord, 1073741824) AS fo, coalesce(piv.lang_ord, 0) AS lo "
                         "FROM p LEFT JOIN piv USING (language))",
                         "r AS (SELECT *, row_number() OVER (ORDER BY fo, lo, language) - 1 AS row FROM j)",
                         "b AS (SELECT family, min(row) AS start, max(row) + 1 AS stop FROM r GROUP BY family)"],
                 "SELECT language, family, row, start, stop FROM r JOIN b USING (family)")


def labels_sql(overrides: dict, metric_rows: list[tuple]) -> str:
    ov = ", ".join(f"('{k}', '{v}')" for k, v in overrides.items())
    mets = " UNION ALL ".join(
        f"SELECT 'metric' AS kind, '{m}' AS k, '{lab} ({'higher' if hb else 'lower'} is better)' AS label"
        for m, hb, lab in metric_rows)
    initcap = ("array_to_string(list_transform(string_split(replace(lower(k), '_', ' '), ' '), "
               "lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ')")
    return with_(BASE + [f"ov(k, o) AS (VALUES {ov})", "fk AS (SELECT DISTINCT family AS k FROM piv)"],
                 f"SELECT 'family' AS kind, k, coalesce(o, {initcap}) AS label FROM fk LEFT JOIN ov USING (k) "
                 f"UNION ALL {mets}")


# ---- p-values: the regularised incomplete beta function by its continued fraction ---- #

#: Terms of the fraction; it settles after some square root of the degrees of freedom.
TERMS = 400
STARS = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END"


def betainc_ctes(src: str) -> list[str]:
    """CTE ``bi``(id, value): I_x(a, b) of the rows of ``src``(id, a, b, x) with 0 < x < 1."""
    # Term k + 1, with m its half rounded down.
    d = ("CASE WHEN k % 2 = 0 THEN -(u + m) * (u + v + m) * y / ((u + 2 * m) * (u + 2 * m + 1)) "
         "ELSE m * (v - m) * y / ((u + 2 * m - 1) * (u + 2 * m)) END")
    return [
        f"bs AS MATERIALIZED (SELECT id, x <= a / (a + b) AS below, CASE WHEN x <= a / (a + b) THEN a ELSE b END AS u, "
        f"CASE WHEN x <= a / (a + b) THEN b ELSE a END AS v, CASE WHEN x <= a / (a + b) THEN x ELSE 1 - x END AS y FROM {src})",
        "bf(id, k, p0, q0, p1) AS (SELECT id, 0, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM bs UNION ALL "
        "SELECT id, k + 1, p1 / q, 1.0 / q, p / q FROM (SELECT id, k, p1, p1 + d * p0 AS p, 1.0 + d * q0 AS q FROM "
        f"(SELECT f.*, {d} AS d FROM (SELECT bf.*, u, v, y, (k + 1) // 2 AS m FROM bf JOIN bs USING (id) WHERE k < {TERMS}) f)))",
        "bi AS (SELECT id, CASE WHEN below THEN t ELSE 1 - t END AS value FROM (SELECT id, below, "
        "exp(lgamma(u + v) - lgamma(u) - lgamma(v) + u * ln(y) + v * ln(1 - y)) * p1 / u AS t "
        f"FROM bf JOIN bs USING (id) WHERE k = {TERMS}))"]


def anova_p_sql() -> str:
    """One-way ANOVA of bleu by family and by domain, with its p-value (10 digits) and its mark."""
    both = " UNION ALL ".join(f"SELECT translator, '{f}' AS factor, n, k, ssb, ssw FROM {c}" for f, c in (("family", "fa"), ("domain", "da")))
    ctes = [*BASE, *anova_raw("fa", "cells", "family", "bleu", ["translator"]), *anova_raw("da", "cells", "domain", "bleu", ["translator"]),
            f"s AS MATERIALIZED (SELECT row_number() OVER () AS id, *, {F_STAT} AS f FROM ({both}))",
            "src AS (SELECT id, (n - k) / 2.0 AS a, (k - 1) / 2.0 AS b, (n - k) / ((n - k) + (k - 1) * f) AS x FROM s WHERE f > 0 AND k > 1 AND n > k)",
            *betainc_ctes("src"),
            "t AS (SELECT s.*, CASE WHEN f IS NULL OR k <= 1 OR n <= k THEN 'nan'::DOUBLE WHEN f <= 0 THEN 1.0 ELSE value END AS p "
            "FROM s LEFT JOIN bi USING (id))"]
    return with_(ctes, f"SELECT translator, factor, 'bleu' AS metric, round(f, 4) AS \"F\", round(p, 10) AS p, CAST(k - 1 AS INTEGER) AS df_between, "
                 f"CAST(n - k AS INTEGER) AS df_within, round(ssb, 6) AS ss_between, round(ssw, 6) AS ss_within, round(ssb + ssw, 6) AS ss_total, "
                 f"round({ETA2}, 6) AS eta_squared, {STARS} AS sig FROM t").replace("WITH ", "WITH RECURSIVE ", 1)


def corr_pvalues_sql() -> str:
    """Pearson r per backend and pooled, with its two-sided p-value (10 digits) and its mark."""
    parts = [f"SELECT CASE WHEN grouping(translator) = 1 THEN 'pooled' ELSE translator END AS scope, '{a}~{b}' AS pair, "
             f"round(corr({a}, {b}), 6) AS r, count(*) AS n FROM cells WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ROLLUP (translator)"
             for a, b in CORR_PAIRS]
    ctes = [*BASE, f"s AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM ({' UNION ALL '.join(parts)}))",
            "src AS (SELECT id, n / 2.0 - 1 AS a, 0.5::DOUBLE AS b, 1 - r * r AS x FROM s WHERE n >= 3 AND abs(r) < 1 AND r <> 0)",
            *betainc_ctes("src"),
            "t AS (SELECT s.*, CASE WHEN r IS NULL OR isnan(r) OR n < 3 THEN 'nan'::DOUBLE WHEN abs(r) >= 1 THEN 0.0 WHEN r = 0 THEN 1.0 "
            "ELSE value END AS p FROM s LEFT JOIN bi USING (id))"]
    return with_(ctes, f"SELECT scope, pair, r, n, round(p, 10) AS p, {STARS} AS sig FROM t").replace("WITH ", "WITH RECURSIVE ", 1)
