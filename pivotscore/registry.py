"""Named queries over the driver's tables, and their DuckDB oracles.

Each query is ``(spark, sf_dir) -> DataFrame``.  Column names are the same
in the Spark result and in the oracle SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dims
from .checks import oracle as O
from .operators import marts, relate, stats
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed values of the table profile: the part types that play the domains.
TABLE_DOMAINS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
METRICS4 = ["cosine", "bleu", "ter", "embedding"]
METRICS3 = ["cosine", "bleu", "ter"]
SPOT = ("EUROPE", "PROMO", "bleu", 38.25)
# End of fixed values.


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _cells(spark, sf):
    return tables.cells(spark, sf)


def _cells_once(spark, sf):
    """The cells written once, for queries that use them more than once.

    Line items are scanned one time; the cells are bounded by the dimensions.
    """
    from .plans.translate import materialize
    return materialize(tables.cells(spark, sf), "cells")


# ---- statistics over the long fact table ---------------------------------- #

@register("headline", O.headline_sql())
def q_headline(spark, sf):
    return stats.headline(_cells_once(spark, sf), "bleu")


@register("summary_by_family", O.summary_sql("family", "bleu"))
def q_summary_family(spark, sf):
    return stats.summary_by(_cells(spark, sf), "family", "bleu")


@register("summary_by_domain", O.summary_sql("domain", "bleu"))
def q_summary_domain(spark, sf):
    return stats.summary_by(_cells(spark, sf), "domain", "bleu")


@register("summary_ter_by_family", O.summary_sql("family", "ter"))
def q_summary_ter(spark, sf):
    return stats.summary_by(_cells(spark, sf), "family", "ter")


@register("anova_family", O.anova_sql("family", "bleu", ["translator"]))
def q_anova_family(spark, sf):
    return stats.anova(_cells(spark, sf), "family", "bleu").drop("p")


@register("anova_domain", O.anova_sql("domain", "bleu", ["translator"]))
def q_anova_domain(spark, sf):
    return stats.anova(_cells(spark, sf), "domain", "bleu").drop("p")


@register("anova_translator", O.anova_sql("translator", "bleu", []))
def q_anova_translator(spark, sf):
    return stats.anova(_cells(spark, sf), "translator", "bleu", by=[]).drop("p")


@register("variance_decomposition", O.variance_decomposition_sql("bleu"))
def q_vardec(spark, sf):
    return stats.variance_decomposition(_cells_once(spark, sf), "bleu")


@register("eta2_all_metrics", O.eta2_all_sql())
def q_eta2_all(spark, sf):
    return stats.eta2_all_metrics(_cells_once(spark, sf), METRICS4)


@register("best_worst_family", O.best_worst_sql("family", "bleu"))
def q_best_worst_family(spark, sf):
    return stats.best_worst_gap(_cells(spark, sf), "family", "bleu")


@register("best_worst_domain", O.best_worst_sql("domain", "bleu"))
def q_best_worst_domain(spark, sf):
    return stats.best_worst_gap(_cells(spark, sf), "domain", "bleu")


@register("extreme_cells", O.extreme_sql("bleu", 5))
def q_extreme(spark, sf):
    return stats.extreme_cells(_cells(spark, sf), "bleu", 5)


@register("extreme_cells_ter", O.extreme_sql("ter", 3))
def q_extreme_ter(spark, sf):
    return stats.extreme_cells(_cells(spark, sf), "ter", 3)


@register("coverage", O.coverage_sql())
def q_coverage(spark, sf):
    return stats.coverage(_cells(spark, sf), ["translator", "family", "language", "domain"], METRICS4)


# ---- relations -------------------------------------------------------------- #

@register("corr_matrix", O.corr_matrix_sql())
def q_corr_matrix(spark, sf):
    return relate.corr_matrix(_cells(spark, sf), METRICS3)


@register("corr_pooled", O.corr_pooled_sql())
def q_corr_pooled(spark, sf):
    return relate.corr_pooled(_cells_once(spark, sf), O.CORR_PAIRS)


@register("ols_fit", O.ols_sql())
def q_ols(spark, sf):
    return relate.ols_fit(_cells_once(spark, sf), O.OLS_PAIRS)


@register("cross_backend_cells", O.cross_backend_sql())
def q_xcells(spark, sf):
    x = relate.cross_backend_cells(_cells_once(spark, sf), METRICS4)
    return x.select(*[F.round(c, 6).alias(c) if c[:-2] in METRICS4 else F.col(c) for c in x.columns])


@register("backend_agreement", O.agreement_sql())
def q_agreement(spark, sf):
    return relate.backend_agreement(_cells_once(spark, sf), METRICS4)


@register("backend_delta", O.backend_delta_sql("family", "bleu"))
def q_delta(spark, sf):
    return relate.backend_delta(_cells_once(spark, sf), "family", "bleu")


@register("spearman_cells", O.spearman_cells_sql())
def q_spearman_cells_once(spark, sf):
    return relate.spearman_cells(_cells_once(spark, sf), METRICS4)


@register("spearman_family", O.spearman_groups_sql("family", "bleu"))
def q_spearman_family(spark, sf):
    return relate.spearman_groups(_cells_once(spark, sf), "family", "bleu")


@register("spearman_domain", O.spearman_groups_sql("domain", "bleu"))
def q_spearman_domain(spark, sf):
    return relate.spearman_groups(_cells_once(spark, sf), "domain", "bleu")


@register("kendall_tau", O.kendall_sql("domain", "bleu", "cosine"))
def q_kendall(spark, sf):
    return relate.kendall_tau(_cells_once(spark, sf), "domain", "bleu", "cosine")


@register("group_ranks", O.group_ranks_sql("family"))
def q_group_ranks(spark, sf):
    return relate.group_ranks(_cells(spark, sf), "family", METRICS4)


@register("rank_movement", O.rank_movement_sql("family", "bleu"))
def q_rank_movement(spark, sf):
    return relate.rank_movement(_cells_once(spark, sf), "family", "bleu")


# ---- report tables ---------------------------------------------------------- #

@register("family_domain_bars", O.mean_sd_sql(["translator", "family", "domain"], METRICS3))
def q_fd_bars(spark, sf):
    return marts.mean_sd(_cells(spark, sf), ["translator", "family", "domain"], METRICS3)


@register("domain_bars", O.mean_sd_sql(["translator", "domain"], METRICS3))
def q_d_bars(spark, sf):
    return marts.mean_sd(_cells(spark, sf), ["translator", "domain"], METRICS3)


@register("box_stats", O.box_sql(["translator", "family"], "bleu"))
def q_box(spark, sf):
    return marts.box_stats(_cells(spark, sf), ["translator", "family"], "bleu")


@register("radar_profile", O.radar_sql())
def q_radar(spark, sf):
    return marts.radar_profile(_cells(spark, sf))


@register("scale_flags", O.scale_flags_sql(dims.SCALE_LIMITS))
def q_scale(spark, sf):
    return marts.scale_flags(_cells(spark, sf), METRICS4)


@register("spot_checks", O.spot_sql(*SPOT))
def q_spot(spark, sf):
    return marts.spot_checks(_cells(spark, sf), *SPOT)


@register("long_to_wide", O.wide_sql(TABLE_DOMAINS, METRICS4))
def q_wide(spark, sf):
    return marts.long_to_wide(_cells(spark, sf), TABLE_DOMAINS, METRICS4)


@register("heatmap_matrix", O.heatmap_sql(TABLE_DOMAINS, "bleu"))
def q_heatmap(spark, sf):
    return marts.heatmap_matrix(_cells(spark, sf), TABLE_DOMAINS, "bleu")


@register("zscore_cells", O.zscore_sql("bleu", dims.Z_LIMIT))
def q_zscore(spark, sf):
    return marts.zscore_cells(_cells(spark, sf), "bleu")


@register("family_bands", O.bands_sql())
def q_bands(spark, sf):
    return marts.family_bands(_cells(spark, sf), dims.pivots(spark, sf))


@register("display_labels", O.labels_sql(
    dims.FAMILY_DISPLAY_OVERRIDES,
    [(m, dims.METRIC_HIGHER_IS_BETTER[m], dims.METRIC_LABELS[m]) for m in dims.METRICS]))
def q_labels(spark, sf):
    return marts.display_labels(spark, dims.pivots(spark, sf))


# ---- text: sentences, requests, protocols, pair scores --------------------- #

from pyspark.sql import functions as F  # noqa: E402

from .checks import textsql as TS  # noqa: E402
from .operators import scoring  # noqa: E402
from .plans import protocols as P  # noqa: E402
from .plans import translate as TR  # noqa: E402
from .sources.cache_store import CacheStore, cache_key  # noqa: E402

BACKENDS = ["alpha", "beta"]


def _grid(spark, sf, rows):
    return P.fan(P.spread(rows), dims.pivots(spark, sf), P.backends_frame(spark, BACKENDS))


@register("load_sentences", TS.with_sent("SELECT domain, sent_id, doc_id, text FROM sent"))
def q_sentences(spark, sf):
    return tables.sentences(spark, sf)


@register("request_keys", TS.request_keys_sql())
def q_request_keys(spark, sf):
    g = P.fan_by_text(tables.sentences(spark, sf), dims.pivots(spark, sf), BACKENDS)
    return g.select("backend", F.lit("en").alias("src"), F.col("language").alias("tgt"), "sent_id",
                    cache_key(F.col("backend"), F.lit("en"), F.col("language"), F.col("text")).alias("key"))


@register("cell_grid", TS.cell_grid_sql())
def q_cell_grid(spark, sf):
    """Sentences are counted per domain before the grid is laid out."""
    per = tables.sentences(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("n_sentences"))
    return (P.fan(per, dims.pivots(spark, sf).select("family", "language"), P.backends_frame(spark, BACKENDS))
            .groupBy("backend", "family", "language", "domain").agg(F.sum("n_sentences").alias("n_sentences")))


@register("translate_step", TS.translate_step_sql())
def q_translate_step(spark, sf):
    def asked(rows):
        return _grid(spark, sf, rows).select("backend", "language", "sent_id", F.lit("en").alias("src"),
                                             F.col("language").alias("tgt"), F.lit(None).cast("int").alias("src_code"),
                                             F.col("code").alias("tgt_code"), "text")

    s = tables.sentences(spark, sf)
    texts = TR.materialize(P.distinct_texts(s), "texts")
    r = TR.resolve(asked(s), CacheStore.fresh(spark), BACKENDS, P.names(dims.pivots(spark, sf)), asked(texts))
    return r.select("backend", "language", "sent_id", "value", "failed")


@register("back_translate", TS.back_translate_sql())
def q_back_translate(spark, sf):
    s = tables.sentences(spark, sf)
    bt = P.back_translate_once(s, TR.materialize(P.distinct_texts(s), "texts"), dims.pivots(spark, sf), BACKENDS,
                               CacheStore.fresh(spark))
    return bt.select("backend", "family", "language", "domain", "sent_id", "forward", "back",
                     "forward_failed", "back_failed")


@register("back_translation_cells", TS.back_translation_cells_sql())
def q_bt_cells(spark, sf):
    return P.back_translation_cells(tables.sentences(spark, sf), dims.pivots(spark, sf), BACKENDS,
                                    CacheStore.fresh(spark))


def _chain(spark, sf):
    return P.telephone_chain(tables.sentences(spark, sf), dims.chain_dim(spark, sf), BACKENDS,
                             CacheStore.fresh(spark))


def _round_trip(spark, sf, rounded=False):
    return P.round_trip(tables.sentences(spark, sf), dims.round_trip_languages(spark, sf), BACKENDS,
                        CacheStore.fresh(spark), rounded=rounded)


@register("telephone_chain", TS.telephone_chain_sql())
def q_chain(spark, sf):
    return _chain(spark, sf)


@register("round_trip", TS.round_trip_sql())
def q_round_trip(spark, sf):
    return _round_trip(spark, sf, rounded=True)


@register("asymmetry", TS.asymmetry_sql())
def q_asymmetry(spark, sf):
    return relate.asymmetry(_round_trip(spark, sf))


@register("roundtrip_bars", TS.roundtrip_bars_sql())
def q_rt_bars(spark, sf):
    return marts.roundtrip_bars(_round_trip(spark, sf), ["cosine", "bleu"])


@register("asymmetry_wide", TS.asymmetry_wide_sql(BACKENDS))
def q_asym_wide(spark, sf):
    return marts.asymmetry_wide(relate.asymmetry(_round_trip(spark, sf)), BACKENDS)


@register("chain_curve", TS.chain_curve_sql())
def q_chain_curve(spark, sf):
    return marts.chain_curve(_chain(spark, sf), ["cosine", "bleu"])


def _conv_scores(spark, sf):
    pairs = tables.conversation_pairs(spark, sf)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stats_ = scoring.score_pairs(pairs.repartition(n), "original", "candidate", encoder=False)
    return scoring.aggregate_scores(stats_, ["role"], encoder=False)


@register("corpus_bleu", TS.conv_scores_sql("SELECT role, bleu, n_pairs FROM cs"))
def q_corpus_bleu(spark, sf):
    return _conv_scores(spark, sf).select("role", "bleu", "n_pairs")


@register("lexical_cosine", TS.conv_scores_sql("SELECT role, cosine, n_pairs FROM cs"))
def q_lexical_cosine(spark, sf):
    return _conv_scores(spark, sf).select("role", "cosine", "n_pairs")


@register("word_vector_cosine", TS.word_vector_sql())
def q_word_vectors(spark, sf):
    """Words take their vectors from ``embeddings`` by a hash of the word."""
    pairs = tables.conversation_pairs(spark, sf)
    e = dims.load_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    tokens = scoring.T.split_tokens(scoring.T.tokenize_13a(F.lower("text")))
    words = dims.load_table(spark, sf, "conversations").select(F.explode(tokens).alias("word")).distinct()
    size = e.agg((F.max("vec_id") + 1).alias("size"))
    number = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long")
    vectors = words.crossJoin(size).withColumn("vec_id", F.pmod(number, F.col("size"))).join(e, "vec_id").select("word", "vector")
    c = scoring.word_vector_cosine(pairs, ["conv_id", "turn", "role"], "original", "candidate", vectors)
    return c.groupBy("role").agg(F.round(F.avg("cosine"), 6).alias("cosine"), F.count(F.lit(1)).alias("n_pairs"))


@register("embedding_cosine", TS.embedding_cosine_sql())
def q_embedding_cosine(spark, sf):
    v = tables.vector_pairs(spark, sf)
    return (v.withColumn("c", scoring.vector_cosine(F.col("a"), F.col("b")))
            .groupBy("label").agg(F.round(F.avg("c"), 6).alias("embedding"),
                                  F.count(F.lit(1)).alias("n_pairs")))


# ---- corpus quality --------------------------------------------------------- #

from .operators import quality  # noqa: E402


@register("length_profile", TS.length_profile_sql(quality.MIN_WORDS, quality.MAX_WORDS,
                                                   quality.SWEET_MIN, quality.SWEET_MAX))
def q_length_profile(spark, sf):
    return quality.length_profile(tables.sentences(spark, sf))


@register("exact_dups", TS.exact_dups_sql())
def q_exact_dups(spark, sf):
    return quality.exact_dups(dims.load_table(spark, sf, "documents"))


@register("near_dups", TS.near_dups_sql(quality.SHINGLE, 4, 5))
def q_near_dups(spark, sf):
    return quality.near_dups(dims.load_table(spark, sf, "documents"))


@register("register_markers", TS.register_markers_sql(quality.CONTRACTION, quality.FIRST_PERSON))
def q_register_markers(spark, sf):
    return quality.register_markers(tables.sentences(spark, sf))


# ---- sources, set operations, code map --------------------------------------- #

from .session import subpath  # noqa: E402
from .sources import results  # noqa: E402

TRANSLATORS = ["F", "O"]  # fixed values: the line statuses that play the backends


def _round_metrics(df):
    return df.select(*[F.round(c, 6).alias(c) if c in METRICS4 else F.col(c) for c in df.columns])


def _by_backend(spark, sf):
    """The cells written as one file per backend and as one combined file."""
    base = subpath(spark, "pivotscore", "scratch", f"results-{uuid.uuid4().hex}")
    c = tables.cells(spark, sf)
    odd = F.raise_error(F.concat(F.lit("no file for backend "), F.col("translator")))
    c = c.withColumn("translator", F.when(F.col("translator").isin(TRANSLATORS), F.col("translator")).otherwise(odd))
    c.write.parquet(f"{base}/combined.parquet")
    whole = spark.read.parquet(f"{base}/combined.parquet")
    paths = [f"{base}/{t}.parquet" for t in TRANSLATORS]
    for t, p in zip(TRANSLATORS, paths):
        whole.filter(F.col("translator") == t).write.parquet(p)
    return f"{base}/combined.parquet", [*paths, f"{base}/missing.parquet"]


@register("load_many_union", O.with_(O.BASE, "SELECT translator, family, language, domain, round(cosine, 6) AS cosine, "
                                     "round(bleu, 6) AS bleu, round(ter, 6) AS ter, round(embedding, 6) AS embedding FROM cells"))
def q_load_many(spark, sf):
    _, paths = _by_backend(spark, sf)
    return _round_metrics(results.load_many(spark, paths, results.LONG_SCHEMA))


_PARTS = [f"p{k} AS (SELECT * FROM cells WHERE translator = '{t}')" for k, t in enumerate(TRANSLATORS)]
_JOINED = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(len(TRANSLATORS)))


@register("union_integrity", O.with_(
    [*O.BASE, *_PARTS, f"joined AS ({_JOINED})"],
    "SELECT (SELECT count(*) FROM cells) AS n_combined, (SELECT count(*) FROM joined) AS n_concat, "
    "(SELECT count(*) FROM (SELECT * FROM cells EXCEPT ALL SELECT * FROM joined)) AS n_missing, "
    "(SELECT count(*) FROM (SELECT * FROM joined EXCEPT ALL SELECT * FROM cells)) AS n_extra"))
def q_union_integrity(spark, sf):
    """The combined file against the files it should hold, both read back."""
    whole, paths = _by_backend(spark, sf)
    combined = results.load_many(spark, [whole], results.LONG_SCHEMA)
    concat = results.load_many(spark, paths, results.LONG_SCHEMA)

    def n(df, name):
        return df.agg(F.count(F.lit(1)).alias(name))

    return (n(combined, "n_combined").crossJoin(n(concat, "n_concat"))
            .crossJoin(n(combined.exceptAll(concat), "n_missing")).crossJoin(n(concat.exceptAll(combined), "n_extra")))


def _study_codes():
    langs = [lang for fam in dims.LANGUAGE_FAMILIES.values() for lang in fam]
    return [(i, lang, dims.ISO_TO_NLLB[lang]) for i, lang in enumerate(langs)]


@register("code_map", O.with_(
    [O.PIV, "cm(idx, study_language, nllb_code) AS (VALUES " + ", ".join(
        f"({i}, '{s}', '{n}')" for i, s, n in _study_codes()) + ")"],
    "SELECT language, study_language, nllb_code FROM piv LEFT JOIN cm ON cm.idx = piv.code"))
def q_code_map(spark, sf):
    cm = spark.createDataFrame(_study_codes(), "idx int, study_language string, nllb_code string")
    p = dims.pivots(spark, sf)
    j = p.join(cm, p.code == cm.idx, "left")
    return j.select("language", "study_language",
                    F.when(F.col("nllb_code").isNull(),
                           F.raise_error(F.concat(F.lit("no code for "), F.col("language"))))
                    .otherwise(F.col("nllb_code")).alias("nllb_code"))


# ---- Arrow UDF metrics (rows-only checks; unit tests hold brute force) ------- #

from .functions import pvalues  # noqa: E402
from .operators import ter as TER  # noqa: E402


@register("word_edit_rate", TS.word_edit_rate_sql())
def q_word_edit_rate(spark, sf):
    return TER.corpus_word_edit_rate(tables.conversation_pairs(spark, sf), "original", "candidate", ["role"])


@register("corpus_ter")
def q_corpus_ter(spark, sf):
    """E2 over whole conversation turns, each with the next one of its conversation."""
    return TER.corpus_ter(tables.conversation_pairs(spark, sf), "original", "candidate", ["role"])


@register("back_translation_metrics")
def q_bt_metrics(spark, sf):
    """D4 with all four metrics."""
    return P.back_translation_cells(tables.sentences(spark, sf), dims.pivots(spark, sf), BACKENDS,
                                    CacheStore.fresh(spark), with_ter=True)


@register("telephone_chain_metrics")
def q_chain_metrics(spark, sf):
    """D5 to D7 with the edit rate (0 at hop 0)."""
    return P.telephone_chain(tables.sentences(spark, sf), dims.chain_dim(spark, sf), BACKENDS,
                             CacheStore.fresh(spark), with_ter=True)


@register("round_trip_metrics")
def q_round_trip_metrics(spark, sf):
    """D8 with the edit rate in both directions."""
    return P.round_trip(tables.sentences(spark, sf), dims.round_trip_languages(spark, sf), BACKENDS,
                        CacheStore.fresh(spark), with_ter=True)


@register("anova_p", O.anova_p_sql())
def q_anova_p(spark, sf):
    c = _cells_once(spark, sf)
    a = stats.anova(c, "family", "bleu").unionByName(stats.anova(c, "domain", "bleu"))
    return a.withColumn("sig", pvalues.stars(F.col("p"))).withColumn("p", F.round("p", 10))


@register("corr_pvalues", O.corr_pvalues_sql())
def q_corr_pvalues(spark, sf):
    r = relate.corr_pooled(_cells_once(spark, sf), O.CORR_PAIRS)
    return r.withColumn("p", pvalues.r_pvalue(F.col("r"), F.col("n").cast("double"))) \
        .withColumn("sig", pvalues.stars(F.col("p"))).withColumn("p", F.round("p", 10))


# ---- cache state against a seeded cache ---------------------------------------- #

from .plans import audit  # noqa: E402

SEED_BACKEND = "alpha"


def _seeded_cache(spark, sf) -> CacheStore:
    """A cache filled by one round trip with the seed backend, built once per
    application and table directory, so that a changed table is never answered
    from an older one."""
    import hashlib
    tag = hashlib.md5(f"{spark.sparkContext.applicationId}|{sf}|{SEED_BACKEND}".encode()).hexdigest()[:16]
    path = subpath(spark, "pivotscore", "fixtures", tag)
    cache = CacheStore(spark, f"{path}/cache")
    from .session import path_exists
    if not path_exists(spark, f"{path}/_done"):
        P.round_trip(tables.sentences(spark, sf), dims.round_trip_languages(spark, sf), [SEED_BACKEND],
                     cache).write.format("noop").mode("overwrite").save()
        spark.createDataFrame([(1,)], "done int").write.mode("overwrite").parquet(f"{path}/_done")
    return cache


def _fwd_requests(spark, sf):
    """Every text's requests once, with the number ``n`` of sentences that make them."""
    texts = audit.counted_texts(tables.sentences(spark, sf)).withColumnRenamed("cur", "text")
    grid = P.fan(texts, dims.pivots(spark, sf), P.backends_frame(spark, BACKENDS))
    return grid.select("backend", F.lit("en").alias("src"), F.col("language").alias("tgt"),
                       F.lit(None).cast("int").alias("src_code"), F.col("code").alias("tgt_code"), "text", "n")


@register("cache_lookup", TS.cache_lookup_sql(SEED_BACKEND))
def q_cache_lookup(spark, sf):
    looked = TR.lookup(_fwd_requests(spark, sf), _seeded_cache(spark, sf), BACKENDS)
    return looked.groupBy("backend", "tgt").agg(
        F.sum("n").alias("n_requests"), F.sum(F.col("cached").isNotNull().cast("long") * F.col("n")).alias("n_hits"))


@register("cache_misses", TS.cache_misses_sql(SEED_BACKEND))
def q_cache_misses(spark, sf):
    m = TR.misses(_fwd_requests(spark, sf), _seeded_cache(spark, sf), BACKENDS)
    return m.groupBy("backend", "tgt").agg(F.count(F.lit(1)).alias("n_missing_keys"))


@register("unique_keys", TS.unique_keys_sql(SEED_BACKEND))
def q_unique_keys(spark, sf):
    c = _seeded_cache(spark, sf).read()
    return c.rollup("backend", "tgt").agg(
        F.countDistinct("key").alias("n_keys"),
        F.sum((~F.col("key").rlike("^[0-9a-f]{32}$")).cast("int")).alias("n_bad"))


# ---- replay of all protocols against the seeded cache --------------------------- #

def _lookups(spark, sf):
    return audit.replay(tables.sentences(spark, sf), dims.pivots(spark, sf), dims.chain_dim(spark, sf),
                        dims.round_trip_languages(spark, sf), BACKENDS, _seeded_cache(spark, sf))


@register("replay_requests", TS.replay_sql(SEED_BACKEND, "replay_requests"))
def q_replay_requests(spark, sf):
    return audit.requests(_lookups(spark, sf))


@register("key_owners", TS.replay_sql(SEED_BACKEND, "key_owners"))
def q_key_owners(spark, sf):
    return audit.owner_sets(_lookups(spark, sf))


@register("keys_by_tag", TS.replay_sql(SEED_BACKEND, "keys_by_tag"))
def q_keys_by_tag(spark, sf):
    return audit.keys_by_tag(_lookups(spark, sf))


@register("replay_misses", TS.replay_sql(SEED_BACKEND, "replay_misses"))
def q_replay_misses(spark, sf):
    return audit.missed(_lookups(spark, sf))


@register("key_overlap", TS.replay_sql(SEED_BACKEND, "key_overlap"))
def q_key_overlap(spark, sf):
    return audit.overlap(_lookups(spark, sf))


@register("unattributed_keys", TS.unattributed_sql(SEED_BACKEND))
def q_unattributed(spark, sf):
    return audit.unattributed(_lookups(spark, sf), _seeded_cache(spark, sf))


@register("language_sets", O.with_(O.BASE, """SELECT a.translator AS translator_a, b.translator AS translator_b,
 count(DISTINCT a.language) FILTER (WHERE a.language NOT IN (SELECT language FROM cells c WHERE c.translator = b.translator)) AS n_only_a,
 count(DISTINCT b.language) FILTER (WHERE b.language NOT IN (SELECT language FROM cells c WHERE c.translator = a.translator)) AS n_only_b
 FROM cells a JOIN cells b ON a.translator < b.translator GROUP BY ALL"""))
def q_language_sets(spark, sf):
    return relate.language_sets(_cells(spark, sf))
