"""The three measurement protocols as Spark plans.

* back-translation (en -> L -> en, every language)      ``back_translate``
* telephone chain (en -> l1 -> ... -> l5, detour to en)  ``telephone_chain``
* round trip (ABA: en -> L -> en; BAB: third leg en -> L) ``round_trip``

Each protocol step is one ``resolve`` over *all* backends, languages, orders
and domains at once, so duplicate requests across them are sent once.  The
state after every step is written to the shared folder (``materialize``),
which keeps lineage one step deep however many hops a chain has.

Scores: corpus BLEU, lexical cosine, stand-in embedding cosine (JVM-side,
see ``operators.scoring``) and, with ``with_ter``, the translation edit rate:
its per-pair edits come from an Arrow UDF (``operators.ter``) in the same
pass over the distinct pairs that makes the other metrics' partials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import PIVOT_LANG
from ..operators import scoring as S
from ..operators.ter import ter_edits_udf
from ..sources.cache_store import CacheStore
from .ledger import Ledger
from .translate import columns_only, materialize, resolve_step

SENT_COLS = ["domain", "sent_id", "text"]


def spread(sentences: DataFrame) -> DataFrame:
    """Hash-partition sentences before the fan-out.

    A document file is one split however many sentences it holds, and every
    sentence fans out to languages x backends requests; spreading first keeps
    the channel, hashing and scoring work on every core.
    """
    n = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sentences.select(*SENT_COLS).repartition(n, "sent_id")


def names(langs: DataFrame) -> list[str]:
    """Language names of a (bounded) language dimension, for partition pruning."""
    return sorted(r["language"] for r in langs.select("language").distinct().collect())


def backends_frame(spark: SparkSession, backends: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, backends)).cast("array<string>")).alias("backend"))


def fan(df: DataFrame, *dims: DataFrame) -> DataFrame:
    """Every row of ``df`` with every row of the bounded dimensions.

    These are broadcast by name: Spark's estimate of a derived table is the
    product of its inputs, and above the broadcast limit it would make a
    Cartesian product of partitions, each of which reads ``df`` again.
    """
    for d in dims:
        df = df.crossJoin(F.broadcast(d))
    return df


def fan_by_text(sentences: DataFrame, langs: DataFrame, backends: list[str]) -> DataFrame:
    """``fan`` to languages and backends in which the rows of equal texts follow one another.

    What is made of a text (a key, a value) is then the same from sentence to
    sentence, and a file stores it little more than once.  Ranges over hash
    and id even out a text with very many rows.  The backends are exploded
    above the sort, as Spark drops a sort straight below a join.
    """
    n = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_text = F.xxhash64("text")
    rows = sentences.select(*SENT_COLS).repartitionByRange(n, by_text, "sent_id").sortWithinPartitions(by_text)
    return fan(rows.withColumn("backend", F.explode(F.array(*map(F.lit, backends)).cast("array<string>"))), langs)


def _answered(out: DataFrame, out_col: str) -> DataFrame:
    return (out.withColumnRenamed("value", out_col).withColumnRenamed("failed", f"{out_col}_failed")
            .drop("key", "from_cache", "src", "tgt", "src_code", "tgt_code", "text"))


def _step(df: DataFrame, cache: CacheStore, backends: list[str], out_col: str, tag: str,
          targets: list[str] | None = None, ledger: Ledger | None = None, stored: bool = True) -> DataFrame:
    """Resolve the request columns of ``df``; store the value as ``out_col``.

    With a ledger the step is computed only if the ledger lacks it.  Without,
    a step of column backends need not be ``stored``: it is computed where it
    is used, from the rows before it, whose partitions it keeps.
    """
    if ledger:
        return ledger.step(tag, lambda: _answered(resolve_step(df, cache, backends, targets)[0], out_col))
    out, written, _ = resolve_step(df, cache, backends, targets)
    out = _answered(out, out_col)
    return out if written or (columns_only(backends) and not stored) else materialize(out, tag)


def _forward(sentences: DataFrame, langs: DataFrame, backends: list[str]) -> DataFrame:
    """The requests en -> L of every sentence, language and backend."""
    grid = fan(spread(sentences), langs.select("family", "language", "code"), backends_frame(sentences.sparkSession, backends))
    return grid.select("backend", "family", "language", "code", "domain", "sent_id",
                       F.lit(PIVOT_LANG).alias("src"), F.col("language").alias("tgt"),
                       F.lit(None).cast("int").alias("src_code"),
                       F.col("code").alias("tgt_code"), "text")


def _backward(fwd: DataFrame) -> DataFrame:
    """The requests L -> en of the forward texts."""
    return fwd.select("*", F.col("language").alias("src"), F.lit(PIVOT_LANG).alias("tgt"),
                      F.col("code").alias("src_code"),
                      F.lit(None).cast("int").alias("tgt_code"),
                      F.col("forward").alias("text"))


def back_translate(sentences: DataFrame, langs: DataFrame, backends: list[str],
                   cache: CacheStore, ledger: Ledger | None = None, stored: bool = True) -> DataFrame:
    """D3: (backend, family, language, domain, sent_id, forward, back, *_failed).

    The grid sentences x languages x backends (C1) is a cross join with two
    bounded dimensions, broadcast.
    """
    lang_list = names(langs)
    fwd = _step(_forward(sentences, langs, backends), cache, backends, "forward", "bt-fwd", lang_list, ledger, stored)
    return _step(_backward(fwd), cache, backends, "back", "bt-back", [PIVOT_LANG], ledger, stored)


def back_translate_once(sentences: DataFrame, texts: DataFrame, langs: DataFrame, backends: list[str],
                        cache: CacheStore) -> DataFrame:
    """``back_translate`` of rows that are read once: neither leg of column backends is stored or exchanged.

    What goes to the cache is asked by ``texts`` (``distinct_texts``), which may be the sentences themselves.
    """
    if not columns_only(backends):
        return back_translate(sentences, langs, backends, cache)
    req, ask = _forward(sentences, langs, backends), _forward(texts, langs, backends)
    for col, targets in (("forward", names(langs)), ("back", [PIVOT_LANG])):
        out, _, asked = resolve_step(req, cache, backends, targets, ask)
        res = _answered(out, col)
        if col == "forward":
            req, ask = _backward(res), None if asked is None else _backward(_answered(asked, col))
    return res


def distinct_texts(sentences: DataFrame) -> DataFrame:
    """Every text of the sentences once, in their columns: ``sent_id`` is the text's md5, ``domain`` is null.

    What a protocol asks a backend depends on the text alone, so reports that
    count rows walk the texts and weigh them at the end (``references``).
    """
    texts = sentences.select("text").distinct()
    return texts.select(F.lit(None).cast("string").alias("domain"), F.md5("text").alias("sent_id"), "text")


def references(sentences: DataFrame) -> DataFrame:
    """(domain, sent_id, original, weight): how many rows of a domain have a text (by md5) and an original.

    A sentence's original is joined by its id, so ids that repeat count with
    every text they have; usually a text is its own original.
    """
    own = sentences.select(F.col("sent_id").alias("_id"), "domain", F.md5("text").alias("sent_id"))
    return (own.join(sentences.select(F.col("sent_id").alias("_id"), F.col("text").alias("original")), "_id")
            .groupBy("domain", "sent_id", "original").agg(F.count(F.lit(1)).alias("weight")))


def with_edits(pairs: DataFrame, ref_col: str, hyp_col: str) -> DataFrame:
    """Add the partials of the translation edit rate (``edits``, ``ref_words``)."""
    return (pairs.withColumn("_e", ter_edits_udf(F.col(hyp_col), F.col(ref_col)))
            .withColumns({"edits": F.col("_e.edits"), "ref_words": F.col("_e.ref_words")}).drop("_e"))


def score_against_sentences(pairs: DataFrame, refs: DataFrame, hyp_col: str,
                            keys: list[str], lexical=True, encoder=True,
                            with_ter: bool = False, rounded: bool = True) -> DataFrame:
    """Candidates of distinct texts against their originals, by ``keys`` and domain.

    Each distinct (text, original, candidate) is scored once -- backends and
    languages often return the same text -- and its partial sums count for
    every pair that produced it, weighed by ``references``, in the group
    aggregate.  The pairs of a candidate and the domains of an original are
    bounded by the dimensions and stay in its row, so pairs travel once, by
    text, or not at all if they already lie by text.
    """
    prof = refs.groupBy("sent_id", "original").agg(F.collect_list(F.struct("domain", "weight")).alias("_refs"))
    uniq = (pairs.groupBy("sent_id", F.col(hyp_col).alias("_hyp"))
            .agg(F.collect_list(F.struct(*keys)).alias("_pairs")))
    j = uniq.join(prof, "sent_id")
    if with_ter:
        j = with_edits(j, "original", "_hyp")
    stats = S.score_pairs(j, "original", "_hyp", lexical, encoder).drop("original", "_hyp", "sent_id")
    scored = stats.withColumn("_pair", F.explode("_pairs")).withColumn("_ref", F.explode("_refs")).drop("_pairs", "_refs")
    scored = scored.select("*", *[F.col(f"_pair.{k}").alias(k) for k in keys], "_ref.domain", "_ref.weight").drop("_pair", "_ref")
    return S.aggregate_scores(scored, [*keys, "domain"], lexical, encoder, rounded, edits=with_ter, weight="weight")


def back_translation_cells(sentences: DataFrame, langs: DataFrame, backends: list[str],
                           cache: CacheStore, with_ter: bool = False, resume: bool = False) -> DataFrame:
    """One row per (translator, family, language, domain) with the metrics.

    ``resume`` keeps each leg in a ledger and takes up a stopped run of the same inputs.
    """
    ledger = Ledger.of(sentences.sparkSession, "back_translation", backends, sentences, langs) if resume else None
    texts = materialize(distinct_texts(sentences), "texts")
    bt = (back_translate(texts, langs, backends, cache, ledger) if ledger
          else back_translate_once(texts, texts, langs, backends, cache))
    cells = score_against_sentences(
        bt.select("backend", "family", "language", "sent_id", "back"),
        materialize(references(sentences), "refs"), "back", ["backend", "family", "language"], with_ter=with_ter)
    first = ["backend", "family", "language", "domain"]
    return cells.select(*first, *[c for c in cells.columns if c not in first]).withColumnRenamed("backend", "translator")


def telephone_chain(sentences: DataFrame, chain: DataFrame, backends: list[str],
                    cache: CacheStore, with_ter: bool = False, ledger: Ledger | None = None) -> DataFrame:
    """(translator, order, domain, hop, lang_code, cosine, bleu[, ter]).

    ``chain`` is (order, hop, language, code).  Step k resolves the chain's
    forward requests of hop k together with the English detour of hop k-1, so
    the number of resolve rounds is hops + 1 and every round dedupes across
    orders, domains and backends.  With a ledger a stopped run goes on after
    its last whole hop.
    """
    spark = sentences.sparkSession
    orders = chain.select("order").distinct()
    state = (fan(spread(materialize(distinct_texts(sentences), "texts")), orders, backends_frame(spark, backends))
             .select("backend", "order", "domain", "sent_id",
                     F.col("text").alias("cur"), F.lit(PIVOT_LANG).alias("cur_lang"),
                     F.lit(None).cast("int").alias("cur_code"), F.lit(0).alias("hop")))
    hops = max(r["hop"] for r in chain.agg(F.max("hop").alias("hop")).collect())
    detours = []
    pending = None  # detour requests of the previous hop
    for hop in range(1, hops + 2):
        reqs = []
        if hop <= hops:
            nxt = chain.filter(F.col("hop") == hop).select(
                "order", F.col("language").alias("nl"), F.col("code").alias("nc"))
            fwd = (state.join(F.broadcast(nxt), "order")  # a row per order
                   .select("backend", "order", "domain", "sent_id",
                           F.lit(hop).alias("hop"), F.lit("chain").alias("leg"),
                           F.col("nl").alias("lang"), F.col("nc").alias("lang_code_int"),
                           F.col("cur_lang").alias("src"), F.col("nl").alias("tgt"),
                           F.col("cur_code").alias("src_code"), F.col("nc").alias("tgt_code"),
                           F.col("cur").alias("text")))
            reqs.append(fwd)
        if pending is not None:
            reqs.append(pending)
        req = reqs[0] if len(reqs) == 1 else reqs[0].unionByName(reqs[1])
        tg = [PIVOT_LANG] if pending is not None else []
        if hop <= hops:
            tg += names(chain.filter(F.col("hop") == hop))
        res = _step(req, cache, backends, "out", f"chain-{hop}", sorted(set(tg)), ledger)
        if pending is not None:
            detours.append(res.filter(F.col("leg") == "detour"))
        if hop <= hops:
            state = res.filter(F.col("leg") == "chain").select(
                "backend", "order", "domain", "sent_id", F.col("out").alias("cur"),
                F.col("lang").alias("cur_lang"), F.col("lang_code_int").alias("cur_code"),
                "hop")
            pending = state.select("backend", "order", "domain", "sent_id", "hop",
                                   F.lit("detour").alias("leg"),
                                   F.col("cur_lang").alias("lang"),
                                   F.col("cur_code").alias("lang_code_int"),
                                   F.col("cur_lang").alias("src"), F.lit(PIVOT_LANG).alias("tgt"),
                                   F.col("cur_code").alias("src_code"),
                                   F.lit(None).cast("int").alias("tgt_code"),
                                   F.col("cur").alias("text"))
    scored_in = detours[0]
    for d in detours[1:]:
        scored_in = scored_in.unionByName(d)
    keys = ["backend", "order", "hop", "lang"]
    scored = score_against_sentences(scored_in.select(*keys, "sent_id", "out"), materialize(references(sentences), "refs"),
                                     "out", keys, encoder=False, with_ter=with_ter)
    scored = scored.drop("n_pairs").withColumnRenamed("backend", "translator") \
        .withColumnRenamed("lang", "lang_code")
    base = (fan(sentences.select("domain").distinct(), orders, backends_frame(spark, backends).withColumnRenamed("backend", "translator"))
            .select("translator", "order", "domain", F.lit(0).alias("hop"),
                    F.lit(PIVOT_LANG).alias("lang_code"), F.lit(100.0).alias("bleu"),
                    F.lit(1.0).alias("cosine")))
    if with_ter:
        base = base.withColumn("ter", F.lit(0.0))
    cols = ["translator", "order", "domain", "hop", "lang_code", "cosine", "bleu"] + (
        ["ter"] if with_ter else [])
    return scored.select(*cols).unionByName(base.select(*cols))


def round_trip(sentences: DataFrame, langs: DataFrame, backends: list[str],
               cache: CacheStore, with_ter: bool = False, rounded: bool = True, ledger: Ledger | None = None) -> DataFrame:
    """(translator, language, domain, direction, cosine, bleu[, ter]).

    ABA scores the back-translation against the original; BAB scores the
    third leg (en -> L of the ABA output) against the first-pass L text.  The
    first two legs are exactly the back-translation protocol, so they come
    from (and fill) the same cache entries.
    """
    bt = back_translate(materialize(distinct_texts(sentences), "texts"), langs.select(
        F.lit(None).cast("string").alias("family"), "language", "code"), backends, cache, ledger, stored=False)
    leg3 = bt.select("*", F.lit(PIVOT_LANG).alias("src"), F.col("language").alias("tgt"),
                     F.lit(None).cast("int").alias("src_code"),
                     F.col("code").alias("tgt_code"), F.col("back").alias("text"))
    leg3 = _step(leg3, cache, backends, "third", "rt-leg3", names(langs), ledger)
    keys = ["backend", "language"]
    aba = score_against_sentences(leg3.select(*keys, "sent_id", "back"), materialize(references(sentences), "refs"), "back",
                                  keys, encoder=False, with_ter=with_ter, rounded=rounded)
    n = int(leg3.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    legs = leg3.select(*keys, "sent_id", "forward", "third").repartition(n)
    if with_ter:
        legs = with_edits(legs, "forward", "third")
    counts = sentences.groupBy("domain", F.md5("text").alias("sent_id")).agg(F.count(F.lit(1)).alias("weight"))
    keys = [*keys, "domain"]
    bab_pairs = S.score_pairs(legs, "forward", "third", encoder=False).join(counts, "sent_id")
    bab = S.aggregate_scores(bab_pairs, keys, encoder=False, rounded=rounded, edits=with_ter, weight="weight")
    cols = ["cosine", "bleu"] + (["ter"] if with_ter else [])
    out = (aba.select(*keys, F.lit("ABA").alias("direction"), *cols)
           .unionByName(bab.select(*keys, F.lit("BAB").alias("direction"), *cols)))
    return out.withColumnRenamed("backend", "translator")
