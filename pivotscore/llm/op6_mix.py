"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words; each document gets an expected number of
copies that falls slowly with the length class of its text.  The whole part
of that number is certain.  For the rest a document has the inclusion
probability p, and the documents of a source are ranked by the random odds
u / (1 - u) divided by the inclusion odds p / (1 - p); the first ones are
taken until the words still wanted are used up.  u is a hash of the id, so
every run takes the same documents.

All steps are DataFrame expressions.  A source is never gathered in one
task: ranks are dealt into bins, words are summed per bin, and only the rows
of one bin are put in order together.

Defined results: a null text has size 0; null is a source of its own, last
in order; a null id is ranked like any other value; repeated rows are ranked
next to each other, each on its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: Weights by a source's place in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix's size against all words, and the most copies of a document.
SHARE, MOST = 1.5, 2.0
#: Bins of the rank order in each source.
BINS = 4096


def fill(df: DataFrame, keys: list[str], order: list[str], cap: str, weight: str, total: str) -> DataFrame:
    """Add ``level``: the factor of the weights that shares ``total`` out.

    A share stops at ``cap`` and the excess goes to the others by weight.
    With the rows sorted by cap / weight, the level is the largest value of
    (total - caps before) / (weights from here on).
    """
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    before = F.coalesce(F.sum(cap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(weight).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    df = df.withColumn("_level", F.when(rest > 0, (F.col(total) - before) / rest).otherwise(F.lit(0.0)))
    return df.withColumn("level", F.max("_level").over(Window.partitionBy(*(keys or [F.lit(0)])))).drop("_level")


def chance(key: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of the key's md5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2 ** 52))


def shares(light: DataFrame, weights: tuple, share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """(grp, source_size, target) of each source and (grp, cls, expected, whole, left) of each of its length classes.

    ``light(grp, source, size)``.  Sources are few: one row each, as are their
    length classes, at most 63 a source.
    """
    sources = light.groupBy("grp", "source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place % len(weights) + 1)
    sources = (sources.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
               .withColumn("wanted", share * F.sum("source_size").over(Window.partitionBy(F.lit(0))))
               .withColumn("ratio", F.col("cap") / F.col("w")))
    sources = fill(sources, [], ["ratio", "grp"], "cap", "w", "wanted")
    sources = sources.select("grp", F.col("source_size"), F.least("cap", F.col("w") * F.col("level")).alias("target"))

    classes = (light.withColumn("cls", length_class()).filter("size > 0").groupBy("grp", "cls").agg(F.sum("size").alias("words"))
               .join(sources, "grp")
               .withColumn("odds", 1.0 / (F.lit(8.0) + F.col("cls")))  # longer texts are repeated a little less
               .withColumn("cap", most * F.col("words")).withColumn("w", F.col("odds") * F.col("words")))
    classes = fill(classes, ["grp"], ["cls"], "cap", "w", "target")
    classes = (classes.withColumn("expected", F.least(F.lit(most), F.col("level") * F.col("odds")))
               .withColumn("whole", F.floor("expected")))
    sure = F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("grp"))
    return cut(sources), cut(classes.withColumn("left", F.col("target") - sure).select("grp", "cls", "expected", "whole", "left"))


def group() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))


def length_class() -> Column:
    return F.when(F.col("size") > 0, F.length(F.bin("size")) - 1).otherwise(F.lit(-1))


def ranked(rows: DataFrame, classes: DataFrame, seed: str) -> DataFrame:
    """``rows(doc_id, grp, size, ...)`` with their class's columns and ``rank``, null where no copy is left to chance."""
    u = chance(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    p = F.col("expected") - F.col("whole")
    # Classes are at most 64 rows a source.
    return (rows.withColumn("cls", length_class()).join(F.broadcast(classes), ["grp", "cls"], "left").withColumn("u", u)
            .withColumn("rank", F.when(p > 0, F.col("u") / (1 - F.col("u")) / (p / (1 - p)))).drop("u"))


def drawn(placed: DataFrame) -> DataFrame:
    """The rows with a rank, with ``extra``: 1 for those that come before their source's words are used up.

    Taken while at least half of the document fits into what is still wanted;
    once one is not, none after it is.
    """
    bin_ = F.floor(F.lit(BINS) * F.col("rank") / (1 + F.col("rank")))
    some = placed.filter("rank is not null").withColumn("bin", bin_)
    by_bin = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (some.groupBy("grp", "bin").agg(F.sum("size").alias("words"))
            .withColumn("ahead", F.coalesce(F.sum("words").over(by_bin), F.lit(0))).select("grp", "bin", "ahead"))
    own = Window.partitionBy("grp", "bin").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (some.join(cut(bins), ["grp", "bin"])
            .withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(own), F.lit(0)))
            .withColumn("extra", (2 * F.col("before") + F.col("size") <= 2 * F.col("left")).cast("int")).drop("bin", "ahead", "before"))


def copies(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, expected, n_copies, taken) of every document."""
    light = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))).withColumn("grp", group())
    sources, classes = shares(light, weights, share, most)
    placed = cut(ranked(light.join(sources, "grp"), classes, seed))
    cols = ["doc_id", "source", "size", "source_size", "target", "expected", "whole"]
    out = drawn(placed).select(*cols, "extra").unionByName(placed.filter("rank is null").select(*cols, F.lit(0).alias("extra")))
    n = F.coalesce(F.col("whole") + F.col("extra"), F.lit(0)).cast("int")
    return (out.withColumn("n_copies", n).withColumn("taken", (F.col("n_copies") * F.col("size")).cast("long"))
            .drop("whole", "extra"))


def repeat(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    A document of no words is taken no time.  A source's ranks are taken up
    to its first row that no longer fits, so a row's number of copies follows
    from its own columns and that limit (a row for each source), and no text
    is moved.  Only rows that tie with a limit in rank, id and size are put
    in order, by their text's hash.
    """
    light = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))).withColumn("grp", group())
    _, classes = shares(light, weights, share, most)
    place = F.struct("rank", "doc_id", "size")
    found = cut(drawn(ranked(light, classes, seed)).select("grp", place.alias("place"), "extra"))
    limits = cut(found.filter("extra = 0").groupBy("grp").agg(F.min("place").alias("limit")))
    ties = found.join(F.broadcast(limits), "grp").filter("extra = 1 and place <=> limit").groupBy("grp").agg(F.count(F.lit(1)).alias("ties"))
    limits = cut(limits.join(ties, "grp", "left").select("grp", "limit", F.coalesce("ties", F.lit(0)).alias("ties")))

    whole = docs.select("doc_id", word_count(F.col("text")).alias("size"), group().alias("grp"), "text",
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    told = (ranked(whole, classes, seed).join(F.broadcast(limits), "grp", "left").withColumn("place", place)
            .withColumn("tied", F.coalesce(F.col("rank").isNotNull() & F.col("place").eqNullSafe(F.col("limit")), F.lit(False))))
    extra = F.when(F.col("rank").isNotNull() & (F.col("limit").isNull() | (F.col("place") < F.col("limit"))), 1).otherwise(0)
    turn = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("text")))
    n = F.coalesce(F.col("whole"), F.lit(0))
    plain = told.filter("not tied").select("row", (n + extra).cast("int").alias("n"))
    tied = told.filter("tied").select("row", (n + (turn <= F.col("ties")).cast("int")).cast("int").alias("n"))
    both = plain.unionByName(tied).filter("n > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def oracle(weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> str:
    """The same in DuckDB SQL, from the raw table and without bins."""
    cases = " ".join(f"when {k} then {float(x)}" for k, x in enumerate(weights))
    return rf"""
with light as (
  select doc_id, source, coalesce('s' || source, 'n') as grp,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         (('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / {float(2 ** 52)}::double as u
  from documents),
src as (
  select grp, source, sum(size)::bigint as source_size,
         case (row_number() over (order by source asc nulls last) - 1) % {len(weights)} {cases} end::double as w
  from light group by grp, source),
src2 as (
  select *, {most}::double * source_size as cap, {share}::double * sum(source_size) over () as wanted from src),
src3 as (
  select *, (wanted - coalesce(sum(cap) over (order by cap / w, grp rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (order by cap / w, grp rows between current row and unbounded following) as lev from src2),
targets as (select grp, source_size, least(cap, w * max(lev) over ()) as target from src3),
classed as (select *, case when size > 0 then length(bin(size)) - 1 else -1 end as cls from light),
cl as (
  select c.grp, cls, sum(size)::double as words, any_value(target) as target, 1::double / (8::double + cls) as odds
  from classed c join targets t on c.grp = t.grp where size > 0 group by c.grp, cls),
cl2 as (
  select *, (target - coalesce(sum({most}::double * words) over (partition by grp order by cls rows between unbounded preceding and 1 preceding), 0))
            / sum(odds * words) over (partition by grp order by cls rows between current row and unbounded following) as lev from cl),
cl3 as (select *, least({most}::double, max(lev) over (partition by grp) * odds) as expected from cl2),
cl4 as (select *, floor(expected) as whole, target - sum(floor(expected) * words) over (partition by grp) as rest from cl3),
ranked as (
  select c.*, expected, whole, rest, expected - whole as p,
         case when expected - whole > 0 then c.u / (1 - c.u) / ((expected - whole) / (1 - (expected - whole))) end as rnk
  from classed c left join cl4 k on c.grp = k.grp and c.cls = k.cls),
drawn as (
  select *, coalesce(sum(size) over (partition by grp order by rnk, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as before
  from ranked where rnk is not null),
picked as (
  select doc_id, grp, size, whole + case when 2 * before + size <= 2 * rest then 1 else 0 end as n from drawn
  union all select doc_id, grp, size, coalesce(whole, 0) from ranked where rnk is null)
select p.doc_id, p.size, t.source_size, t.target, (p.n * p.size)::bigint as taken
from picked p join targets t on p.grp = t.grp"""
