"""Main text of web pages by structure and nearest-URL page differencing.

A page is cut into blocks of text, each with the zone it stands in: the
article's (inside an article or main element), boilerplate's (menus, page
headers, footers, sidebars, notices, adverts, forms, reader comments, by
element, role, class or id), or open.  A class or id never drops the article
element itself; an article in a box with such a name counts if the page has
no longer text elsewhere; and inside an article the doubtful names (``WEAK``)
drop a box only if it holds a form or at least half of it is links.  A page
with an article is that article's blocks, any other page its open ones.  The
lines of every page are aligned, by longest common subsequence, with those of
the page on the same host whose URL path is nearest (next in path order, with
the longer common prefix).  Lines that both share are deleted; where the two
are near copies, only those that other pages of the host have too (``shared``).
Inside an article only the blocks of doubtful boxes can go this way: articles
share passages, and those are theirs.

Differencing alone cannot give right results where boilerplate differs on
every page or articles share passages, so structure goes first.

Defined results: a null or empty html gives the empty text; a page without
other paths on its host, or whose open lines all are its neighbour's (a copy
of it), loses no line; a null url has no neighbour; repeated rows get the
same text; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, row_key

# Fixed values of HTML and of usual names in page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select title".split())
DROPPED = frozenset("head nav footer aside form button fieldset dialog menu".split())
MAIN = frozenset("article main".split())
NAMES = frozenset("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
                  "breadcrumb breadcrumbs footer header masthead notice alert cookie cookies consent gdpr popup modal overlay comment "
                  "comments disqus respond replies share sharing social related recommended newsletter subscribe signup login search "
                  "pagination pager toolbar widget".split())
#: Names that inside an article need a second sign: mostly links, or a form.
WEAK = frozenset("alert overlay recommended related search share sharing social toolbar widget".split())
#: Names of reader comments.
READERS = frozenset("comment comments disqus respond replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())
# End of fixed values.

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)"
                  r"([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>|[^>]*+(?:>|\Z))", re.DOTALL)
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_RAW_END = {x: re.compile(f"</{x}(?=[\\s/>])[^>]*>", re.IGNORECASE) for x in RAW}
_PART = re.compile(r"[^a-z0-9]+")


def _named(attrs: str) -> tuple[set[str], str]:
    """The names of boilerplate in an element's class and id, and its role."""
    names: set[str] = set()
    role = ""
    for m in _ATTR.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            role = role or value.strip()
        else:
            names |= NAMES.intersection(_PART.split(value))
    return names, role


class _Blocks:
    """The open elements of a page and the blocks that they have closed."""

    def __init__(self) -> None:
        #: Zone, text and whether a doubtful box inside an article holds it.
        self.out: list[list] = []
        #: Open elements: name, their share in the counts below, and where a doubtful one began.
        self.stack: list[tuple[str, tuple[int, int, int, int], tuple | None]] = []
        self.hard = self.soft = self.main = self.links = self.doubts = 0
        self.chars = self.linked = self.forms = 0
        self.buffer: list[str] = []

    def say(self, piece: str) -> None:
        """Take a piece of text; references are decoded before pieces are joined."""
        text = entities.unescape(piece)
        self.buffer.append(text)
        n = len(text.strip())
        self.chars += n
        self.linked += n if self.links else 0

    def close(self) -> None:
        """End the current block."""
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                zone = "drop" if self.hard else ("veiled" if self.main else "drop") if self.soft else "main" if self.main else "open"
                self.out.append([zone, text, self.doubts > 0])
            self.buffer.clear()

    def enter(self, name: str, attrs: str) -> None:
        names, role = _named(attrs)
        main = int(name in MAIN or role == "main")
        if self.main:
            names -= {"header", "masthead"}  # an article's own heading
        hard = soft = doubt = False
        if name in DROPPED or name == "header" and not self.main or role in ROLES:
            hard = True
        elif name not in ("html", "body") and names and (not main or self.main):
            if self.main:
                doubt = names <= WEAK
                hard = not doubt
            else:
                hard = not names.isdisjoint(READERS)
                soft = not hard
        self.forms += name in ("form", "button")
        if name not in INLINE or main or hard or soft or doubt:
            self.close()
        shares = (int(hard), int(soft), main, int(name == "a"))
        self.stack.append((name, shares, (len(self.out), self.chars, self.linked, self.forms) if doubt else None))
        self.doubts += doubt
        self.add(shares, 1)

    def add(self, shares: tuple[int, int, int, int], sign: int) -> None:
        self.hard += sign * shares[0]
        self.soft += sign * shares[1]
        self.main += sign * shares[2]
        self.links += sign * shares[3]

    def leave(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        if any(any(x[1][:3]) or x[2] for x in self.stack[k:]):
            self.close()
        for _, shares, began in reversed(self.stack[k:]):
            self.add(shares, -1)
            if began:
                self.doubts -= 1
                at, chars, linked, forms = began
                if self.forms > forms or 2 * (self.linked - linked) >= max(1, self.chars - chars):
                    for block in self.out[at:]:
                        block[0] = "drop"
        del self.stack[k:]

    def done(self) -> list[tuple[str, str, bool]]:
        self.close()
        self.leave(0)
        size = {z: sum(len(t) for x, t, _ in self.out if x == z) for z in ("main", "veiled", "open")}
        # An article inside a box with a boilerplate name counts where the page has no other text as long.
        veiled = "main" if not size["main"] and size["veiled"] > size["open"] else "drop"
        return [(veiled if z == "veiled" else z, t, d) for z, t, d in self.out]


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of the page's non-empty blocks: zone "main", "open" or "drop"."""
    return [(z, t) for z, t, _ in doubted_blocks(page)]


def doubted_blocks(page: str | None) -> list[tuple[str, str, bool]]:
    """``blocks``, and whether a doubtful box inside an article holds them."""
    page = page or ""
    got = _Blocks()
    stack = got.stack
    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            got.say(page[at:])
            return got.done()
        if m.start() > at:
            got.say(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            where = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if name not in INLINE:
                got.close()
            if where is not None:
                got.leave(where)
            continue
        if name in RAW:
            if not (name in ("svg", "math") and m[3].endswith("/>")):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            got.buffer.append("\n")
            continue
        if name in VOID:
            if name not in INLINE:
                got.close()
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            got.close()
            got.leave(len(stack) - 1)
        got.enter(name, m[3])


def common_lines(a: list, b: list) -> list[int]:
    """Positions in a of a longest common subsequence of a and b (bit-parallel)."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [], full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append(i)
                j -= 1
    return out[::-1]


def prefix(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(a, b):  # noqa: B905  of the shorter one
        if x != y:
            break
        n += 1
    return n


def neighbours(pages: DataFrame) -> DataFrame:
    """(host, path, prev, next): the paths next to each distinct path of a host, null at its ends.

    Paths are sorted by range over the cluster, so that a host of any size is
    spread; the rows at the partitions' borders are matched through a table
    of one row per partition.
    """
    dealt = cut(pages.select("host", "path").distinct().repartitionByRange("host", "path")
                .withColumn("pid", F.spark_partition_id()))
    at = F.struct("host", "path")
    w = Window.partitionBy(F.lit(0)).orderBy("pid")
    edges = dealt.groupBy("pid").agg(F.min(at).alias("low"), F.max(at).alias("high"))  # a row per partition
    edges = edges.select("pid", F.lag("high").over(w).alias("left"), F.lead("low").over(w).alias("right"))
    own = Window.partitionBy("pid").orderBy("host", "path")
    x = dealt.join(edges, "pid")
    x = (x.withColumn("p", F.coalesce(F.lag(at).over(own), "left")).withColumn("n", F.coalesce(F.lead(at).over(own), "right")))
    return x.select("host", "path", F.when(F.col("p.host") == F.col("host"), F.col("p.path")).alias("prev"),
                    F.when(F.col("n.host") == F.col("host"), F.col("n.path")).alias("next"))


def _by_line(rows: DataFrame, lines: DataFrame, total: int, how: str) -> DataFrame:
    """``rows`` joined to ``lines(line, n, ...)``, n being its pages, which add up to ``total``.

    Fewer than 1,000 lines stand on more than a thousandth of all: those are
    joined by broadcast, so no task gets all the rows of a frequent line.
    """
    heavy = F.col("n") > total // 1000
    hot = lines.filter(heavy)
    flagged = rows.join(F.broadcast(hot.select("line", F.lit(True).alias("hot"))), "line", "left")
    rare = flagged.filter("hot is null").drop("hot").join(lines.filter(~heavy), "line", how)
    return rare.unionByName(flagged.filter("hot").drop("hot").join(F.broadcast(hot), "line", how))


def shared(pages: DataFrame) -> DataFrame:
    """(key, gone): the block numbers that pages lose.

    These are the lines that a page shares with its neighbour, of those that
    it keeps by its structure (``kept``); inside an article only doubtful ones
    go (``loose``).  If the two are near copies (the shared lines, each counted
    2 / n times its length where n > 2 pages of the host keep it, outweigh the
    page's others), sharing tells nothing, and a line goes only if another
    group of near copies on the host has it too, loose.  Groups are the
    connected components of such pairs.
    """
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, sizes, kept, loose = [], [], [], []
            for h, host in zip(b.column("html").to_pylist(), b.column("host").to_pylist(), strict=True):
                got = doubted_blocks(h)
                hashes.append([xxhash.xxh3_64_intdigest(f"{host}\n{t}") - (1 << 63) for _, t, _ in got])
                sizes.append([len(t) for _, t, _ in got])
                zone = "main" if any(z == "main" for z, _, _ in got) else "open"
                kept.append([k for k, (z, _, _) in enumerate(got) if z == zone])
                loose.append([k for k in kept[-1] if zone == "open" or got[k][2]])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("host"), b.column("path"), pa.array(hashes, pa.list_(pa.int64())),
                                              *[pa.array(x, pa.list_(pa.int32())) for x in (sizes, kept, loose)]],
                                             names=["key", "host", "path", "lines", "sizes", "kept", "loose"])

    start = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    seen = pages.select(row_key("page_id", "url", "html").alias("key"), "html",
                        F.lower(F.regexp_extract("url", start + r"([^/?#]*)", 1)).alias("host"),
                        F.regexp_extract("url", start + r"[^/?#]*([^?#]*)", 1).alias("path"))
    light = cut(seen.filter("host <> ''").mapInArrow(lines, "key binary, host string, path string, lines array<long>, sizes array<int>, "
                                                              "kept array<int>, loose array<int>"))
    shown = cut(light.groupBy("host", "path").agg(F.min_by(F.struct("lines", "kept", "loose"), "key").alias("x")).select("host", "path", "x.*"))
    ask = light.dropDuplicates(["key"]).join(neighbours(light), ["host", "path"])
    for side in ("prev", "next"):
        ask = ask.join(shown.select("host", F.col("path").alias(side), F.col("lines").alias(f"{side}_lines")), ["host", side], "left")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                pair = [(-prefix(r["path"], r[s]), k, r[s], r[f"{s}_lines"]) for k, s in enumerate(("prev", "next")) if r[s] is not None]
                other, theirs = min(pair)[2:] if pair else (None, [])
                same = set(common_lines(r["lines"], theirs))
                hit, loose = [k for k in r["kept"] if k in same], set(r["loose"])
                rest = sum(r["sizes"][k] for k in r["kept"] if k not in same)
                out.append({"key": r["key"], "host": r["host"], "path": r["path"], "other": other, "n_kept": len(r["kept"]), "rest": rest,
                            "hits": [{"at": k, "line": r["lines"][k], "size": r["sizes"][k], "loose": k in loose} for k in hit]})
            yield pa.RecordBatch.from_pylist(out, schema=aligned)

    aligned = pa.schema([("key", pa.binary()), ("host", pa.string()), ("path", pa.string()), ("other", pa.string()), ("n_kept", pa.int32()),
                         ("rest", pa.int64()), ("hits", pa.list_(pa.struct([("at", pa.int32()), ("line", pa.int64()), ("size", pa.int32()), ("loose", pa.bool_())])))])
    cols = ["key", "host", "path", "prev", "next", "lines", "sizes", "kept", "loose", "prev_lines", "next_lines"]
    hits = cut(ask.select(*cols).mapInArrow(align, "key binary, host string, path string, other string, n_kept int, rest long, "
                                                   "hits array<struct<at:int,line:long,size:int,loose:boolean>>")
               .filter(F.size("hits") > 0)
               .select("key", F.xxhash64("host", "path").alias("page"), F.xxhash64("host", "other").alias("other"), "n_kept", "rest", "hits"))

    own = {c: F.array_distinct(F.transform(c, lambda k: F.get("lines", k))) for c in ("kept", "loose")}
    open_lines = shown.filter(F.size("loose") > 0).select(F.xxhash64("host", "path").alias("page"), own["loose"].alias("own"))
    counts = cut(shown.select(F.explode(own["kept"]).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = hits.select("key", "page", "other", "rest", F.inline("hits"))
    weight = F.expr("size * 2000000L div greatest(coalesce(n, 2L), 2L)")
    near = cut(_by_line(rows, counts, total, "left").groupBy("key", "page", "other", "rest").agg(F.sum(weight).alias("w"))
               .filter(F.col("w") > F.col("rest") * 1000000).select("key", "page", "other"))
    sure = hits.join(near.select("key"), "key", "left_anti").select("key", "n_kept", F.filter("hits", lambda x: x["loose"])["at"].alias("gone"))
    group = components(near.select(F.col("page").alias("a"), F.col("other").alias("b"))).select(F.col("id").alias("page"), "root")
    wide = cut(open_lines.join(group, "page", "left").select(F.coalesce("root", "page").alias("root"), F.explode("own").alias("line"))
               .groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
               .filter("low <> high").select("line", "n"))
    doubted = hits.join(near.select("key"), "key", "left_semi").select("key", "n_kept", F.inline("hits")).filter("loose").drop("loose")
    also = (_by_line(doubted, wide, total, "inner").groupBy("key", "n_kept").agg(F.collect_list("at").alias("gone")))
    return cut(sure.unionByName(also).filter((F.size("gone") > 0) & (F.size("gone") < F.col("n_kept"))).select("key", "gone"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): every page's main text."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, gone in zip(b.column("html").to_pylist(), b.column("gone").to_pylist(), strict=True):
                got = blocks(h)
                zone = "main" if any(z == "main" for z, _ in got) else "open"
                out.append(" ".join(t for k, (z, t) in enumerate(got) if z == zone and k not in (gone or ())))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    keyed = pages.select(F.col("page_id").cast("long"), "url", "html", row_key("page_id", "url", "html").alias("key"))
    return (keyed.join(shared(pages), "key", "left").select("page_id", "url", "html", "gone")
            .mapInArrow(texts, "page_id long, url string, text string, n_chars long"))
