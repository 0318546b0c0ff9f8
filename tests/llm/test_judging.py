"""op2, op5, op6, op7 and op10, and the pipeline."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from conftest import SF, awkward

import corpus_pipeline
from pivotscore.llm import op2_quality, op5_pii, op6_mix, op7_html, op9_bpe, op10_ann
from pivotscore.llm.common import components, table


# ---- quality --------------------------------------------------------------- #
def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, again = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            again += x in seen
            seen.add(x)
    triples = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if triples[w] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)]


def test_counts_by_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice(["a ", "b ", "cc", "\n", " ", "#", "é", "\x0b", "|", "a b c "]) for _ in range(rng.randint(0, 80)))
        assert op2_quality.measure(t)[0] == counted(t), repr(t)


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.RandomState(0)
    x = rng.rand(1500, 3)
    y = ((x[:, 0] < 0.5) ^ (rng.rand(1500) < 0.05)).astype(float)
    model = op2_quality.fit(x, y, [-1, 0, 1], rounds=25)
    z = rng.rand(800, 3)
    assert ((model.score(z) > 0.5) == (z[:, 0] < 0.5)).mean() > 0.93  # held out
    for j, sign in ((0, -1), (2, 1)):
        up = z.copy()
        up[:, j] += rng.rand(800)
        assert (sign * (model.score(up) - model.score(z)) >= -1e-12).all()
    assert op2_quality.fit(x, np.ones(1500), [0, 0, 0]) is None


def test_flattened_trees_score_as_a_walk():
    rng = np.random.RandomState(1)
    x, y = rng.rand(300, 4), (rng.rand(300) < 0.4).astype(float)
    m = op2_quality.fit(x, y, [0, 1, -1, 0], rounds=5, depth=3)
    for r in x[:50]:
        total = m.base
        for f, c, v in zip(m.feature, m.cut, m.value, strict=True):
            k = 0
            while k < 2 ** m.depth - 1:
                k = 2 * k + 1 + (r[f[k]] > c[k])
            total += v[k]
        assert abs(m.score(r[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_quality_of_awkward_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    model = op2_quality.train(docs, labels)
    assert model is None  # one class is left
    rows = op2_quality.judge(docs, model).collect()
    assert len(rows) == len(awkward())
    assert all(r.kept == (not r.base_failed) for r in rows)
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((str(r[0]), *counted(r[1] or "")) for r in awkward())
    assert op2_quality.judge(no_docs, model).count() == 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    x, y = op2_quality.sample(docs, labels, 4000)
    m = op2_quality.fit(x[::2], y[::2], list(op2_quality.FEATURES.values()))
    right = (m.score(x[1::2]) >= 0.5) == (y[1::2] > 0)
    assert right.mean() > 0.95


# ---- personal data --------------------------------------------------------- #
def plain(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and op5_pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_rules_equal_the_plain_patterns():
    rng = random.Random(1)
    for _ in range(15000):
        t = "".join(rng.choice("a1.@+ -(2)%é45") for _ in range(rng.randint(0, 60)))
        assert op5_pii.base(t) == plain(t), repr(t)


@pytest.fixture(scope="module")
def weights():
    return op5_pii.fit(op5_pii.made_up())


def test_decoding_finds_the_best_segmentation(weights):
    """Dynamic programming against all segmentations."""
    for t in ["+1 (269) 555-3296 41", "a.1@b.co 10.0.0.1", "(123) 456-7890 7"]:
        cuts, found, rows = op5_pii.segments(t, (0, len(t)))
        s = op5_pii.scores(found, rows, weights)
        n = len(cuts) - 1
        best = op5_pii.best(n, found, s, weights[-1])
        value = lambda pick: sum(s[found.index(f)] for f in pick) + weights[-1] * (n - sum(j - i for i, j, _ in pick))
        top = max((p for r in range(4) for p in itertools.combinations(found, r) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(p, 2))),
                  key=value)
        assert abs(value(best) - value(top)) < 1e-9


def test_expectations_match_the_gradient(weights):
    t = "+1 269 555 3296"
    cuts, found, rows = op5_pii.segments(t, (0, len(t)))
    s = op5_pii.scores(found, rows, weights)
    z, p, out = op5_pii.expected(len(cuts) - 1, found, s, weights[-1])
    for k in range(0, len(found), 5):
        up = s.copy()
        up[k] += 1e-5
        assert abs((op5_pii.expected(len(cuts) - 1, found, up, weights[-1])[0] - z) / 1e-5 - p[k]) < 1e-3


def test_field_is_right_on_held_out_stretches(weights):
    cases = op5_pii.made_up(300, seed=9)
    right = 0
    for t, gold in cases:
        cuts, found, rows = op5_pii.segments(t, (0, len(t)))
        got = [(op5_pii.KINDS[k], cuts[i], cuts[j]) for i, j, k in op5_pii.best(len(cuts) - 1, found, op5_pii.scores(found, rows, weights), weights[-1])]
        right += sorted(got) == sorted(gold)
    assert right >= 270


def test_spans_of_awkward_rows(docs, no_docs, weights):
    rows = op5_pii.find(docs, weights).collect()
    assert len(rows) == len(awkward())
    one = next(r for r in rows if r.doc_id == 12)
    text = next(r[1] for r in awkward() if r[0] == 12)
    found = {text[int(s):int(e)]: k for k, s, e in (x.split(":") for x in one.spans.split(","))}
    assert found == {"a@b.org": "email", "10.0.0.1": "ip", "4524132264652876": "card", "+1 (269) 555-3296": "phone"}
    # The base rules read phone and card as one run of 23 digits and drop it: the field finds both.
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone, one.n_added) == (1, 1, 0, 0, 2)
    assert op5_pii.find(no_docs, weights).count() == 0
    hidden = {r.doc_id: r.text for r in op5_pii.redact(docs.select("doc_id", "text"), weights).collect()}
    assert hidden[12] == "mail [EMAIL], [PHONE] [CARD] or [IP] été 😀" and hidden[5] is None


# ---- mixing ---------------------------------------------------------------- #
def test_mix_of_awkward_rows(docs, no_docs):
    rows = op6_mix.copies(docs).collect()
    sizes = collections.Counter()
    for d, t, _, s, _ in awkward():
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: op6_mix.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = 1.5 * sum(sizes.values()), set(order)
    while open_ and left > 1e-9:  # the contract's own procedure
        share = {s: target[s] + left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        target.update({s: min(v, 2.0 * sizes[s]) for s, v in share.items()})
        left = sum(share[s] - 2 * sizes[s] for s in over)
        open_ -= over
    taken = collections.Counter()
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 * (1 + r.target) and r.source_size == sizes[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= max([r.size for r in rows if r.source == s], default=largest) for s in order)
    assert len(rows) == len(awkward()) and op6_mix.copies(no_docs).count() == 0
    again = op6_mix.copies(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_equals_its_sql(spark):
    from compare import canon, duck
    got = op6_mix.copies(table(spark, SF, "documents")).select("doc_id", "size", "source_size", "target", "taken")
    res = duck(SF).execute(op6_mix.oracle())
    assert canon(got.columns, got.collect()) == canon([d[0] for d in res.description], res.fetchall())


def test_repeated_rows_are_those_taken(docs):
    some = docs.select("doc_id", "text", "lang", "source", "n_chars")
    n = collections.Counter((r.doc_id, r.source, r.text) for r in op6_mix.repeat(some).collect())
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) * k for (_, _, t), k in n.items())
    assert words == sum(r.taken for r in op6_mix.copies(some).collect())


# ---- pages ----------------------------------------------------------------- #
def test_extract_awkward_pages(spark):
    page = "<!DOCTYPE html><title>t</title><body><nav>menu</nav><div class='cookie-notice'>ok?</div><article><header><h1>Head &amp; more</h1></header>" \
           "<p>One <b>b</b>old&nbsp;\n line<p>Two<br>lines<script>var x='</p>';</script><form>ask</form><aside>side</aside><div id=comments><p>me too</div>" \
           "<table><tr><td>c1<td>c2</table><footer>f</footer></article><footer>&copy; x</footer>"
    rows = [(1, "http://h/a", page), (1, "http://h/a", page), (2, None, None), (3, "http://h/b", ""), (None, "x", "<p>loose"), (4, "http://g/x/1", "<div>Top</div><p>First.</p><p>End</p>"),
            (5, "http://g/x/2", "<div>Top</div><p>Second.</p><p>End</p>"), (6, "http://g/x/2?q", "<div>Top</div><p>Second.</p><p>End</p>"),
            (7, "http://k/1", "<p>same</p>"), (8, "http://k/2", "<p>same</p>"), (9, "http://h/c", "<article>cut <b>off</b><p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as gone", "3 as key", "4 as host")
    got = collections.defaultdict(set)
    for r in op7_html.extract(df).collect():
        got[r.page_id].add(r.text)
        assert r.n_chars == len(r.text)
    want = {1: "Head & more One bold line Two lines c1 c2", 2: "", 3: "", None: "loose", 4: "First.", 5: "Second.", 6: "Second.", 7: "same", 8: "same", 9: "cut off"}
    assert dict(got) == {k: {v} for k, v in want.items()}
    assert op7_html.extract(df.limit(0)).count() == 0


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = op7_html.common_lines(a, b)
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(any(x == y for y in rest) for x in [a[k] for k in got])


def test_neighbours_across_partitions(spark):
    rows = [(f"h{k % 3}", f"/{k:03d}") for k in range(90)] + [("z", "/only")]
    got = {(r.host, r.path): (r.prev, r.next) for r in op7_html.neighbours(spark.createDataFrame(rows, "host string, path string")).collect()}
    for h in ("h0", "h1", "h2", "z"):
        paths = sorted(p for x, p in rows if x == h)
        for k, p in enumerate(paths):
            assert got[(h, p)] == (paths[k - 1] if k else None, paths[k + 1] if k + 1 < len(paths) else None)


# ---- neighbours ------------------------------------------------------------ #
def exact(x, ids, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    return [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != q][:k]


def test_search_of_awkward_vectors(spark):
    bad = [(900, None), (901, [0.0, 0.0]), (902, [float("nan"), 1.0]), (903, [float("inf"), 1.0]), (904, [None, 1.0]), (None, [1.0, 1.0])]
    good = [(k, [float(k % 4), 1.0 + k // 4]) for k in range(24)] + [(100, [0.0, 1.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(bad + good, "vec_id long, embedding array<float>").selectExpr("*", "1 as part", "2 as rank", "3 as score")
    got = collections.defaultdict(list)
    for r in sorted(op10_ann.search(df, df.filter("vec_id % 100 = 0")).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    x, ids = np.array([v for _, v in good[:-1]]), np.array([k for k, _ in good[:-1]])
    assert dict(got) == {0: exact(x, ids, 0), 100: exact(x, ids, 100)}
    few = df.filter("vec_id in (0, 1, 2)")
    assert op10_ann.search(few, few.filter("vec_id = 0")).count() == 2
    assert op10_ann.search(df.limit(0), df.limit(0)).count() == 0


def test_recall_and_exact_scores(spark):
    v = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = op10_ann.search(v, v.filter("vec_id % 20 = 0")).collect()
    rows = v.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        want = dict(exact(x, ids, q))
        mine = {r.vec_id: r.score for r in got if r.query_id == q}
        assert all(abs(mine[k] - want[k]) < 1e-14 for k in mine if k in want)
        hit += len(want.keys() & mine.keys())
        total += len(want)
    assert hit / total >= 0.9


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.RandomState(3)
    x = np.concatenate([rng.randn(150, 8) + 6 * rng.randn(8) for _ in range(8)])
    edges = op10_ann.nearest(x, x, 11)[:, 1:]
    label = op10_ann.balanced(edges, x, 8)
    assert np.bincount(label, minlength=8).max() <= 1.05 * len(x) / 8 + 1
    assert (label[edges] == label[:, None]).mean() > 0.8


# ---- common and the pipeline ------------------------------------------------ #
def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: top(i) for a, b in links if a != b for i in (a, b)}


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    seen = [{r.doc_id: r for r in docs.collect()}]
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == docs.columns, name
        seen.append({r.doc_id: r for r in step.collect()})
    raw, good, single, hidden, mixed = seen
    assert all(not op2_quality.base_failed(*(op2_quality.measure(r.text)[0][k] for k in (0, 4))) for r in good.values())
    assert set(single) <= set(good) and set(mixed) <= set(hidden) == set(single)
    assert not any(op5_pii.base(r.text) for r in hidden.values()) and all(r.n_chars == len(r.text) for r in hidden.values())
    out = corpus_pipeline.run(spark, SF)
    n = collections.Counter(r.doc_id for r in step.collect())
    assert collections.Counter(r.doc_id for r in out.collect()) == n
    assert {(r.doc_id, r.n_tokens) for r in out.collect()} == {(r.doc_id, r.n_tokens) for r in op9_bpe.digests(step).collect()}
