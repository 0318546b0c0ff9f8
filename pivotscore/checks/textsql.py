"""DuckDB SQL for the text side: sentences, channels, protocols, pair scores."""

from __future__ import annotations

from ..functions.channels import CHANNEL_SPECS, FAIL_PREFIX
from ..functions.text import TOK13A_LITERALS, TOK13A_REGEXES, WS
from .oracle import PIV

PIVOT = "en"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lit(s: str) -> str:
    """SQL literal, newlines spelled with chr(10)."""
    parts = s.split("\n")
    return " || chr(10) || ".join(q(p) for p in parts) if len(parts) > 1 else q(s)


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def tok13a(x: str) -> str:
    for a, b in TOK13A_LITERALS:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    x = f"(' ' || {x} || ' ')"
    for pat, rep in TOK13A_REGEXES:
        r = rep.replace("{1}", "\\1").replace("{2}", "\\2")
        x = f"regexp_replace({x}, {q(pat)}, {q(r)}, 'g')"
    return strip_ws(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def split_tokens(s: str) -> str:
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split({s}, ' ') END)"


def ngrams(t: str, n: int) -> str:
    if n == 1:
        return t
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))"


def char_grams(x: str) -> str:
    return f"list_transform(range(1, length({x}) - 1), lambda i: substring({x}, i, 3))"


def sentences_cte(name: str = "sent") -> str:
    pieces = f"string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))"
    return (f"{name}_p AS (SELECT doc_id, lang AS domain, {pieces} AS pieces FROM documents), "
            f"{name}_u AS (SELECT doc_id, domain, unnest(range(0, len(pieces))) AS pos, unnest(pieces) AS piece FROM {name}_p), "
            f"{name} AS (SELECT domain, concat_ws(':', doc_id, pos) AS sent_id, doc_id, {strip_ws('piece')} AS text "
            f"FROM {name}_u WHERE {strip_ws('piece')} <> '')")


def key(backend: str, src: str, tgt: str, text: str) -> str:
    return f"md5(concat_ws('|', {backend}, {src}, {tgt}, {text}))"


def channel(backend: str, text: str, tgt: str, src_code: str, tgt_code: str) -> str:
    """The test channels as a SQL expression (identity for unknown names)."""
    def run(spec, code):
        frm, to, k = spec
        return (f"array_to_string(list_filter(string_split(translate(lower({text}), {q(frm)}, {q(to)}), ' '), "
                f"lambda w: length(w) % ({k} + {code} % 5) <> 0), ' ')")
    whens = []
    for name, spec in CHANNEL_SPECS.items():
        whens.append(f"WHEN {backend} = {q(name)} AND {tgt} <> {q(PIVOT)} THEN {run(spec['fwd'], tgt_code)}")
        whens.append(f"WHEN {backend} = {q(name)} THEN {run(spec['back'], src_code)}")
    return f"(CASE WHEN {text} = '' THEN {text} {' '.join(whens)} ELSE {text} END)"


def failed(backend: str, text: str, k: str) -> str:
    names = ", ".join(q(n) for n in CHANNEL_SPECS)
    return f"({backend} IN ({names}) AND {text} <> '' AND starts_with({k}, {q(FAIL_PREFIX)}))"


def resolve_cte(name: str, src_cte: str, backend="backend", src="src", tgt="tgt", src_code="src_code",
                tgt_code="tgt_code", text="text", out="value") -> list[str]:
    """Add ``{out}`` and ``{out}_failed`` to every row of ``src_cte``."""
    return [
        f"{name}_k AS (SELECT *, {key(backend, src, tgt, text)} AS _k FROM {src_cte})",
        f"{name} AS (SELECT * EXCLUDE (_k), CASE WHEN {failed(backend, text, '_k')} THEN {text} "
        f"ELSE {channel(backend, text, tgt, src_code, tgt_code)} END AS {out}, "
        f"{failed(backend, text, '_k')} AS {out}_failed FROM {name}_k)",
    ]


BACKENDS = ["alpha", "beta"]


def backends_cte(backends: list[str] | None = None, name: str = "bk") -> str:
    vals = ", ".join(f"({q(b)})" for b in (backends or BACKENDS))
    return f"{name}(backend) AS (VALUES {vals})"


def chain_cte() -> list[str]:
    spec = []
    for order, positions in (("linguistic", [1, 2, 3, 4, 5]), ("reverse", [5, 4, 3, 2, 1]),
                             ("random", [3, 1, 5, 2, 4])):
        for hop, pos in enumerate(positions, start=1):
            spec.append(f"({q(order)}, {hop}, {pos})")
    return [PIV,
            "frn AS (SELECT family_ord, min(code) AS code FROM piv GROUP BY family_ord)",
            "ling AS (SELECT frn.code, p.language, row_number() OVER (ORDER BY frn.family_ord) AS pos "
            "FROM frn JOIN piv p USING (code))",
            f"spec(\"order\", hop, pos) AS (VALUES {', '.join(spec)})",
            "ch AS (SELECT \"order\", hop, language, code FROM spec JOIN ling USING (pos) WHERE pos <= 5)"]


# ---- pair scoring ----------------------------------------------------------- #

def _bag_steps(prefix: str, cols: dict[str, str], src: str) -> list[str]:
    """CTEs turning sorted list columns into run-length bags ``{col}``."""
    s1 = ", ".join(f"list_sort({expr}) AS {c}__s" for c, expr in cols.items())
    s2 = ", ".join(f"list_filter(range(1, len({c}__s) + 1), lambda i: i = 1 OR {c}__s[i] <> {c}__s[i - 1]) AS {c}__st"
                   for c in cols)
    s3 = ", ".join(
        f"list_transform(range(1, len({c}__st) + 1), lambda j: {{'w': {c}__s[{c}__st[j]], "
        f"'c': coalesce({c}__st[j + 1], len({c}__s) + 1) - {c}__st[j]}}) AS {c}" for c in cols)
    drop = ", ".join([f"{c}__s" for c in cols] + [f"{c}__st" for c in cols])
    return [f"{prefix}_1 AS MATERIALIZED (SELECT *, {s1} FROM {src})",
            f"{prefix}_2 AS MATERIALIZED (SELECT *, {s2} FROM {prefix}_1)",
            f"{prefix} AS MATERIALIZED (SELECT * EXCLUDE ({drop}), {s3} FROM {prefix}_2)"]


def profile_ctes(prefix: str, src: str, text: str, p: str, lexical=True, encoder=True) -> list[str]:
    """Add ``{p}_len``, bags ``{p}_b1..b4``, ``{p}_lb``, ``{p}_cb`` to ``src``."""
    ctes = [f"{prefix}_t AS MATERIALIZED (SELECT *, {split_tokens(tok13a(text))} AS {p}_tok, lower({text}) AS {p}_low FROM {src})"]
    cols = {f"{p}_b{n}": ngrams(f"{p}_tok", n) for n in range(1, 5)}
    if lexical:
        cols[f"{p}_lb"] = f"list_transform({p}_tok, lambda x: lower(x))"
    if encoder:
        cols[f"{p}_cb"] = char_grams(f"{p}_low")
    ctes += _bag_steps(f"{prefix}_b", cols, f"{prefix}_t")
    ctes.append(f"{prefix} AS (SELECT * EXCLUDE ({p}_tok, {p}_low), len({p}_tok) AS {p}_len FROM {prefix}_b)")
    return ctes


def _neigh(u: str, how: str) -> str:
    v = f"least({u}[i].c, {u}[i + 1].c)" if how == "min" else f"CAST({u}[i].c AS BIGINT) * {u}[i + 1].c"
    return (f"coalesce(list_sum(list_transform(range(1, len({u})), lambda i: "
            f"CASE WHEN {u}[i].w = {u}[i + 1].w THEN {v} ELSE 0 END)), 0)")


def _norm(b: str) -> str:
    return f"coalesce(list_sum(list_transform({b}, lambda e: CAST(e.c AS BIGINT) * e.c)), 0)"


def _cos(dot: str, na: str, nb: str) -> str:
    return (f"(CASE WHEN {na} = 0 OR {nb} = 0 THEN 0.0 ELSE CAST({dot} AS DOUBLE) / "
            f"sqrt(CAST({na} AS DOUBLE) * CAST({nb} AS DOUBLE)) END)")


def pair_stats_ctes(prefix: str, src: str, lexical=True, encoder=True) -> list[str]:
    """From profiles r_*, h_*: m1..m4, t1..t4, hyp_len, ref_len, pair_cosine, pair_embedding."""
    us = [f"list_sort(h_b{n} || r_b{n}) AS _u{n}" for n in range(1, 5)]
    if lexical:
        us.append("list_sort(h_lb || r_lb) AS _ul")
    if encoder:
        us.append("list_sort(h_cb || r_cb) AS _uc")
    cols = [f"{_neigh(f'_u{n}', 'min')} AS m{n}" for n in range(1, 5)]
    cols += [f"greatest(h_len - {n - 1}, 0) AS t{n}" for n in range(1, 5)]
    cols += ["h_len AS hyp_len", "r_len AS ref_len"]
    if lexical:
        cols.append(f"{_cos(_neigh('_ul', 'prod'), _norm('h_lb'), _norm('r_lb'))} AS pair_cosine")
    if encoder:
        cols.append(f"{_cos(_neigh('_uc', 'prod'), _norm('h_cb'), _norm('r_cb'))} AS pair_embedding")
    return [f"{prefix}_u AS MATERIALIZED (SELECT *, {', '.join(us)} FROM {src})",
            f"{prefix} AS (SELECT *, {', '.join(cols)} FROM {prefix}_u)"]


def bleu_expr() -> str:
    """Corpus BLEU from summed m1..m4, t1..t4, hyp_len, ref_len (columns)."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    logs = []
    zeros = "0"
    for n in range(1, 5):
        zeros = f"{zeros} + (CASE WHEN m{n} = 0 THEN 1 ELSE 0 END)"
        p = (f"(CASE WHEN m{n} > 0 THEN 100.0::DOUBLE * {d(f'm{n}')} / {d(f't{n}')} "
             f"ELSE 100.0::DOUBLE / (pow(2.0::DOUBLE, {zeros}) * {d(f't{n}')}) END)")
        logs.append(f"ln({p})")
    bp = (f"(CASE WHEN hyp_len >= ref_len THEN 1.0::DOUBLE WHEN hyp_len = 0 THEN 0.0::DOUBLE "
          f"ELSE exp(1.0::DOUBLE - {d('ref_len')} / {d('hyp_len')}) END)")
    return (f"(CASE WHEN m1 + m2 + m3 + m4 = 0 OR t4 = 0 THEN 0.0::DOUBLE "
            f"ELSE {bp} * exp(({' + '.join(logs)}) / 4.0::DOUBLE) END)")


def score_ctes(name: str, pairs: str, keys: list[str], ref: str, hyp: str, lexical=True,
               encoder=True, rounded=True) -> list[str]:
    """CTE ``name``(keys..., bleu, cosine, embedding, n_pairs) from a pairs CTE."""
    ctes = profile_ctes(f"{name}_pr", pairs, ref, "r", lexical, encoder)
    ctes += profile_ctes(f"{name}_ph", f"{name}_pr", hyp, "h", lexical, encoder)
    ctes += pair_stats_ctes(f"{name}_ps", f"{name}_ph", lexical, encoder)
    k = ", ".join(keys)
    sums = ", ".join([f"sum(m{n}) AS m{n}" for n in range(1, 5)] + [f"sum(t{n}) AS t{n}" for n in range(1, 5)]
                     + ["sum(hyp_len) AS hyp_len", "sum(ref_len) AS ref_len", "count(*) AS n_pairs"])
    extra = []
    if lexical:
        extra.append("avg(pair_cosine) AS cosine")
    if encoder:
        extra.append("avg(pair_embedding) AS embedding")
    ctes.append(f"{name}_g AS (SELECT {k}, {sums}{', ' if extra else ''}{', '.join(extra)} FROM {name}_ps GROUP BY {k})")
    edge = (lambda x, d: f"round({x}, {d})") if rounded else (lambda x, d: x)
    outs = [f"{edge(bleu_expr(), 4)} AS bleu"]
    if lexical:
        outs.append(f"{edge('cosine', 6)} AS cosine")
    if encoder:
        outs.append(f"{edge('embedding', 6)} AS embedding")
    ctes.append(f"{name} AS (SELECT {k}, {', '.join(outs)}, n_pairs FROM {name}_g)")
    return ctes


# ---- protocols ---------------------------------------------------------------- #

def back_translate_ctes(langs_cte: str = "piv", backends: list[str] | None = None) -> list[str]:
    """CTE ``bt``(backend, family, language, code, domain, sent_id, text, forward, back, *_failed)."""
    ctes = [sentences_cte(), backends_cte(backends),
            f"grid AS (SELECT bk.backend, l.family, l.language, l.code, s.domain, s.sent_id, s.text "
            f"FROM sent s CROSS JOIN {langs_cte} l CROSS JOIN bk)",
            f"fq AS (SELECT *, {q(PIVOT)} AS src, language AS tgt, NULL::INTEGER AS src_code, code AS tgt_code FROM grid)"]
    ctes += resolve_cte("fr", "fq", out="forward")
    ctes.append(f"bq AS (SELECT * EXCLUDE (src, tgt, src_code, tgt_code), language AS src, {q(PIVOT)} AS tgt, "
                f"code AS src_code, NULL::INTEGER AS tgt_code FROM fr)")
    ctes += resolve_cte("bt0", "bq", text="forward", out="back")
    ctes.append("bt AS (SELECT * EXCLUDE (src, tgt, src_code, tgt_code) FROM bt0)")
    return ctes


def telephone_ctes(hops: int = 5) -> list[str]:
    """CTE ``tdet``(backend, "order", domain, sent_id, hop, lang, out): the English detours."""
    ctes = chain_cte() + [sentences_cte(), backends_cte(),
                          "ords AS (SELECT DISTINCT \"order\" FROM ch)",
                          f"c0 AS (SELECT bk.backend, o.\"order\", s.domain, s.sent_id, s.text AS cur, "
                          f"{q(PIVOT)} AS cur_lang, NULL::INTEGER AS cur_code FROM sent s CROSS JOIN ords o CROSS JOIN bk)"]
    dets = []
    for h in range(1, hops + 1):
        ctes.append(f"q{h} AS (SELECT c.backend, c.\"order\", c.domain, c.sent_id, c.cur_lang AS src, ch.language AS tgt, "
                    f"c.cur_code AS src_code, ch.code AS tgt_code, c.cur AS text FROM c{h - 1} c "
                    f"JOIN ch ON ch.\"order\" = c.\"order\" AND ch.hop = {h})")
        ctes += resolve_cte(f"r{h}", f"q{h}")
        ctes.append(f"c{h} AS (SELECT backend, \"order\", domain, sent_id, value AS cur, tgt AS cur_lang, "
                    f"tgt_code AS cur_code FROM r{h})")
        ctes.append(f"dq{h} AS (SELECT backend, \"order\", domain, sent_id, cur_lang AS src, {q(PIVOT)} AS tgt, "
                    f"cur_code AS src_code, NULL::INTEGER AS tgt_code, cur AS text FROM c{h})")
        ctes += resolve_cte(f"d{h}", f"dq{h}")
        dets.append(f"SELECT backend, \"order\", domain, sent_id, {h} AS hop, src AS lang, value AS out FROM d{h}")
    ctes.append("tdet AS (" + " UNION ALL ".join(dets) + ")")
    return ctes


def round_trip_ctes(backends: list[str] | None = None) -> list[str]:
    """CTE ``rt3``: back-translation over the round-trip languages plus the third leg."""
    ctes = chain_cte() + ["rtl AS (SELECT NULL::VARCHAR AS family, language, code FROM ch WHERE \"order\" = 'linguistic')"]
    ctes += back_translate_ctes("rtl", backends)
    ctes.append(f"tq AS (SELECT *, {q(PIVOT)} AS src, language AS tgt, NULL::INTEGER AS src_code, code AS tgt_code FROM bt)")
    ctes += resolve_cte("rt3_0", "tq", text="back", out="third")
    ctes.append("rt3 AS (SELECT * EXCLUDE (src, tgt, src_code, tgt_code) FROM rt3_0)")
    return ctes


# ---- whole queries ------------------------------------------------------------ #

def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def with_sent(body: str) -> str:
    return with_ctes([sentences_cte()], body)


def request_keys_sql() -> str:
    return with_ctes([PIV, sentences_cte(), backends_cte()],
                     f"SELECT backend, 'en' AS src, language AS tgt, sent_id, {key('backend', q(PIVOT), 'language', 'text')} AS key "
                     "FROM sent CROSS JOIN piv CROSS JOIN bk")


def cell_grid_sql() -> str:
    return with_ctes([PIV, sentences_cte(), backends_cte()],
                     "SELECT backend, family, language, domain, count(*) AS n_sentences FROM sent CROSS JOIN piv "
                     "CROSS JOIN bk GROUP BY ALL")


def translate_step_sql() -> str:
    ctes = [PIV, sentences_cte(), backends_cte(),
            f"tq AS (SELECT backend, language, sent_id, {q(PIVOT)} AS src, language AS tgt, NULL::INTEGER AS src_code, "
            "code AS tgt_code, text FROM sent CROSS JOIN piv CROSS JOIN bk)"]
    ctes += resolve_cte("tr", "tq")
    return with_ctes(ctes, "SELECT backend, language, sent_id, value, value_failed AS failed FROM tr")


def back_translate_sql() -> str:
    return with_ctes([PIV] + back_translate_ctes(),
                     "SELECT backend, family, language, domain, sent_id, forward, back, forward_failed, back_failed FROM bt")


def back_translation_cells_sql() -> str:
    ctes = [PIV] + back_translate_ctes()
    ctes.append("btp AS (SELECT bt.backend, bt.family, bt.language, bt.domain, s.text AS original, bt.back "
                "FROM bt JOIN sent s USING (sent_id))")
    ctes += score_ctes("sc", "btp", ["backend", "family", "language", "domain"], "original", "back")
    return with_ctes(ctes, "SELECT backend AS translator, family, language, domain, bleu, cosine, embedding, n_pairs FROM sc")


def chain_fact_ctes() -> list[str]:
    ctes = telephone_ctes()
    ctes.append("tp AS (SELECT d.backend, d.\"order\", d.domain, d.hop, d.lang, s.text AS original, d.out "
                "FROM tdet d JOIN sent s USING (sent_id))")
    ctes += score_ctes("tsc", "tp", ["backend", "\"order\"", "domain", "hop", "lang"], "original", "out", encoder=False)
    ctes.append("tfact AS (SELECT backend AS translator, \"order\", domain, hop, lang AS lang_code, cosine, bleu FROM tsc "
                "UNION ALL SELECT bk.backend, o.\"order\", d.domain, 0, 'en', 1.0, 100.0 FROM "
                "(SELECT DISTINCT domain FROM sent) d CROSS JOIN ords o CROSS JOIN bk)")
    return ctes


def telephone_chain_sql() -> str:
    return with_ctes(chain_fact_ctes(), "SELECT * FROM tfact")


def rt_fact_ctes(rounded: bool = False) -> list[str]:
    ctes = round_trip_ctes()
    ctes.append("abap AS (SELECT r.backend, r.language, r.domain, s.text AS original, r.back FROM rt3 r JOIN sent s USING (sent_id))")
    ctes += score_ctes("aba", "abap", ["backend", "language", "domain"], "original", "back", encoder=False, rounded=rounded)
    ctes += score_ctes("bab", "rt3", ["backend", "language", "domain"], "forward", "third", encoder=False, rounded=rounded)
    ctes.append("rfact AS (SELECT backend AS translator, language, domain, 'ABA' AS direction, cosine, bleu FROM aba "
                "UNION ALL SELECT backend, language, domain, 'BAB', cosine, bleu FROM bab)")
    return ctes


def round_trip_sql() -> str:
    return with_ctes(rt_fact_ctes(True), "SELECT * FROM rfact")


ASYM = ("asym AS (SELECT translator, language, round(abs(aba - bab), 4) AS asymmetry FROM ("
        "SELECT translator, language, avg(CASE WHEN direction = 'ABA' THEN cosine END) AS aba, "
        "avg(CASE WHEN direction = 'BAB' THEN cosine END) AS bab FROM rfact GROUP BY ALL) "
        "WHERE aba IS NOT NULL AND bab IS NOT NULL)")


def asymmetry_sql() -> str:
    return with_ctes(rt_fact_ctes() + [ASYM], "SELECT * FROM asym")


def roundtrip_bars_sql() -> str:
    parts = []
    for m in ["cosine", "bleu"]:
        parts.append(f"SELECT translator, language, '{m}' AS metric, "
                     f"round(coalesce(avg(CASE WHEN direction = 'ABA' THEN {m} END), 0.0), 4) AS aba, "
                     f"round(coalesce(avg(CASE WHEN direction = 'BAB' THEN {m} END), 0.0), 4) AS bab "
                     f"FROM rfact GROUP BY translator, language")
    return with_ctes(rt_fact_ctes(), " UNION ALL ".join(parts))


def asymmetry_wide_sql(translators: list[str]) -> str:
    cols = ", ".join(f"max(CASE WHEN translator = {q(t)} THEN asymmetry END) AS asym_{t}" for t in translators)
    return with_ctes(rt_fact_ctes() + [ASYM, f"aw AS (SELECT language, {cols}, round(avg(asymmetry), 6) AS mean_asym "
                                              "FROM asym GROUP BY language)"],
                     "SELECT *, row_number() OVER (ORDER BY mean_asym DESC, language) AS row FROM aw")


def chain_curve_sql() -> str:
    w = "OVER (PARTITION BY translator, domain, \"order\" ORDER BY hop)"
    return with_ctes(chain_fact_ctes(),
                     f"SELECT translator, domain, \"order\", hop, lang_code, cosine, bleu, "
                     f"round(lag(cosine) {w} - cosine, 6) AS cosine_drop, round(lag(bleu) {w} - bleu, 6) AS bleu_drop FROM tfact")


def conv_scores_sql(body: str) -> str:
    ctes = ["cp AS (SELECT c.role, c.text AS original, n.text AS candidate FROM conversations c "
            "JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)"]
    ctes += score_ctes("cs", "cp", ["role"], "original", "candidate", encoder=False)
    return with_ctes(ctes, body)


def word_edit_rate_sql() -> str:
    """Word edit distance by anti-diagonals: cell i of diagonal d is the distance of i candidate and d - i original words."""
    far = 1 << 30
    step = (f"list_transform(range(0, len(h) + 1), lambda i: CASE WHEN d + 1 - i < 0 OR d + 1 - i > len(r) THEN {far} "
            "WHEN i = 0 THEN d + 1 WHEN i = d + 1 THEN i "
            "ELSE least(one[i] + 1, one[i + 1] + 1, two[i] + CASE WHEN h[i] = r[d + 1 - i] THEN 0 ELSE 1 END) END)")
    low = "lower(coalesce({}, ''))"
    body = f"""SELECT role, round(CASE WHEN sum(len(r)) > 0 THEN 100.0 * sum(edits) / sum(len(r)) WHEN sum(edits) > 0 THEN 100.0 ELSE 0.0 END, 4)
 AS word_edit_rate FROM p JOIN e USING (id) GROUP BY role"""
    return "WITH RECURSIVE " + ",\n".join([
        "cp AS (SELECT c.role, c.text AS original, n.text AS candidate FROM conversations c "
        "JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)",
        f"p AS MATERIALIZED (SELECT row_number() OVER () AS id, role, {words_sql(low.format('candidate'))} AS h, "
        f"{words_sql(low.format('original'))} AS r FROM cp)",
        "t(id, d, two, one) AS (SELECT id, 0::BIGINT, []::BIGINT[], "
        f"list_transform(range(0, len(h) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE {far} END) FROM p "
        f"UNION ALL SELECT t.id, d + 1, one, {step} FROM t JOIN p ON p.id = t.id WHERE d < len(h) + len(r))",
        "e AS (SELECT t.id, one[len(h) + 1] AS edits FROM t JOIN p ON p.id = t.id WHERE d = len(h) + len(r))"]) + "\n" + body


def embedding_cosine_sql() -> str:
    a = "CAST(a AS DOUBLE[])"
    b = "CAST(b AS DOUBLE[])"
    dot = f"list_sum(list_transform(range(1, len(a) + 1), lambda i: CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE)))"
    na = f"list_sum(list_transform({a}, lambda x: x * x))"
    nb = f"list_sum(list_transform({b}, lambda x: x * x))"
    return with_ctes([
        "vp AS (SELECT vec_id // 2 AS pair_id, arg_min(embedding, vec_id) AS a, arg_max(embedding, vec_id) AS b, "
        "arg_min(label, vec_id) AS label, count(*) AS n FROM embeddings GROUP BY vec_id // 2)",
        f"vc AS (SELECT label, CASE WHEN {na} = 0 OR {nb} = 0 THEN 0.0 ELSE {dot} / sqrt({na} * {nb}) END AS c FROM vp WHERE n = 2)"],
        "SELECT label, round(avg(c), 6) AS embedding, count(*) AS n_pairs FROM vc GROUP BY label")


# ---- quality -------------------------------------------------------------------- #

def words_sql(x: str) -> str:
    t = strip_ws(x)
    return f"(CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({t}, '{WS}+') END)"


def length_profile_sql(mn: int, mx: int, smin: int, smax: int) -> str:
    return with_ctes([sentences_cte(), f"w AS (SELECT domain, text, len({words_sql('text')}) AS nw FROM sent)"],
                     f"""SELECT domain, count(*) AS n, min(nw) AS min_words, round(avg(nw), 4) AS avg_words,
 max(nw) AS max_words, round(stddev_samp(nw), 4) AS sd_words, sum(CAST(nw < {mn} AS INTEGER)) AS n_short,
 sum(CAST(nw > {mx} AS INTEGER)) AS n_long, sum(CAST(nw BETWEEN {smin} AND {smax} AS INTEGER)) AS n_sweet,
 sum(CAST(contains(text, ';') AS INTEGER)) AS n_semicolon FROM w GROUP BY domain""")


def exact_dups_sql() -> str:
    return ("SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_doc FROM documents "
            "GROUP BY md5(text) HAVING count(*) > 1")


def near_dups_sql(shingle: int, num: int, den: int) -> str:
    """All pairs of distinct shingle sets that share a shingle; no buckets."""
    w = words_sql("lower(text)")
    sh = (f"CASE WHEN len(w) >= {shingle} THEN list_transform(range(1, len(w) - {shingle} + 2), "
          f"lambda i: array_to_string(w[i:i + {shingle - 1}], ' ')) ELSE [array_to_string(w, ' ')] END")
    return with_ctes([f"dw AS (SELECT doc_id, {w} AS w FROM documents WHERE text IS NOT NULL)",
                      f"ds AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct({sh})) AS sh FROM dw)",
                      "k AS MATERIALIZED (SELECT doc_id, md5(array_to_string(sh, chr(10))) AS key FROM ds)",
                      "low AS MATERIALIZED (SELECT key, min(doc_id) AS low FROM k GROUP BY key)",
                      "s AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM ds WHERE doc_id IN (SELECT low FROM low))",
                      "p AS (SELECT x.doc_id, y.doc_id AS other, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS shared "
                      "FROM s x JOIN s y ON x.h = y.h AND y.doc_id < x.doc_id GROUP BY ALL)",
                      f"b AS (SELECT doc_id, min(other) AS best FROM p WHERE {den} * shared >= {num} * (n + m - shared) GROUP BY doc_id)",
                      "t AS (SELECT k.doc_id, least(low, coalesce(best, low)) AS rep_doc_id FROM k JOIN low USING (key) "
                      "LEFT JOIN b ON b.doc_id = low.low)"],
                     "SELECT doc_id, rep_doc_id FROM t WHERE rep_doc_id < doc_id")


def register_markers_sql(contraction: str, first_person: str) -> str:
    return with_sent(f"""SELECT domain, count(*) AS n,
 round(avg(CAST(regexp_matches(lower(text), {q(contraction)}) AS DOUBLE)), 6) AS contraction_share,
 round(avg(CAST(regexp_matches(lower(text), {q(first_person)}) AS DOUBLE)), 6) AS first_person_share
 FROM sent GROUP BY domain""")


# ---- cache state against a seeded cache ---------------------------------------- #

def seeded_key_ctes(seed_backend: str) -> list[str]:
    """CTE ``ck``(k): keys a round trip with ``seed_backend`` leaves in a fresh cache."""
    ctes = round_trip_ctes([seed_backend])
    ctes.append("ck AS (SELECT DISTINCT k FROM ("
                f"SELECT {key('backend', q(PIVOT), 'language', 'text')} AS k FROM rt3 WHERE NOT forward_failed "
                f"UNION ALL SELECT {key('backend', 'language', q(PIVOT), 'forward')} FROM rt3 WHERE NOT back_failed "
                f"UNION ALL SELECT {key('backend', q(PIVOT), 'language', 'back')} FROM rt3 WHERE NOT third_failed))")
    ctes.append(backends_cte(BACKENDS, "bk2"))
    ctes.append(f"req AS (SELECT bk2.backend, piv.language AS tgt, {key('bk2.backend', q(PIVOT), 'piv.language', 'sent.text')} AS k "
                "FROM sent CROSS JOIN piv CROSS JOIN bk2)")
    return ctes


def cache_lookup_sql(seed_backend: str) -> str:
    return with_ctes(seeded_key_ctes(seed_backend),
                     "SELECT backend, tgt, count(*) AS n_requests, sum(CASE WHEN ck.k IS NOT NULL THEN 1 ELSE 0 END) AS n_hits "
                     "FROM req LEFT JOIN ck USING (k) GROUP BY backend, tgt")


def cache_misses_sql(seed_backend: str) -> str:
    return with_ctes(seeded_key_ctes(seed_backend),
                     "SELECT backend, tgt, count(DISTINCT k) AS n_missing_keys FROM req "
                     "WHERE k NOT IN (SELECT k FROM ck) GROUP BY backend, tgt")


def unique_keys_sql(seed_backend: str) -> str:
    return with_ctes(seeded_key_ctes(seed_backend) + [
        "ckt AS (SELECT DISTINCT k, backend, tgt FROM ("
        f"SELECT backend, language AS tgt, {key('backend', q(PIVOT), 'language', 'text')} AS k FROM rt3 WHERE NOT forward_failed "
        f"UNION ALL SELECT backend, {q(PIVOT)}, {key('backend', 'language', q(PIVOT), 'forward')} FROM rt3 WHERE NOT back_failed "
        f"UNION ALL SELECT backend, language, {key('backend', q(PIVOT), 'language', 'back')} FROM rt3 WHERE NOT third_failed))"],
        "SELECT backend, tgt, count(DISTINCT k) AS n_keys, sum(CAST(NOT regexp_full_match(k, '[0-9a-f]{32}') AS INTEGER)) AS n_bad "
        "FROM ckt GROUP BY ROLLUP (backend, tgt)")


# ---- replay of the protocols against the seeded cache ------------------------- #

def _look_ctes(name: str, src_cte: str, src: str, tgt: str, src_code: str, tgt_code: str) -> list[str]:
    """CTE ``name``: ``src_cte`` with k, found and value (null on a miss) of one lookup."""
    return [f"{name}_k AS (SELECT *, {key('backend', src, tgt, 'cur')} AS k FROM {src_cte})",
            f"{name} AS MATERIALIZED (SELECT {name}_k.*, ck.k IS NOT NULL AS found, CASE WHEN ck.k IS NOT NULL THEN "
            f"{channel('backend', 'cur', tgt, src_code, tgt_code)} END AS value FROM {name}_k LEFT JOIN ck ON ck.k = {name}_k.k)"]


def replay_ctes(seed_backend: str) -> list[str]:
    """CTE ``looks``(backend, protocol, k, found)."""
    ctes = [c for c in seeded_key_ctes(seed_backend) if not c.startswith("req AS")]
    have = " ".join(ctes)
    ctes += [c for c in chain_cte() if c.split(" AS ")[0].split("(")[0] + " AS" not in have and c.split("(")[0] + "(" not in have]
    none = "NULL::INTEGER"
    ctes.append("b0 AS (SELECT bk2.backend, sent.sent_id, sent.text AS cur FROM sent CROSS JOIN bk2)")
    told = []

    def legs(p: str, protocol: str, langs: str, n: int) -> None:
        ctes.append(f"{p}0 AS (SELECT b0.*, l.language, l.code FROM b0 CROSS JOIN ({langs}) l)")
        for leg in range(n):
            there = leg % 2 == 0
            ctes.extend(_look_ctes(f"{p}l{leg}", f"{p}{leg}", q(PIVOT) if there else "language", "language" if there else q(PIVOT),
                                   none if there else "code", "code" if there else none))
            told.append(f"SELECT backend, '{protocol}' AS protocol, k, found FROM {p}l{leg}")
            ctes.append(f"{p}{leg + 1} AS (SELECT backend, sent_id, value AS cur, language, code FROM {p}l{leg} WHERE found)")

    legs("xb", "back_translation", "SELECT language, code FROM piv", 2)
    ctes.append("xc0 AS (SELECT b0.*, o.\"order\" AS ord, 'en' AS at_l, NULL::INTEGER AS at_code FROM b0 CROSS JOIN (SELECT DISTINCT \"order\" FROM ch) o)")
    for h in range(1, 6):
        ctes.append(f"xq{h} AS (SELECT c.*, ch.language AS to_l, ch.code AS to_c FROM xc{h - 1} c JOIN ch ON ch.\"order\" = c.ord AND ch.hop = {h})")
        ctes.extend(_look_ctes(f"xf{h}", f"xq{h}", "at_l", "to_l", "at_code", "to_c"))
        told.append(f"SELECT backend, 'telephone_chain', k, found FROM xf{h}")
        ctes.append(f"xc{h} AS (SELECT backend, sent_id, coalesce(value, cur) AS cur, ord, to_l AS at_l, to_c AS at_code FROM xf{h})")
        ctes.extend(_look_ctes(f"xd{h}", f"xc{h}", "at_l", q(PIVOT), "at_code", none))
        told.append(f"SELECT backend, 'telephone_chain', k, found FROM xd{h}")
    legs("xr", "round_trip", "SELECT language, code FROM ch WHERE \"order\" = 'linguistic'", 3)
    ctes.append("looks AS MATERIALIZED (" + " UNION ALL ".join(told) + ")")
    ctes.append("own AS (SELECT DISTINCT k, backend || ':' || protocol AS tag, backend, protocol FROM looks WHERE found)")
    return ctes


REPLAY_BODIES = {
    "replay_requests": "SELECT backend, protocol, count(*) AS n_ops, sum(CAST(found AS BIGINT))::BIGINT AS n_hits, count(DISTINCT k) AS n_unique "
                       "FROM looks GROUP BY ALL",
    "key_owners": "SELECT tags, count(*) AS n_keys FROM (SELECT k, string_agg(tag, '+' ORDER BY tag) AS tags FROM own GROUP BY k) GROUP BY tags",
    "keys_by_tag": "SELECT backend, protocol, count(DISTINCT k) AS n_keys FROM own GROUP BY ROLLUP (backend, protocol) HAVING backend IS NOT NULL",
    "replay_misses": "SELECT backend || ':' || protocol AS tag, sum(CAST(NOT found AS BIGINT))::BIGINT AS n_missed FROM looks GROUP BY ALL",
    "key_overlap": "SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_shared FROM own a JOIN own b ON a.k = b.k AND a.tag < b.tag GROUP BY ALL",
}


def replay_sql(seed_backend: str, name: str) -> str:
    return with_ctes(replay_ctes(seed_backend), REPLAY_BODIES[name])


def unattributed_sql(seed_backend: str) -> str:
    return with_ctes(replay_ctes(seed_backend),
                     f"SELECT {q(seed_backend)} AS backend, count(*) AS n_keys, sum(CAST(k NOT IN (SELECT k FROM own) AS BIGINT))::BIGINT AS n_unattributed FROM ck")


def word_vector_sql() -> str:
    """Plain joins and sums: one row per word of a text and dimension."""
    def words(col):
        return f"unnest({split_tokens(tok13a(f'lower({col})'))})"

    return f"""WITH cp AS (SELECT c.conv_id, c.turn, c.role, c.text AS original, n.text AS candidate FROM conversations c
 JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1),
w AS (SELECT conv_id, turn, 'r' AS side, {words('original')} AS word FROM cp
 UNION ALL SELECT conv_id, turn, 'h', {words('candidate')} FROM cp),
n AS (SELECT conv_id, turn, side, word, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
s AS (SELECT conv_id, turn, dim, sum(CASE WHEN side = 'r' THEN n * v ELSE 0 END) AS r, sum(CASE WHEN side = 'h' THEN n * v ELSE 0 END) AS h
 FROM n JOIN v ON v.vec_id = ('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT max(vec_id) + 1 FROM embeddings) GROUP BY ALL),
p AS (SELECT conv_id, turn, sum(r * h) AS dot, sum(r * r) AS rr, sum(h * h) AS hh FROM s GROUP BY ALL)
SELECT cp.role, round(avg(CASE WHEN p.rr > 0 AND p.hh > 0 THEN p.dot / sqrt(p.rr * p.hh) ELSE 0.0 END), 6) AS cosine, count(*) AS n_pairs
FROM cp LEFT JOIN p USING (conv_id, turn) GROUP BY cp.role"""
