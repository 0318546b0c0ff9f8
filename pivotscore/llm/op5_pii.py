"""Personal data by a semi-Markov conditional random field.

Base rules find e-mail addresses, IP addresses, card and phone numbers.  The
field then reads every stretch of words with a digit or an @: its atoms are
digit runs, letter runs and single characters, and whole segments of at most
``LONGEST`` atoms are scored by features of the segment (shape, checksum,
digit count, borders, words before).  Dynamic programming over segments
chooses boundaries and kinds jointly.  Base spans stay; spans of the field
that touch none of them are added.

The weights are fitted by maximum likelihood on at most ``SAMPLE`` stretches
of the documents, labelled by the base rules, and on made-up stretches in
which numbers stand next to each other, where those rules fail.

Defined results: a null text counts as empty (no spans); an empty table
gives no rows; repeated rows get the same spans.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[str, int, int]
#: Atoms of the longest segment; stretches of documents used for fitting.
LONGEST, SAMPLE = 26, 400

# ---- base rules ------------------------------------------------------------ #
# Written so that no start is tried twice; the matches are those of the plain patterns.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base(text: str) -> list[Span]:
    """The base rules' spans by kind, then start."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _AT.finditer(text):
            s = m.start()
            while s > end and text[s - 1] in _LOCAL:
                s -= 1
            if s < m.start():
                out.append(("email", s, m.end()))
                end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- the field ------------------------------------------------------------- #
_ZONE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]", re.DOTALL)
_SHAPE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
          "ip": re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"),
          "card": re.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){3}(?:[ -]?[0-9]{1,3})?"),
          "phone": re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,3}")}
_CUES = {"email": {"email", "mail", "e-mail"}, "ip": {"ip", "host", "address"}, "card": {"card", "visa", "carte", "tarjeta"},
         "phone": {"tel", "phone", "call", "fax", "mobile", "tel."}}
#: Features of a segment of each kind; the last weight is that of an atom outside.
N_FEATURES = 13


def features(text: str, s: int, e: int, kind: str, cue: str) -> list[float]:
    """Whole-span features of text[s:e] as an entity of a kind."""
    span = text[s:e]
    before, after = text[s - 1:s], text[e:e + 1]
    digits = _digits(span)
    open_left = bool(before) and (before.isalnum() or before in "@+.-_%")
    open_right = bool(after) and (after.isalnum() or after in "@_" or after in ".-" and text[e + 1:e + 2].isalnum())
    if kind == "card":
        check = 16 <= len(digits) <= 19 and luhn(digits)
    elif kind == "ip":
        check = span.count(".") == 3 and all(p.isdigit() and len(p) < 4 and int(p) <= 255 for p in span.split("."))
    elif kind == "phone":
        check = 8 <= len(digits) <= 15
    else:
        check = span.count("@") == 1 and "." in span.partition("@")[2]
    groups = re.findall(r"[0-9]+", span)
    return [1.0, bool(_SHAPE[kind].fullmatch(span)), check, open_left, open_right, span.startswith("+"),
            len(digits) / 10, any(c.isalpha() for c in span), " " in span, span.count("(") != span.count(")"),
            any(len(g) > 6 for g in groups), cue in _CUES[kind], len(groups) / 5]


def segments(text: str, zone: tuple[int, int]) -> tuple[list[int], list[tuple], np.ndarray]:
    """Atom borders of a stretch, and its possible segments with their features.

    A possible segment starts and ends on letters or digits, a plus or an
    opening bracket counting as start, and fits its kind's characters.
    """
    s0, e0 = zone
    cuts = [s0] + [s0 + m.end() for m in _ATOM.finditer(text[s0:e0])]
    cue = text[max(0, s0 - 24):s0].split()
    cue = cue[-1].strip(":").lower() if cue else ""
    found, rows = [], []
    n = len(cuts) - 1
    for i in range(n):
        first = text[cuts[i]]
        if not (first.isalnum() and first.isascii() or first in "+("):
            continue
        digits, odd, at = 0, False, 0
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            a = text[cuts[j - 1]:cuts[j]]
            if "0" <= a[0] <= "9":
                digits += len(a)
            elif a.isalpha() and a.isascii() or a in "_%":
                odd = True
            elif a == "@":
                at += 1
            elif a not in " ().-+":
                break
            if not (a[-1].isalnum() and a.isascii()):
                continue
            spaced = " " in text[cuts[i]:cuts[j]]
            if at and first not in "+(" and not spaced and at == 1:
                found.append((i, j, 0))
            if odd or at:
                continue
            if 4 <= digits <= 12 and first.isdigit() and not spaced:
                found.append((i, j, 1))
            if 13 <= digits <= 19 and first.isdigit():
                found.append((i, j, 2))
            if 8 <= digits <= 15 and first in "+(":
                found.append((i, j, 3))
    rows = [features(text, cuts[i], cuts[j], KINDS[k], cue) for i, j, k in found]
    return cuts, found, np.array(rows, float).reshape(len(found), N_FEATURES)


def scores(found: list[tuple], rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    kinds = np.array([k for _, _, k in found], int)
    return (rows * weights[:-1].reshape(len(KINDS), N_FEATURES)[kinds]).sum(1) if found else np.zeros(0)


def best(n: int, found: list[tuple], score: np.ndarray, outside: float) -> list[tuple]:
    """The highest-scoring segmentation's entity segments."""
    by_end: dict[int, list[int]] = {}
    for x, (_, j, _) in enumerate(found):
        by_end.setdefault(j, []).append(x)
    top, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        top[j] = top[j - 1] + outside
        for x in by_end.get(j, ()):
            v = top[found[x][0]] + score[x]
            if v > top[j]:
                top[j], back[j] = v, x
    out, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            out.append(found[back[j]])
            j = found[back[j]][0]
    return out[::-1]


def expected(n: int, found: list[tuple], score: np.ndarray, outside: float) -> tuple[float, np.ndarray, float]:
    """Log partition function, each segment's probability, and the expected number of atoms outside."""
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for x, (i, j, _) in enumerate(found):
        ends.setdefault(j, []).append(x)
        starts.setdefault(i, []).append(x)
    fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        fwd[j] = np.logaddexp.reduce([fwd[j - 1] + outside, *(fwd[found[x][0]] + score[x] for x in ends.get(j, ()))])
    for i in range(n - 1, -1, -1):
        bwd[i] = np.logaddexp.reduce([bwd[i + 1] + outside, *(bwd[found[x][1]] + score[x] for x in starts.get(i, ()))])
    p = np.array([np.exp(fwd[i] + score[x] + bwd[j] - fwd[n]) for x, (i, j, _) in enumerate(found)])
    return fwd[n], p, float(np.exp(fwd[:-1] + outside + bwd[1:] - fwd[n]).sum())


def fit(examples: list[tuple[str, list[Span]]], steps: int = 60, l2: float = 0.02) -> np.ndarray:
    """Weights of maximum penalised likelihood for labelled stretches, by Adam."""
    cases = []
    for text, gold in examples:
        cuts, found, rows = segments(text, (0, len(text)))
        place = {x: k for k, x in enumerate(cuts)}
        want = {(place.get(s), place.get(e), KINDS.index(k)) for k, s, e in gold}
        if not want <= set(found):
            continue  # a border inside an atom, or a segment that no feature covers
        hit = np.array([f in want for f in found], float)
        cases.append((len(cuts) - 1, found, rows, hit, len(cuts) - 1 - sum(j - i for i, j, _ in want)))
    w = np.zeros(len(KINDS) * N_FEATURES + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        grad = -l2 * w
        for n, found, rows, hit, free in cases:
            _, p, out = expected(n, found, scores(found, rows, w), w[-1])
            d = (hit - p)[:, None] * rows if found else np.zeros((0, N_FEATURES))
            for k in range(len(KINDS)):
                mine = [x for x, f in enumerate(found) if f[2] == k]
                if mine:
                    grad[k * N_FEATURES:(k + 1) * N_FEATURES] += d[mine].sum(0) / len(cases)
            grad[-1] += (free - out) / len(cases)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        w += 0.4 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return w


def made_up(count: int = 160, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Stretches of one to three entities and other numbers, side by side."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda n: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        d = next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join((body + d)[k:k + 4] for k in range(0, 16, 4))

    def failing() -> str:
        """A number of a card's length and form that fails the checksum."""
        body = num(rng.choice([15, 15, 15, 16, 17, 18]))
        d = rng.choice([c for c in "0123456789" if not luhn(body + c)])
        sep = rng.choice(["", "", " ", "-"])
        return sep.join((body + d)[k:k + 4] for k in range(0, len(body) + 1, 4))

    def phone() -> str:
        return rng.choice([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(4)} {num(3)}", f"+1-{num(3)}-{num(3)}-{num(4)}",
                           f"({num(3)}) {num(3)}-{num(4)}"])

    def one() -> tuple[str | None, str]:
        kind = rng.choice([*KINDS, None, None, "fails"])
        if kind == "email":
            return kind, f"{word(5)}{rng.choice(['.', '_', ''])}{num(2)}@{word(6)}{rng.choice(['', num(1)])}.{rng.choice(['com', 'org', 'example.com'])}"
        if kind == "ip":
            return kind, ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            return kind, card()
        if kind == "phone":
            return kind, phone()
        if kind == "fails":
            return None, failing()
        return None, rng.choice([num(rng.randint(1, 15)), f"{num(1)}.{num(1)}", f"{num(1)}.{num(1)}.{num(1)}", "20" + num(2), f"{num(2)}%",
                                 f"{word(4)}={word(1)}{num(3)}{word(2)}{num(2)}", word(2) + num(3) + word(1) + num(8), "AKIA" + num(2) + "XQ" + num(4),
                                 f"{num(4)}.{num(4)}.{num(4)}.{num(4)}", f"{num(4)}-{num(2)}-{num(2)}", f"@{word(5)}", f"{num(3)},{num(3)},{num(3)},{num(3)}"])

    out = []
    for _ in range(count):
        text, gold = "", []
        for k in range(rng.randint(1, 3)):
            kind, s = one()
            text += " " * bool(k)
            if kind:
                gold.append((kind, len(text), len(text) + len(s)))
            text += s
        out.append((text, gold))
    return out


def labelled(text: str) -> list[tuple[str, list[Span]]]:
    """The stretches of a text that the base rules label: those without overlaps or failed candidates."""
    spans = base(text)
    out = []
    for m in _ZONE.finditer(text):
        s, e = m.span()
        mine = [(k, a - s, b - s) for k, a, b in spans if s <= a and b <= e]
        lost = any(not any(k == "phone" and a == s + p.start() for k, a, _ in spans) for p in _PHONE.finditer(m[0]))
        if not lost and e - s <= 120 and len({a for _, a, _ in mine}) == len(mine):
            out.append((m[0], mine))
    return out


def train(docs: DataFrame, rows: int = SAMPLE) -> np.ndarray:
    """Weights from at most ``rows`` stretches of the documents (those of least hash) and the made-up ones."""
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(z, [f"{k}:{s}:{e}" for k, s, e in g]) for t in b.column("text").to_pylist() if t for z, g in labelled(t)]
            yield pa.RecordBatch.from_arrays([pa.array([z for z, _ in got], pa.string()), pa.array([g for _, g in got], pa.list_(pa.string()))],
                                             names=["zone", "gold"])

    got = (docs.select("text").mapInArrow(stretches, "zone string, gold array<string>").distinct()
           .orderBy(F.xxhash64("zone"), "zone").limit(rows).collect())
    seen = [(r["zone"], [(k, int(s), int(e)) for k, s, e in (g.split(":") for g in r["gold"])]) for r in got]
    return fit(made_up() + seen)


def spans(text: str | None, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """The base spans, and the spans that the field adds."""
    text = text or ""
    if not re.search("[0-9@]", text):
        return [], []
    fixed = base(text)
    taken = sorted((s, e) for _, s, e in fixed)
    added, k = [], 0
    for m in _ZONE.finditer(text):
        cuts, found, rows = segments(text, m.span())
        if not found:
            continue
        for i, j, kind in best(len(cuts) - 1, found, scores(found, rows, weights), weights[-1]):
            s, e = cuts[i], cuts[j]
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            q, clash = k, False
            while q < len(taken) and taken[q][0] < e:
                clash |= taken[q][1] > s
                q += 1
            if not clash:
                added.append((KINDS[kind], s, e))
    return fixed, added


def order(found: list[Span]) -> list[Span]:
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in order(found))


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, counts of base spans, base_sha256, spans, n_added) of every whole text."""
    names = [f"n_{k}" for k in KINDS]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [spans(t, weights) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([sum(x[0] == k for x in f) for f, _ in got], pa.int64()) for k in KINDS),
                 pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f, _ in got], pa.string()),
                 pa.array([joined(f + a) for f, a in got], pa.string()), pa.array([len(a) for _, a in got], pa.int64())],
                names=["doc_id", *names, "base_sha256", "spans", "n_added"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def hide(text: str, found: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, end = [], 0
    for k, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"[{k.upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with personal data hidden in ``text``; a null text stays null."""
    @F.pandas_udf("string")
    def hidden(texts):
        return texts.map(lambda t: None if t is None else hide(t, sum(spans(t, weights), [])))

    return docs.withColumn("text", hidden("text"))
