"""Text primitives as Spark column expressions (JVM-side, no Python per row).

* ``tokenize_13a`` -- the standard mteval-13a tokenizer as an ordered list of
  regex replacements; ``tokens_13a`` is the same over an Arrow array, for
  functions that score whole batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The mteval-13a tokenizer (entity unescaping, then four regex
# replacements, then whitespace collapse).
TOK13A_LITERALS = [("<skipped>", ""), ("-\n", ""), ("\n", " "),
                   ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
TOK13A_REGEXES = [
    (r"([{-~\[-`\x20-&(-+:-@/])", " {1} "),
    (r"([^0-9])([.,])", "{1} {2} "),
    (r"([.,])([^0-9])", " {1} {2}"),
    (r"([0-9])(-)", "{1} {2} "),
]
WS = r"[\t\n\x0B\f\r ]"
# End of fixed values.

MAX_ORDER = 4


def spark_repl(template: str) -> str:
    return template.replace("{1}", "$1").replace("{2}", "$2")


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def tokenize_13a(c: Column) -> Column:
    """Tokenized string (single spaces, no leading/trailing blanks).

    The line is padded with a blank on both sides before the rules, so that a
    mark at its start or end has a neighbour.
    """
    x = c
    for a, b in TOK13A_LITERALS:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for pat, rep in TOK13A_REGEXES:
        x = F.regexp_replace(x, pat, spark_repl(rep))
    return strip_ws(F.regexp_replace(x, f"{WS}+", " "))


def tokens_13a(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts one after another, and how many each text has (null: none)."""
    x = pc.fill_null(texts, "")
    for a, b in TOK13A_LITERALS:
        x = pc.replace_substring(x, a, b)
    x = pc.binary_join_element_wise("", x, "", " ")
    for pat, rep in TOK13A_REGEXES:
        x = pc.replace_substring_regex(x, pat, rep.replace("{1}", r"\1").replace("{2}", r"\2"))
    parts = pc.ascii_split_whitespace(x)
    flat = parts.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    return flat.filter(some), np.bincount(row[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def split_tokens(s: Column) -> Column:
    """Split a normalised string on single spaces; '' gives an empty array."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def words(c: Column) -> Column:
    """Whitespace words of a raw text (for length rules)."""
    t = strip_ws(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{WS}+"))
